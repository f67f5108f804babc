"""Object-store listings and file ingestion.

Real storage is read with the ``binaryFile`` source; when only metadata is
selected Spark never reads the file contents. The same operators accept a
key/size listing table (the fixtures use one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, mime_from_extension, slugify, typed_key


def read_objects(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Object metadata under ``root`` as (key, size_bytes, modified):
    ``binaryFile`` pruned to path, length and modificationTime."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(root))
    base = root.rstrip("/") + "/"
    key = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + _re_escape(base), "")
    return df.select(key.alias("key"), F.col("length").alias("size_bytes"),
                     F.col("modificationTime").alias("modified"))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def list_files(objects: DataFrame, user_id, folder: str | None = None) -> DataFrame:
    """A2: objects under ``{user}/`` or ``{user}/{folder}/``; filename is the
    last path part."""
    prefix = f"{user_id}/" if not folder else f"{user_id}/{folder}/"
    return (objects.filter(F.col("key").startswith(prefix))
            .withColumn("filename", F.element_at(F.split("key", "/"), -1)))


def audit_extracted_objects(objects: DataFrame) -> DataFrame:
    """A3: objects whose second key part is 'extracted': count and bytes per
    tenant (the first key part)."""
    parts = F.split("key", "/")
    ex = objects.filter(F.element_at(parts, 2) == "extracted").withColumn("tenant", F.element_at(parts, 1))
    return ex.groupBy("tenant").agg(F.count(F.lit(1)).alias("objects"),
                                    F.sum("size_bytes").cast("bigint").alias("bytes"))


def typed_layout(docs: DataFrame, type_col="document_type_name") -> DataFrame:
    """The typed key of every typed document, its type slug, and whether
    another document lands on the same key (the later write would win)."""
    t = docs.filter(F.col(type_col).isNotNull()).withColumn(
        "typed_key", typed_key("user_id", type_col, "filename")).withColumn("type_slug", slugify(type_col))
    dup = t.groupBy(F.col("typed_key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return t.join(dup, F.col("typed_key") == F.col("_k")).withColumn(
        "collision", F.col("_n") > 1).drop("_k", "_n")


def write_typed_layout(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A7 sink: documents laid out by tenant and type slug."""
    docs.write.mode(mode).partitionBy("user_id", "type_slug").parquet(path)


def ingest_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A8 over real files: (filename, mime, size, content, hash)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(root))
    return ingest_rows(df.select(F.element_at(F.split("path", "/"), -1).alias("filename"),
                                 F.col("content")))


def ingest_rows(files: DataFrame, name_col="filename", content_col="content") -> DataFrame:
    """A8 over (filename, content) rows: MIME by extension, byte size and
    hex SHA-256 of the content."""
    c = F.col(content_col)
    size = F.octet_length(c) if dict(files.dtypes)[content_col] == "string" else F.length(c)
    return files.select(F.col(name_col).alias("filename"), mime_from_extension(name_col).alias("mime"),
                        size.cast("bigint").alias("size_bytes"), c.alias("content"),
                        content_hash(c).alias("content_hash"))
