"""A versioned table of Parquet files with a manifest.

Rows live in buckets of their key. A version rewrites only the buckets that its
changes touch, into a new folder, and then appends one manifest file that says
which folder holds each of them; files of earlier versions stay as they are. The
manifest file is written last and appears as a whole, so a writer that dies
before it leaves the table as it was, and a reader that has looked up a version
keeps reading that version whatever is written meanwhile. Everything goes through
Spark's file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import upsert_documents

BUCKETS = 64
MANIFEST = "version bigint, writer string, epoch bigint, bucket int, path string, buckets int"


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """One row per version and bucket it rewrote; empty for a new table."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{table}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current_version(spark: SparkSession, table: str) -> int:
    """The last published version; 0 before the first."""
    return manifest(spark, table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _folders(spark: SparkSession, table: str, version: int) -> dict[int, str]:
    """Bucket to folder at a version: at most one a bucket."""
    m = manifest(spark, table).filter(F.col("version") <= version)
    return {r.bucket: r.path for r in m.groupBy("bucket").agg(F.max_by("path", "version").alias("path")).collect()}


def _read(spark: SparkSession, schema, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, table: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version (the last by default), pinned: later writes do
    not change what this frame reads."""
    version = current_version(spark, table) if version is None else version
    return _read(spark, schema, sorted(_folders(spark, table, version).values()))


def _publish(spark: SparkSession, table: str, rows: list[tuple]) -> None:
    """The manifest file of a version, in one file, hence all or nothing."""
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{table}/_manifest")


def write_changes(table: str, changes: DataFrame, key: str = "id", order: str = "updated_at", writer: str = "batch",
                  epoch: int | None = None, buckets: int = BUCKETS) -> int:
    """A4 onto the table: ``changes`` upserted by ``key`` (the latest by
    ``order`` wins); returns the version that holds them. An epoch that the
    writer has published before changes nothing, nor does a row without a key. One writer
    at a time."""
    spark = changes.sparkSession
    log = manifest(spark, table)
    if epoch is not None:
        done = log.filter((F.col("writer") == writer) & (F.col("epoch") >= epoch)).agg(F.min("version")).first()[0]
        if done is not None:
            return done
    version, first = log.agg(F.coalesce(F.max("version"), F.lit(0)), F.min("buckets")).first()
    buckets = first or buckets  # fixed by the first version
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
    changes = changes.filter(F.col(key).isNotNull())
    touched = {r[0] for r in changes.select(bucket).distinct().collect()}  # at most the number of buckets
    if not touched:
        return version
    held = _folders(spark, table, version)
    base = _read(spark, changes.schema, [held[b] for b in sorted(touched & set(held))])
    folder = f"{table}/v{version + 1:09d}-{uuid.uuid4().hex[:8]}"
    after = upsert_documents(base, changes, key, order).withColumn("_bucket", bucket)
    after.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(folder)
    _publish(spark, table, [(version + 1, writer, epoch, b, f"{folder}/_bucket={b}", buckets) for b in sorted(touched)])
    return version + 1


def snapshot_sink(table: str, writer: str, key: str = "id", order: str = "updated_at",
                  buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: each micro-batch is one version, a replayed
    one a no-op."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        write_changes(table, batch, key, order, writer, epoch_id, buckets)
    return write
