"""Global random shuffle into shards, in two passes: seeded hashes scatter the
records uniformly into memory-sized buckets, then a Fisher-Yates shuffle runs
inside each bucket and the shuffled bucket is written."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, utf8

# Buckets are dealt over as many shuffle partitions, up to this many.
MAX_PARTITIONS = 50_000
# A bucket table of this many rows (two longs each) is small enough to broadcast.
MAX_BROADCAST_BUCKETS = 100_000


def record_size(text: str = "text"):
    """UTF-8 bytes of the text plus 1 (null: 1)."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def write_shards(docs: DataFrame, path: str | None = None, n_shards: int = 16, seed: int = 42,
                 bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all rows, in a seeded random order, to ``n_shards`` Parquet
    shards (``shard=K`` folders) and return the folder. Every input column is
    kept inside the struct column ``record``; ``slot`` is the row's place in
    its shard, gapless from 0. Shard counts differ by one at most (law
    ``rows``).

    Pass 1 hashes (seed, id, text) to ``ceil(bytes / bucket_bytes)`` buckets,
    so a bucket holds about ``bucket_bytes`` whatever the table's size and no
    source or group of equal texts (their ids differ) can make one large. Pass
    2 orders a bucket by its own hash (which makes a retried task repeat
    itself), applies Spark's ``shuffle`` (Fisher-Yates) and numbers it from
    the bucket's offset, a running sum over the table of bucket counts.
    Everything after the shuffle is narrow up to the write, whose commit makes
    it final. ``shuffle`` adds the partition's number to its seed, so buckets
    are dealt over a number of partitions that follows from their count alone,
    in bucket order: places depend on rows, ``seed``, ``n_shards`` and
    ``bucket_bytes``, not on the session's shuffle partitions.

    Null id or text: hashed like any value. Records that repeat id and text
    share a bucket. Extra columns live inside ``record`` and cannot clash. An
    empty table writes no shard.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    records = docs.select(docs[id_col].alias("id"), docs[text_col].alias("txt"),
                          F.struct(*[docs[c] for c in docs.columns]).alias("record"))
    key = F.xxhash64(F.lit(seed), "id", "txt")
    n_bytes = records.agg(F.sum(record_size("txt"))).first()[0] or 0
    n_buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    bucket = F.pmod(key, F.lit(n_buckets)).alias("bucket")

    counts = records.select(bucket).groupBy("bucket").agg(F.count("*").alias("n_rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("bucket", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"),
                            F.sum("n_rows").over(every).alias("total"))
    if n_buckets <= MAX_BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)

    record = F.struct(F.xxhash64(F.lit(seed + 1), "id", "txt").alias("tie"), "record").alias("r")
    dealt = records.select(bucket, record).repartition(min(n_buckets, MAX_PARTITIONS), "bucket")
    gathered = dealt.groupBy("bucket").agg(F.collect_list("r").alias("rows"))
    in_order = F.array_sort("rows", lambda a, b: F.when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0))
    shuffled = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle(in_order, seed).alias("rows"))
    placed = (shuffled.join(offsets, "bucket")
              .select("offset", "total", F.posexplode("rows").alias("pos", "r"))
              .select((F.col("offset") + F.col("pos")).alias("place"), "total", F.col("r.record").alias("record")))
    shard = F.expr(f"place * {n_shards} div total")
    # the first place of shard s is ceil(s * total / n_shards)
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    (placed.withColumn("shard", shard)
     .select("record", (F.col("place") - first).alias("slot"), F.col("shard").cast("int").alias("shard"))
     .sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
    return path


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The written shards: ``record, slot, shard``."""
    from pyspark.sql import types as T
    return spark.read.schema(T.StructType([
        T.StructField("record", schema), T.StructField("slot", T.LongType()),
        T.StructField("shard", T.IntegerType())])).parquet(path)


def shard_digest(docs: DataFrame, **params) -> DataFrame:
    """Shards of ``docs`` written and read back, with the size, checksum and
    place of every record (``grown_shard`` is null: the law is ``rows``)."""
    path = write_shards(docs, **params)
    back = read_shards(docs.sparkSession, path, docs.schema)
    text = F.col("record.text")
    return back.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(utf8(text)).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
