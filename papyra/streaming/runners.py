"""Start the flows as streaming queries over a directory of files.

Sources are file streams (parquet), sinks are parquet tables or
``foreachBatch`` writers; checkpoints live under the cluster's shared
``spark.checkpoint.dir`` so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, like: DataFrame | None = None, schema=None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream of parquet files under ``path`` (schema given or
    taken from a static DataFrame, never inferred at stream start)."""
    r = spark.readStream.format("parquet").schema(schema if schema is not None else like.schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "papyra-streams", name)


def start(df: DataFrame, name: str, sink_path: str | None = None, output_mode: str = "append",
          foreach_batch=None, available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """Start ``df`` to a file sink (append) or a ``foreachBatch`` writer
    (update/complete modes, upserts)."""
    spark = df.sparkSession
    w = (df.writeStream.queryName(name).outputMode(output_mode)
         .option("checkpointLocation", checkpoint_location(spark, name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    if foreach_batch is not None:
        return w.foreachBatch(foreach_batch).start()
    return w.format(fmt).start(sink_path)


def snapshot_writer(path: str):
    """foreachBatch writer for update/complete-mode aggregates: each epoch's
    rows go to their own folder (idempotent on retry); the latest value per
    key is read back with ``latest_by_key``."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return write


def latest_by_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Read an epoch-partitioned update table keeping the last epoch's row
    per key (a ``max_by`` over the epoch, no window)."""
    from pyspark.sql import functions as F
    t = spark.read.parquet(path)
    vals = [c for c in t.columns if c not in keys and c != "epoch"]
    g = t.groupBy(*keys).agg(F.max_by(F.struct(*vals), "epoch").alias("_r"))
    return g.select(*keys, "_r.*")
