"""Versioned table sink: upserts from a stream, a run that dies between data
and manifest, replayed epochs, pinned readers."""

import os
import tempfile
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from papyra.sources import snapshots as SN
from papyra.streaming import flows as ST
from papyra.streaming import runners as RN

SCHEMA = "id bigint, v string, updated_at bigint"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_and_replays(spark):
    table = tempfile.mkdtemp(prefix="papyra-snap-")
    assert SN.current_version(spark, table) == 0 and SN.read_snapshot(spark, table, SCHEMA).count() == 0
    one = spark.createDataFrame([(k, "a", 1) for k in range(20)] + [(3, "newer", 2), (None, "no id", 1)], SCHEMA)
    assert SN.write_changes(table, one, buckets=8, epoch=0, writer="w") == 1
    pinned = SN.read_snapshot(spark, table, SCHEMA)
    want = sorted([(k, "newer" if k == 3 else "a", 2 if k == 3 else 1) for k in range(20)], key=repr)
    assert _rows(pinned) == want
    two = spark.createDataFrame([(3, "older", 1), (4, "b", 5), (99, "new", 1)], SCHEMA)
    assert SN.write_changes(table, two, epoch=1, writer="w") == 2
    assert SN.manifest(spark, table).filter("version = 2").count() < 8  # only the touched buckets
    after = sorted([(k, {3: "newer", 4: "b"}.get(k, "a"), {3: 2, 4: 5}.get(k, 1)) for k in range(20)] + [(99, "new", 1)], key=repr)
    assert _rows(SN.read_snapshot(spark, table, SCHEMA)) == after
    assert _rows(pinned) == want and _rows(SN.read_snapshot(spark, table, SCHEMA, 1)) == want
    assert SN.write_changes(table, two.withColumn("v", F.lit("again")), epoch=1, writer="w") == 2
    assert SN.write_changes(table, two.limit(0), epoch=2, writer="w") == 2
    assert _rows(SN.read_snapshot(spark, table, SCHEMA)) == after


def test_inbox_stream_killed_between_data_and_manifest(spark, fx, monkeypatch):
    files = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                             F.concat(F.lit("doc_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
                             F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("received_ms"))
    twice = files.filter("id % 3 = 0").withColumn("received_ms", F.col("received_ms") + 1)  # the same file again, later
    src = tempfile.mkdtemp(prefix="papyra-src-")
    files.unionByName(twice).repartition(3).write.mode("overwrite").parquet(src)
    table, name = tempfile.mkdtemp(prefix="papyra-snap-"), f"inbox_snap_{uuid.uuid4().hex[:8]}"

    def run():
        stream = ST.inbox_rows(RN.read_stream(spark, src, like=files, max_files_per_trigger=1), F.col("received_ms"))
        RN.start(stream, name, foreach_batch=SN.snapshot_sink(table, name, order="storage_key", buckets=4)).awaitTermination()

    publish, calls = SN._publish, []

    def dies_once(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed before the manifest")
        publish(*args)

    monkeypatch.setattr(SN, "_publish", dies_once)
    with pytest.raises(StreamingQueryException):
        run()
    assert SN.current_version(spark, table) == 1
    assert len([f for f in os.listdir(table) if f.startswith("v")]) == 2  # data without a manifest entry
    run()
    batch = ST.inbox_rows(files.unionByName(twice), F.col("received_ms"))
    want = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "storage_key").alias("r")).select("r.*")
    assert _rows(SN.read_snapshot(spark, table, batch.schema)) == _rows(want)
    assert SN.current_version(spark, table) == 3
