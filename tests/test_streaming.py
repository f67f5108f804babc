"""Streaming flows run to completion (availableNow) over files equal their
batch forms."""

import datetime as dt
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from papyra.plans import jobs as K
from papyra.sources.fixtures import ASOF_EVENTS
from papyra.streaming import flows as ST
from papyra.streaming import runners as RN


def _name(base):
    """A fresh query name, hence a fresh checkpoint location, per run."""
    return f"{base}_{uuid.uuid4().hex[:8]}"


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _source(spark, df, n_files=4, order="ts"):
    """Files in event-time order (as an inbox fills up)."""
    path = tempfile.mkdtemp(prefix="papyra-src-")
    if order in df.columns:
        df = df.repartitionByRange(n_files, order).sortWithinPartitions(order)
    else:
        df = df.repartition(n_files)
    df.write.mode("overwrite").parquet(path)
    # the file source picks files by modification time: make it follow the
    # range order of the part files
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    for i, f in enumerate(parts):
        os.utime(os.path.join(path, f), (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return path


def test_status_counts_stream_equals_batch(spark, fx):
    log = fx.events.select("ts", ST.event_status().alias("status"))
    src = _source(spark, log)
    stream = ST.status_counts(RN.read_stream(spark, src, like=log, max_files_per_trigger=1), watermark="2 hours")
    out = tempfile.mkdtemp(prefix="papyra-out-")
    RN.start(stream, _name("status_counts_test"), out, "append").awaitTermination()
    got = spark.read.parquet(out)
    want = ST.status_counts(log)
    cols = ["window_start", "status", "n"]
    # append mode emits a window once the watermark passes it: all but the last hours
    w = got.agg(F.max("window_start")).first()[0]
    assert _rows(got, cols) == _rows(want.filter(F.col("window_start") <= w), cols)


def _shuffled(spark, df, last, ts="ts"):
    """Four files, rows dealt at random, and a last one far ahead in time
    that lets the watermark pass all of them; (path, the rows)."""
    path = tempfile.mkdtemp(prefix="papyra-src-")
    for k in range(4):
        df.filter(F.pmod(F.hash("event_id"), F.lit(4)) == k).coalesce(1).write.parquet(f"{path}/f{k}")
    for k in range(2):  # the second one's batch runs under the first one's watermark
        last.withColumn(ts, F.col(ts) + F.expr(f"INTERVAL {k} DAYS")).coalesce(1).write.parquet(f"{path}/z{k}")
    for k, f in enumerate(["f0", "f1", "f2", "f3", "z0", "z1"]):
        for part in os.listdir(f"{path}/{f}"):
            os.utime(f"{path}/{f}/{part}", (1_700_000_000 + k * 10, 1_700_000_000 + k * 10))
    return f"{path}/*"


def _far(df, key, value, days=400):
    return df.limit(1).withColumns({key: F.lit(value).cast(df.schema[key].dataType),
                                    "ts": F.lit(dt.datetime(2025, 6, 1) + dt.timedelta(days=days)).cast("timestamp_ntz")})


def _run(stream, name):
    out = tempfile.mkdtemp(prefix="papyra-out-")
    q = RN.start(stream, _name(name), out, "append")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out), [
        p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def test_billing_fold_stream_equals_batch(spark, fx):
    """Shuffled files; customers leave the state and the merged folds are the
    subscriptions that the batch form gives."""
    ev = fx.v_billing_events
    src = _shuffled(spark, ev, _far(ev, "customer_ref", "cus_far"))
    stream = ST.billing_fold_stream(RN.read_stream(spark, src, like=ev, max_files_per_trigger=1), watermark="60 days")
    rows, state = _run(stream, "billing_test")
    assert max(state) > state[-1] and state[-1] <= 3
    last = ST.folded(rows.filter("customer_ref <> 'cus_far'"))
    batch = ST.billing_changes(ev).groupBy("customer_ref").agg(*[ST._last(c).alias(c) for c in ST.FOLD_FIELDS])
    cols = ["customer_ref", *ST.FOLD_FIELDS]
    assert sorted(map(repr, _rows(last, ["customer_ref"]))) == sorted(map(repr, _rows(batch, ["customer_ref"])))
    assert {repr(tuple(r[c] for c in cols)) for r in last.collect()} == {repr(tuple(r[c] for c in cols)) for r in batch.collect()}
    # folds of the same events in two parts merge to the same
    twice = rows.unionByName(rows)
    assert {repr(r) for r in ST.folded(twice.filter("customer_ref <> 'cus_far'")).collect()} == {repr(r) for r in last.collect()}


def test_usage_counter_stream(spark, fx):
    s = fx.events.filter(ST.event_status() == "completed").select("user_id", "ts")
    src = _source(spark, s)
    stream = ST.usage_counter(RN.read_stream(spark, src, like=s, max_files_per_trigger=1))
    out = tempfile.mkdtemp(prefix="papyra-out-")
    RN.start(stream, _name("usage_test"), output_mode="update", foreach_batch=RN.snapshot_writer(out)).awaitTermination()
    got = RN.latest_by_key(spark, out, ["user_id", "period"])
    cols = ["user_id", "period", "docs_used"]
    assert _rows(got, cols) == _rows(ST.usage_counter(s), cols)


def test_usage_by_month_ends(spark, fx):
    """A month's total comes once, when the watermark has passed it."""
    s = fx.events.filter(ST.event_status() == "completed").select("user_id", "event_id", "ts")
    src = _shuffled(spark, s, _far(s, "user_id", -1))
    stream = ST.usage_counter_stream(RN.read_stream(spark, src, like=s, max_files_per_trigger=1), watermark="60 days")
    rows, state = _run(stream, "usage_months_test")
    assert max(state) > state[-1] and state[-1] <= 4
    got = rows.filter("user_id <> -1")
    cols = ["user_id", "period", "docs_used"]
    assert _rows(got, cols) == _rows(ST.usage_counter(s.withColumn("ts", F.col("ts").cast("timestamp"))), cols)


def test_status_history_stream_equals_batch(spark, fx):
    """Four shuffled files, one per trigger, equal the batch form; documents
    leave the state."""
    log = fx.events.select(F.floor(F.col("event_id") / 5).cast("bigint").alias("doc_id"), "event_id", "ts",
                           ST.event_status().alias("status"))
    src = _shuffled(spark, log, _far(log, "doc_id", -1))
    stream = ST.status_history_stream(RN.read_stream(spark, src, like=log, max_files_per_trigger=1), watermark="60 days")
    rows, state = _run(stream, "history_test")
    assert max(state) > state[-1] and state[-1] <= 4
    cols = ["doc_id", "event_id", "prev_status", "status", "valid"]
    key = lambda df: sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert key(rows.filter("doc_id <> -1")) == key(ST.status_history(log))


def test_job_state_stream(spark, fx):
    ev = fx.v_stage_metrics
    src = _source(spark, ev, n_files=1)
    stream = ST.job_state_stream(RN.read_stream(spark, src, like=ev))
    out = tempfile.mkdtemp(prefix="papyra-out-")
    RN.start(stream, _name("jobs_test"), output_mode="update", foreach_batch=RN.snapshot_writer(out)).awaitTermination()
    got = RN.latest_by_key(spark, out, ["job_id"])
    want = ST.job_state(ev, ASOF_EVENTS)
    cols = ["job_id", "step", "progress", "status"]
    assert _rows(got, cols) == _rows(want, cols)


def test_stream_dedup_equals_batch_and_a_plain_pass(spark, fx):
    """Repeats after 24 h are kept, earlier ones dropped, in both forms; a
    content seen thousands of times over months."""
    r = fx.v_stage_metrics.filter(F.col("stage") == "ocr").select("content_hash", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    base = dt.datetime(2024, 1, 1)
    hot = spark.range(3000).select(F.lit("hot").alias("content_hash"), (F.col("id") + 10_000_000).alias("event_id"),
                                   (F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 61) % 150_000)).alias("ts"))
    exact = spark.createDataFrame([("edge", 20_000_000 + k, base + dt.timedelta(hours=h)) for k, h in enumerate((0, 23.999, 24, 24, 48, 71.9))],
                                  "content_hash string, event_id bigint, ts timestamp_ntz")
    r = r.unionByName(hot).unionByName(exact)
    seen = {}
    for x in r.collect():
        seen.setdefault(x.content_hash, []).append((x.ts, x.event_id))
    want = []
    for k, own in seen.items():
        anchor = None
        for ts, i in sorted(own):
            if anchor is None or ts >= anchor + dt.timedelta(hours=24):
                anchor = ts
                want.append((k, i))
    assert ("edge", 20_000_002) in want and ("edge", 20_000_004) in want and sum(k == "hot" for k, _ in want) > 50
    batch = ST.stream_dedup(r)
    assert _rows(batch, ["content_hash", "event_id"]) == sorted(want)
    src = _shuffled(spark, r, _far(r, "content_hash", "far"))
    rows, state = _run(ST.stream_dedup(RN.read_stream(spark, src, like=r, max_files_per_trigger=1), watermark="200 days"), "dedup_test")
    assert max(state) > state[-1] and state[-1] <= 4
    assert _rows(rows.filter("content_hash <> 'far'"), ["content_hash", "event_id"]) == sorted(want)
    assert ST.stream_dedup(r.limit(0)).count() == 0


def test_next_sightings_take_one_step_a_row(spark):
    """The nearest sighting after each probe, in its run or a later one; no
    frame is built anew for every row, which is quadratic in a run."""
    rows = [(run, at, at % 3 % 2, "k", 100 * run + at, float(at)) for run, n in ((0, 7), (1, 1), (2, 5), (3, 0), (4, 3)) for at in range(n)]
    runs = spark.createDataFrame(rows, "_run long, _at long, _real int, _k string, _id long, _ts double")
    got = ST.next_sightings(runs)
    real = sorted((r[0], r[1], r[4]) for r in rows if r[2] == 1)
    want = {(r[0], r[1]): next((i for run, at, i in real if (run, at) > (r[0], r[1])), None) for r in rows if r[2] == 0}
    assert {(r._run, r._at): r._next and r._next._id for r in got.collect()} == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_inbox_stream_upserts(spark, fx):
    files = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                             F.concat(F.lit("doc_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
                             F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("received_ms"))
    src = _source(spark, files)
    stream = ST.inbox_rows(RN.read_stream(spark, src, like=files, max_files_per_trigger=2), F.col("received_ms"))
    table = tempfile.mkdtemp(prefix="papyra-tbl-")
    RN.start(stream, _name("inbox_test"), foreach_batch=ST.inbox_sink(table)).awaitTermination()
    got = spark.read.parquet(table).drop("epoch")
    cols = ["id", "status", "storage_key"]
    assert _rows(got, cols) == _rows(ST.inbox_rows(files, F.col("received_ms")), cols)
    assert os.path.isdir(table)


def test_process_queue_stream_loses_nothing(spark, fx):
    """25 queued uploads of one tenant over three micro-batches, all through K1."""
    up = K.uploads_from_documents(fx.v_labeled_documents).filter("doc_id < 25").withColumn("user_id", F.lit(1).cast("bigint"))
    queue = up.withColumn("status", F.lit("queued"))
    src = _source(spark, queue, n_files=3, order="doc_id")
    table = tempfile.mkdtemp(prefix="papyra-queue-")

    def process(q):
        return K.process_documents(q, fx.v_type_catalogue)

    stream = RN.read_stream(spark, src, like=queue, max_files_per_trigger=1)
    RN.start(stream, _name("queue_test"), foreach_batch=ST.queue_sink(table, process)).awaitTermination()
    got = spark.read.parquet(table)
    assert got.select("epoch").distinct().count() == 3
    cols = ["doc_id", "user_id", "status", "document_type_name", "typed_key"]
    assert sorted(map(repr, _rows(got, cols[:3]))) == sorted(map(repr, _rows(process(up), cols[:3])))
    assert got.count() == 25


def test_late_job_events_do_not_overwrite_newer_state(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, 5, base + dt.timedelta(minutes=m), stage, dur) for m, stage, dur in
            ((20, "classify", 90), (10, "ocr", 20), (30, "extract", 60), (5, "upload", 15))]
    files = [spark.createDataFrame([(i, *r[1:])], "event_id bigint, run_id bigint, ts timestamp_ntz, stage string, duration_ms bigint")
             for i, r in enumerate(rows)]
    path = tempfile.mkdtemp(prefix="papyra-src-")
    for i, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(path)
    for i, name in enumerate(sorted((f for f in os.listdir(path) if f.endswith(".parquet")),
                                    key=lambda f: os.path.getmtime(os.path.join(path, f)))):
        os.utime(os.path.join(path, name), (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    events = spark.read.parquet(path)
    stream = ST.job_state_stream(RN.read_stream(spark, path, like=events, max_files_per_trigger=1), watermark="2 hours")
    out = tempfile.mkdtemp(prefix="papyra-out-")
    RN.start(stream, _name("late_job_test"), output_mode="update", foreach_batch=RN.snapshot_writer(out)).awaitTermination()
    got = RN.latest_by_key(spark, out, ["job_id"]).collect()
    batch = ST.job_state(events, "2024-01-01 01:00:00").collect()
    assert [(r.job_id, r.step, r.progress, r.message) for r in got] == [(r.job_id, r.step, r.progress, r.message) for r in batch]


def test_call_rate_stream(spark, fx):
    calls = fx.v_stage_metrics.filter(F.col("provider").isNotNull()).select("provider", "ts")
    src = _source(spark, calls)
    stream = ST.call_rate(RN.read_stream(spark, src, like=calls, max_files_per_trigger=1), watermark="2 minutes")
    out = tempfile.mkdtemp(prefix="papyra-out-")
    RN.start(stream, _name("rate_test"), out, "append").awaitTermination()
    got = spark.read.parquet(out)
    w = got.agg(F.max("window_start")).first()[0]
    cols = ["window_start", "provider", "calls", "over_limit"]
    assert _rows(got, cols) == _rows(ST.call_rate(calls).filter(F.col("window_start") <= w), cols)
