"""Structured Streaming flows.

Each flow is a transformation that works on a static DataFrame (the batch
form, used by the oracle) and on a streaming one (same plan under a
watermark). Folds of state are written as per-field "last writer wins"
aggregates (``max_by`` over (ts, id)): exact for handlers that overwrite
fields, partial-aggregation friendly, and valid in streaming update mode.
Where a flow needs real per-key state it has timers and an end
(``stateful``: I3, I5, I6, I9; ``applyInPandasWithState``: I8).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import inbox_key
from ..operators.ranks import sorted_runs
from ..session import cut_lineage
from . import stateful as SF

# Document status carried by each kind of logged event.
EVENT_STATUS = {"click": "queued", "view": "processing", "signup": "completed",
                "purchase": "pending_confirmation", "error": "error"}


def with_watermark(df: DataFrame, delay: str | None, ts="ts") -> DataFrame:
    """Event-time watermark (the event time must be a TIMESTAMP; the
    tables store TIMESTAMP_NTZ, read as UTC)."""
    if not delay:
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def event_status(event_type="event_type") -> Column:
    m = F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv])
    return F.element_at(m, F.col(event_type))


# ---------------------------------------------------------------- I1

def inbox_rows(files: DataFrame, received_ms) -> DataFrame:
    """New inbox files become queued document rows with the inbox key."""
    return files.select("id", "user_id", "filename", F.lit("queued").alias("status"),
                        inbox_key("user_id", received_ms, "filename").alias("storage_key"))


def inbox_sink(table_path: str):
    """foreachBatch writer: each micro-batch lands in its own epoch folder
    (overwrite), so a retried epoch is written exactly once; readers apply
    the A4 upsert over the folders."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch_id}")
    return write


# ---------------------------------------------------------------- I2

def status_counts(status_log: DataFrame, window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Documents per status per event-time window."""
    s = with_watermark(status_log, watermark)
    g = s.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "n")


# ---------------------------------------------------------------- I3

def stream_dedup(items: DataFrame, key="content_hash", delay: str = "24 hours", watermark: str = "1 hour") -> DataFrame:
    """(key, event_id, ts) of the sightings that are kept: the first of
    each content, then always the next one ``delay`` or more after the last
    kept one. As a stream, events wait for the watermark and the kept
    sighting stays as state for ``delay``; both forms give the same rows."""
    rows = items.select(F.col(key).alias("content_hash"), "event_id", "ts")
    if items.isStreaming:
        s = with_watermark(rows, watermark)
        kept = SF.run_stateful(s, ["content_hash"], SF.Anchors(SF.duration_us(delay)),
                               f"content_hash {rows.schema['content_hash'].dataType.simpleString()}, event_id bigint, ts timestamp")
    else:
        kept = kept_sightings(rows, SF.duration_us(delay))
    return kept.withColumnRenamed("content_hash", key)


def next_sightings(runs: DataFrame) -> DataFrame:
    """The probes of ``runs`` (sorted_runs of sightings and probes) with ``_next``,
    the nearest sighting after each. Runs are read backwards, so that each frame
    goes on from the one before and a run of n rows takes n steps."""
    mark = F.when(F.col("_real") == 1, F.struct("_k", "_id", "_ts"))
    after = Window.partitionBy("_run").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = runs.groupBy("_run").agg(F.min_by(mark, F.when(F.col("_real") == 1, F.col("_at"))).alias("_head"))
    later = Window.orderBy(F.col("_run").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    heads = heads.select("_run", F.last("_head", ignorenulls=True).over(later).alias("_carried"))
    return (runs.withColumn("_next", F.last(mark, ignorenulls=True).over(after)).filter("_real = 0").join(heads, "_run")
            .withColumn("_next", F.coalesce("_next", "_carried")))


def kept_sightings(rows: DataFrame, delay_us: int) -> DataFrame:
    """I3 batch form without a sequential pass over a content's sightings:
    each sighting points to the first one ``delay_us`` or more later (one pass
    over a range-partitioned order), and what the first sighting reaches is
    marked with jumps that double, so a content seen n times takes log n
    joins on single rows."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = rows.select(F.col("content_hash").alias("_k"), us.alias("_t"), F.col("event_id").alias("_id"), F.col("ts").alias("_ts"))
    spans = e.groupBy(F.col("_k").alias("_sk")).agg(F.min(F.struct("_t", "_id", "_ts")).alias("_f"), (F.max("_t") - F.min("_t")).alias("_span"))
    firsts = spans.select(F.col("_sk").alias("content_hash"), "_f._id", "_f._ts", "_span")
    out = firsts.select("content_hash", F.col("_id").alias("event_id"), F.col("_ts").alias("ts"))
    long_ = e.join(spans.filter(F.col("_span") >= delay_us).select("_sk"), F.col("_k").eqNullSafe(F.col("_sk")), "left_semi")
    # a sighting (1) and, delay later, its probe (0), which comes before the sightings of that instant
    both = long_.withColumn("_real", F.lit(1)).unionByName(long_.withColumns({"_t": F.col("_t") + delay_us, "_real": F.lit(0)}))
    runs = sorted_runs(both, ["_k", "_t", "_real", "_id"])
    probes = next_sightings(runs)
    same = F.col("_next._k").eqNullSafe(F.col("_k"))
    jumps = cut_lineage(probes.filter(same).select(F.struct("_k", "_id").alias("_from"), F.struct("_next._k", "_next._id").alias("_to"),
                                                   F.col("_next._ts").alias("_to_ts")))
    start = firsts.filter(F.col("_span") >= delay_us).select(F.struct(F.col("content_hash").alias("_k"), "_id").alias("_at"), F.col("_ts"))
    reached, step = cut_lineage(start), jumps
    while step.limit(1).count():
        more = reached.join(step, reached["_at"] == step["_from"]).select(F.col("_to").alias("_at"), F.col("_to_ts").alias("_ts"))
        reached = cut_lineage(reached.unionByName(more))
        again = step.select(F.col("_from").alias("_f2"), F.col("_to").alias("_t2"), F.col("_to_ts").alias("_ts2"))
        step = cut_lineage(step.join(again, step["_to"] == again["_f2"]).select("_from", F.col("_t2").alias("_to"), F.col("_ts2").alias("_to_ts")))
    rest = reached.join(start.select("_at"), "_at", "left_anti")
    return out.unionByName(rest.select(F.col("_at._k").alias("content_hash"), F.col("_at._id").alias("event_id"), F.col("_ts").alias("ts")))


# ---------------------------------------------------------------- I4

def process_queue_batch(batch: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """I4 per micro-batch: every queued upload goes through ``process`` (K1
    with its catalogue); a row that fails is an error row there and never
    fails the batch. A micro-batch is bounded by the source's trigger options,
    not by leaving rows out: what the stream has consumed is processed."""
    return process(batch.filter(F.col("status") == "queued").drop("status"))


def queue_sink(table_path: str, process: Callable[[DataFrame], DataFrame]):
    """I4 ``foreachBatch`` writer: the results of each micro-batch land in the
    epoch's own folder, so a retried epoch is written once."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        process_queue_batch(batch, process).write.mode("overwrite").parquet(f"{table_path}/epoch={epoch_id}")
    return write


# ---------------------------------------------------------------- I5

def usage_counter(successes: DataFrame, watermark: str | None = None) -> DataFrame:
    """+1 per successful document per user and calendar month."""
    s = with_watermark(successes, watermark)
    return s.groupBy("user_id", F.date_trunc("month", "ts").alias("period")).agg(
        F.count(F.lit(1)).alias("docs_used"))


def usage_counter_stream(successes: DataFrame, watermark: str = "1 day") -> DataFrame:
    """I5 streaming form that ends: one row per (user, month) when the
    watermark has passed the month, after which the key is gone; later events
    of that month are dropped by the watermark. Appended rows are final, so the
    stored totals take them as they are."""
    s = with_watermark(successes, watermark).select("user_id", F.date_trunc("month", "ts").alias("period"), "ts", F.lit(1).alias("n"))
    kind = successes.schema["user_id"].dataType.simpleString()
    return SF.run_stateful(s, ["user_id", "period"], SF.MonthCounts(), f"user_id {kind}, period timestamp, docs_used bigint")


# ---------------------------------------------------------------- I6

PRICE_PLANS = {"price_starter": "starter", "price_pro": "pro"}
CHECKOUT_DAYS = 30


def billing_changes(events: DataFrame) -> DataFrame:
    """Per event, the fields it writes (null = not written). A checkout names
    its target plan; an update carries the plan's price and its period."""
    et = F.col("event_type")
    price_plan = F.element_at(F.create_map(*[F.lit(x) for kv in PRICE_PLANS.items() for x in kv]), F.col("price_id"))
    chk, upd = et == "checkout.session.completed", et == "customer.subscription.updated"
    dele, fail = et == "customer.subscription.deleted", et == "invoice.payment_failed"
    return events.select(
        "customer_ref", "ts", "event_id",
        F.when(chk, F.coalesce("target_plan", F.lit("starter"))).when(upd, price_plan).when(dele, F.lit("free"))
        .alias("w_plan"),
        F.when(chk | dele, F.lit(True)).when(upd, F.col("status").isin("active", "trialing"))
        .when(fail, F.lit(False)).alias("w_active"),
        F.when(chk, F.lit(0)).alias("w_used"),
        F.when(chk, F.col("ts")).when(upd, F.col("period_start")).alias("w_start"),
        F.when(chk, F.col("ts") + F.expr(f"INTERVAL {CHECKOUT_DAYS} DAYS")).when(upd, F.col("period_end")).alias("w_end"),
        F.when(chk, F.lit(True)).when(dele, F.lit(False)).alias("w_has_sub"))


def _last(col: str) -> Column:
    order = F.struct("ts", "event_id")
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), order))


def billing_fold(events: DataFrame, subs: DataFrame) -> DataFrame:
    """Subscription state after the billing events. Events of unknown
    customers are ignored; each field takes the value of the last event
    that writes it (ties by event id), else keeps the stored value."""
    known = events.join(subs.select("customer_ref"), "customer_ref", "left_semi")
    last = billing_changes(known).groupBy("customer_ref").agg(
        *[_last(c).alias(c) for c in ("w_plan", "w_active", "w_used", "w_start", "w_end", "w_has_sub")])
    j = subs.join(last, "customer_ref", "left")
    return j.select("user_id", "customer_ref",
                    F.coalesce("w_plan", "plan").alias("plan"),
                    F.coalesce("w_active", "active").alias("active"),
                    F.coalesce("w_used", "docs_used_this_period").cast("int").alias("docs_used_this_period"),
                    F.coalesce("w_start", "period_start").alias("period_start"),
                    F.coalesce("w_end", "period_end").alias("period_end"),
                    F.coalesce("w_has_sub", F.lit(False)).alias("has_subscription"))


FOLD_FIELDS = {"w_plan": "string", "w_active": "boolean", "w_used": "int", "w_start": "bigint", "w_end": "bigint", "w_has_sub": "boolean"}


def billing_fold_stream(events: DataFrame, watermark: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """I6 streaming form: what a customer's events wrote, emitted when the
    customer has been quiet for ``keep`` of event time, after which its state
    is gone. Rows hold each field with the (time, id) of its event, so
    ``merge_folds`` over stored and new rows is the whole fold in any order."""
    changes = billing_changes(with_watermark(events, watermark))
    for c in ("w_start", "w_end"):
        changes = changes.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")))
    schema = "customer_ref string, " + ", ".join(f"{c} {t}, {c}_us bigint, {c}_id bigint" for c, t in FOLD_FIELDS.items())
    return SF.run_stateful(changes, ["customer_ref"], SF.LastWriters(FOLD_FIELDS, SF.duration_us(keep)), schema)


def folded(rows: DataFrame) -> DataFrame:
    """Per customer the fields of all emitted folds, as ``billing_fold`` reads them."""
    merged = SF.merge_folds(rows, list(FOLD_FIELDS))
    times = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("w_start", "w_end")}
    return merged.withColumns(times).select("customer_ref", *FOLD_FIELDS)


# ---------------------------------------------------------------- I7

def call_rate(calls: DataFrame, limit: int = 10, window: str = "60 seconds", slide: str = "10 seconds",
              watermark: str | None = None) -> DataFrame:
    """Calls per provider in sliding 60 s windows, flagged over the limit."""
    c = with_watermark(calls, watermark)
    g = c.groupBy(F.window("ts", window, slide).alias("w"), "provider").agg(F.count(F.lit(1)).alias("calls"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "provider",
                    "calls", (F.col("calls") > limit).alias("over_limit"))


# ---------------------------------------------------------------- I8

JOB_TTL_US = 3600 * 1_000_000


def job_updates(events: DataFrame) -> DataFrame:
    """Job-store writes from stage events: a stage update sets step,
    progress (clamped 0..100) and message; 'save' completes the job (even
    duration) or fails it (odd)."""
    is_save = F.col("stage") == "save"
    ok = is_save & (F.col("duration_ms") % 2 == 0)
    fail = is_save & (F.col("duration_ms") % 2 == 1)
    raw_progress = (F.col("duration_ms") % 130 - 10).cast("int")
    return events.select(
        F.col("run_id").alias("job_id"), "ts", "event_id",
        F.when(~is_save, F.col("stage")).when(ok, F.lit("done")).alias("w_step"),
        F.when(~is_save, F.least(F.lit(100), F.greatest(F.lit(0), raw_progress)))
        .when(ok, F.lit(100)).when(fail, F.lit(0)).alias("w_progress"),
        F.when(~is_save, F.concat(F.lit("Paso "), F.col("stage"))).when(ok, F.lit("Completado"))
        .when(fail, F.lit("Error")).alias("w_message"),
        F.when(ok, F.lit("completed")).when(fail, F.lit("failed")).alias("w_status"),
        F.when(is_save, F.col("ts")).alias("w_completed_at"))


def job_state(events: DataFrame, asof: str) -> DataFrame:
    """I8 batch form: latest state per job and whether a finished job has
    expired (finished more than 1 h before ``asof``)."""
    u = job_updates(events).groupBy("job_id").agg(
        *[_last(c).alias(c) for c in ("w_step", "w_progress", "w_message", "w_status", "w_completed_at")])
    now_us = F.unix_micros(F.lit(asof).cast("timestamp"))
    done_us = F.unix_micros(F.col("w_completed_at").cast("timestamp"))
    return u.select("job_id", F.coalesce("w_step", F.lit("queued")).alias("step"),
                    F.coalesce("w_progress", F.lit(0)).alias("progress"),
                    F.coalesce("w_message", F.lit("En cola...")).alias("message"),
                    F.coalesce("w_status", F.lit("processing")).alias("status"),
                    F.col("w_completed_at").alias("completed_at"),
                    F.coalesce(now_us - done_us > JOB_TTL_US, F.lit(False)).alias("expired"))


JOB_FIELDS = ("w_step", "w_progress", "w_message", "w_status", "w_completed_at")
# the fields, then the event (time, id) that wrote each of them
JOB_STATE_SCHEMA = ("step string, progress int, message string, status string, completed_at timestamp, "
                    + ", ".join(f"ts{i} timestamp, id{i} bigint" for i in range(len(JOB_FIELDS))))
JOB_OUT_SCHEMA = ("job_id bigint, step string, progress int, message string, status string, "
                  "completed_at timestamp, expired boolean")
# The state of a job before its first event.
JOB_START = ("queued", 0, "En cola...", "processing", None)


def _job_state_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (job_id,) = key
    n = len(JOB_FIELDS)
    if state.hasTimedOut:
        st = state.get
        state.remove()
        yield _job_row(job_id, st, True)
        return
    st = list(state.get) if state.exists else [*JOB_START, *[None] * (2 * n)]
    rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
    for i, c in enumerate(JOB_FIELDS):
        wrote = rows[rows[c].notna()]
        if not len(wrote):
            continue
        last = wrote.iloc[-1]
        ts, event_id = last["ts"], int(last["event_id"])
        if st[n + 2 * i] is None or (ts, event_id) > (pd.Timestamp(st[n + 2 * i]), st[n + 2 * i + 1]):
            st[i] = int(last[c]) if c == "w_progress" else last[c]
            st[n + 2 * i], st[n + 2 * i + 1] = ts, event_id
    state.update(tuple(st))
    if st[4] is not None:
        state.setTimeoutTimestamp(max(int(pd.Timestamp(st[4]).timestamp() * 1000) + JOB_TTL_US // 1000,
                                      state.getCurrentWatermarkMs() + 1))
    yield _job_row(job_id, st, False)


def _job_row(job_id, st, expired: bool) -> pd.DataFrame:
    return pd.DataFrame([{"job_id": job_id, "step": st[0], "progress": st[1], "message": st[2], "status": st[3],
                          "completed_at": st[4], "expired": expired}])


def job_state_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """I8 streaming form: per-job state; a finished job is emitted once more
    as expired when the watermark passes completion + 1 h, then dropped."""
    u = job_updates(events.withColumn("ts", F.col("ts").cast("timestamp")))
    return (u.withWatermark("ts", watermark).groupBy("job_id")
            .applyInPandasWithState(_job_state_fn, JOB_OUT_SCHEMA, JOB_STATE_SCHEMA, "update",
                                    GroupStateTimeout.EventTimeTimeout))


# ---------------------------------------------------------------- I9

# Allowed status transitions (any status may go back to processing).
ALLOWED_TRANSITIONS = [("queued", "processing"), ("processing", "completed"),
                       ("processing", "pending_confirmation"), ("processing", "error"),
                       ("pending_confirmation", "completed"), ("pending_confirmation", "deleted")]


def _allowed(prev: Column, cur: Column) -> Column:
    ok = prev.isNull() | (cur == "processing")
    for a, b in ALLOWED_TRANSITIONS:
        ok = ok | ((prev == a) & (cur == b))
    return ok


def status_history(log: DataFrame, doc_col="doc_id") -> DataFrame:
    """I9 batch form: each status change with the previous status of the
    same document and whether the transition is allowed. The window is per
    document (a document's life is a handful of events)."""
    w = Window.partitionBy(doc_col).orderBy("ts", "event_id")
    s = log.withColumn("prev_status", F.lag("status").over(w))
    return s.select(doc_col, "event_id", "prev_status", "status",
                    _allowed(F.col("prev_status"), F.col("status")).alias("valid"))


def status_history_stream(log: DataFrame, watermark: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """I9 streaming form: events wait until the watermark has passed them and
    are released in event order, so files that come in any order give the
    batch rows (events later than the watermark are dropped by it). A document
    without an event for ``keep`` leaves the state; its next event, if any,
    has no previous status."""
    s = with_watermark(log.select("doc_id", "event_id", "ts", "status"), watermark)
    out = SF.run_stateful(s, ["doc_id"], SF.History(SF.duration_us(keep)), "doc_id bigint, event_id bigint, prev_status string, status string")
    return out.withColumn("valid", _allowed(F.col("prev_status"), F.col("status")))
