"""Window-style operators (E1-E7), written so no single key lands in one task.

* E1 and E2 find the first row per content hash with a ``min`` aggregate and
  one equi-join rather than a window over the hash.
* E3 (trailing 60 s) and E6 (chunks) place rows in a total order that is
  range-partitioned (``ranks``): a provider or tenant of any size is spread
  over many tasks, and what a run needs of the runs before it is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import before_runs, index_in_group, sorted_runs


def dedup_by_content(docs: DataFrame, hash_col="content_hash", order_col="doc_id") -> DataFrame:
    """``kept`` marks the first upload (lowest ``order_col``) of each
    content hash; the others are the skipped duplicates. A row without a hash
    repeats nothing and is kept (the usable-text gate judges it). One partial
    aggregate and one equi-join."""
    first = docs.groupBy(F.col(hash_col).alias("_first_hash")).agg(F.min(order_col).alias("_first"))
    joined = docs.join(first, docs[hash_col] == F.col("_first_hash"), "left")
    kept = F.col(hash_col).isNull() | F.col(order_col).eqNullSafe(F.col("_first"))
    return joined.withColumn("kept", kept).drop("_first_hash", "_first")


def repeat_requests(requests: DataFrame, key_col="content_hash", ts_col="ts", id_col="event_id") -> DataFrame:
    """E2, on the log as it is: ``repeated`` marks every request whose content
    was asked for before (first by time, then id), with the milliseconds since
    that first request. What a content-keyed store can save is what repeats;
    no store is imitated. One partial aggregate per content and one equi-join."""
    first = requests.groupBy(F.col(key_col).alias("_k")).agg(
        F.min(F.struct(F.col(ts_col).alias("ts"), F.col(id_col).alias("id"))).alias("_first"))
    joined = requests.join(first, requests[key_col].eqNullSafe(F.col("_k")))
    since = F.unix_micros(F.col(ts_col).cast("timestamp")) - F.unix_micros(F.col("_first.ts").cast("timestamp"))
    return (joined.withColumn("repeated", F.col(id_col) != F.col("_first.id"))
            .withColumn("since_first_ms", F.floor(since / 1000).cast("bigint")).drop("_k", "_first"))


# Rate limits per provider (calls per minute, minimum spacing in ms).
RATE_LIMITS = {"ocr": (10, 3000), "model": (10, 4000)}
WINDOW_US = 60 * 1_000_000


def rate_audit(calls: DataFrame, provider_col="provider", ts_col="ts", id_col="event_id",
               limits: dict | None = None) -> DataFrame:
    """Per call, the provider's earlier calls in the trailing 60 s
    (``now - t < 60 s``, ties by id), the gap to the previous call and
    breach flags (``prev_in_window >= rpm``; gap < min spacing)."""
    limits = limits or RATE_LIMITS
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    c = calls.select(F.col(provider_col).alias("_p"), F.col(id_col).alias("_id"), us.alias("_t"))
    # a call counts +1 from its time on and -1 from 60 s later, before the calls
    # of that instant; over the whole order, providers before this one add 0
    both = c.withColumn("_n", F.lit(1)).unionByName(c.withColumns({"_t": F.col("_t") + WINDOW_US, "_n": F.lit(-1)}))
    runs = sorted_runs(both, ["_p", "_t", "_n", "_id"])
    real = F.when(F.col("_n") == 1, F.struct("_p", "_t"))
    offsets = before_runs(runs, _open=F.col("_n"))
    lasts = runs.groupBy("_run").agg(F.max_by(real, F.when(F.col("_n") == 1, F.col("_at"))).alias("_real"))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    lasts = lasts.select("_run", F.last("_real", ignorenulls=True).over(earlier).alias("_carried"))
    w = Window.partitionBy("_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    r = (runs.withColumns({"_before": F.coalesce(F.sum("_n").over(w), F.lit(0)), "_prev": F.last(real, ignorenulls=True).over(w)})
         .filter(F.col("_n") == 1).join(offsets, "_run").join(lasts, "_run"))
    prev = F.coalesce("_prev", "_carried")
    r = r.withColumn("prev_in_window", (F.col("_open") + F.col("_before")).cast("bigint"))
    prev_t = F.when(prev["_p"].eqNullSafe(F.col("_p")), prev["_t"])
    r = r.withColumn("gap_ms", F.floor((F.col("_t") - prev_t) / 1000).cast("bigint"))
    lim = F.create_map(*[F.lit(x) for p, (rpm, _) in limits.items() for x in (p, rpm)])
    dly = F.create_map(*[F.lit(x) for p, (_, d) in limits.items() for x in (p, d)])
    r = (r.withColumn("rpm_breach", F.coalesce(F.col("prev_in_window") >= F.element_at(lim, F.col("_p")), F.lit(False)))
         .withColumn("delay_breach", F.coalesce(F.col("gap_ms") < F.element_at(dly, F.col("_p")), F.lit(False)))
         .withColumn("wait_ms", F.greatest(F.lit(0), F.coalesce(F.element_at(dly, F.col("_p")) - F.col("gap_ms"), F.lit(0)))
                     .cast("bigint")))
    return r.select(F.col("_p").alias(provider_col), F.col("_id").alias(id_col), "prev_in_window", "gap_ms",
                    "rpm_breach", "delay_breach", "wait_ms")


def daily_activity(docs: DataFrame, asof: str, days: int = 14, group_cols=("user_id",)) -> DataFrame:
    """The last ``days`` calendar days ending at the as-of day, every day
    present (zero-filled): total, completed and errors per group."""
    end = F.to_date(F.lit(asof))
    d = docs.withColumn("day", F.to_date("created_at")).filter(
        (F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end))
    counts = d.groupBy(*group_cols, "day").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "error").alias("errors"))
    groups = docs.select(*group_cols).distinct()
    grid = groups.withColumn("day", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    out = grid.join(counts, [*group_cols, "day"], "left")
    return out.select(*group_cols, "day", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                            for c in ("total", "completed", "errors")])


def growth(series: DataFrame, period_col="period", value_col="value") -> DataFrame:
    """E5: percent change versus the previous period (one decimal); null for
    the first period or a zero base. The input has one row per period, so
    the ordered window is bounded by the number of periods."""
    w = Window.orderBy(period_col)
    prev = F.lag(value_col).over(w)
    return series.withColumn("previous", prev).withColumn(
        "growth_pct", F.when(F.col("previous") > 0, F.round((F.col(value_col) - F.col("previous"))
                                                            / F.col("previous") * 100, 1)))


def chunk_items(items: DataFrame, n: int, group_cols, order: tuple[Column, ...]) -> DataFrame:
    """Chunk number ``floor((row_number - 1) / n)`` within each group, in
    an order that must be total; a group of any size is spread over tasks."""
    return index_in_group(items, list(group_cols), list(order), "_index").withColumn(
        "chunk", F.floor(F.col("_index") / n).cast("bigint")).drop("_index")


def roll_period(users: DataFrame, subs: DataFrame, now: str) -> DataFrame:
    """Missing subscription → a free plan row starting now; an expired
    period (now > end, strict) restarts at now for one calendar month with
    usage 0; others unchanged."""
    n = F.lit(now).cast("timestamp_ntz")
    j = users.join(subs, "user_id", "left")
    missing = F.col("plan").isNull()
    expired = ~missing & F.coalesce(n > F.col("period_end"), F.lit(False))
    reset = missing | expired
    return j.select(
        "user_id",
        F.coalesce(F.col("plan"), F.lit("free")).alias("plan"),
        F.when(reset, F.lit(0)).otherwise(F.col("docs_used_this_period")).cast("int").alias("docs_used_this_period"),
        F.when(reset, n).otherwise(F.col("period_start")).alias("period_start"),
        F.when(reset, n + F.expr("INTERVAL 1 MONTH")).otherwise(F.col("period_end")).alias("period_end"),
        F.when(missing, "created").when(expired, "reset").otherwise("unchanged").alias("action"))
