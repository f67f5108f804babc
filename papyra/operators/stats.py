"""Aggregations.

Every aggregate is a plain ``groupBy().agg()`` so Spark runs a partial
(map-side) aggregation before the shuffle; nothing collects a tenant's rows.
Lists that the original returns are produced in long form or capped by
construction (a run has a handful of stages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import display_fields, js_round, normalize_field_type, parse_extracted
from ..functions.text import estimate_size


def _cnt(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def batch_status(requests: DataFrame, docs: DataFrame, batch_cols=("user_id",)) -> DataFrame:
    """For the requested ids of a tenant: found, completed, processing,
    pending, errors; all_done = nothing processing (queued counts nowhere)."""
    found = docs.join(requests.select("id", "user_id"), ["id", "user_id"], "left_semi")
    s = F.col("status")
    return found.groupBy(*batch_cols).agg(
        F.count(F.lit(1)).alias("total"), _cnt(s == "completed").alias("completed"),
        _cnt(s == "processing").alias("processing"), _cnt(s == "pending_confirmation").alias("pending"),
        _cnt(s == "error").alias("errors")).withColumn("all_done", F.col("processing") == 0)


def status_stats(docs: DataFrame, group_cols=("user_id",)) -> DataFrame:
    """Counts by status."""
    s = F.col("status")
    return docs.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"), _cnt(s == "completed").alias("completed"),
        _cnt(s == "processing").alias("processing"), _cnt(s == "error").alias("error"),
        _cnt(s == "pending_confirmation").alias("pending"))


def docs_per_type(docs: DataFrame) -> DataFrame:
    """D3: documents per (tenant, type); the null type is its own group."""
    return docs.groupBy("user_id", "document_type_id").agg(F.count(F.lit(1)).alias("doc_count"))


def field_sum(fields: DataFrame, name: str, group_cols=("user_id",)) -> DataFrame:
    """Sum / avg / count of a numeric field; values that do not cast are null."""
    v = F.expr("try_cast(field_value AS DECIMAL(38,6))")
    f = fields.filter(F.col("field_name") == name).withColumn("_v", v)
    out = f.groupBy(*group_cols).agg(F.sum("_v").alias("_s"), F.count("_v").alias("value_count"))
    return out.select(*group_cols, F.col("_s").cast("double").alias("value_sum"),
                      F.round(F.col("_s").cast("double") / F.col("value_count"), 6).alias("value_avg"),
                      "value_count")


DEFAULT_INFERRED = "Documento Desconocido"


def inferred_types(docs: DataFrame, key_col="inferred_type", default=DEFAULT_INFERRED) -> DataFrame:
    """Pending documents grouped by inferred type: count and the schema
    of the first (lowest id) document. Members are the input rows with the
    group key (long form), not a collected list."""
    p = docs.filter(F.col("status") == "pending_confirmation").withColumn(
        "group_name", F.coalesce(F.nullif(F.col(key_col), F.lit("")), F.lit(default)))
    return p.groupBy("user_id", "group_name").agg(
        F.count(F.lit(1)).alias("doc_count"), F.min("id").alias("first_doc_id"),
        F.min_by("extracted_data", "id").alias("_schema_json"))


def schema_names(json_col: str) -> Column:
    """Comma-joined field names of a stored extraction (fields or key_fields)."""
    return F.array_join(F.transform(display_fields(parse_extracted(json_col)), lambda f: f.getField("name")), ",")


DEFAULT_GROUP = "Desconocido"


def group_by_inferred(items: DataFrame, cls_col="cls_inferred", data_col="data_inferred",
                      default=DEFAULT_GROUP) -> DataFrame:
    """Group key = classification's inferred type, else the inferred
    data's, else 'Desconocido' ('' falls through as with ``||``)."""
    key = F.coalesce(F.nullif(F.col(cls_col), F.lit("")), F.nullif(F.col(data_col), F.lit("")), F.lit(default))
    return items.withColumn("group_key", key)


MAX_SCHEMA_FIELDS = 30
REQUIRED_SHARE = 0.5


def consolidate_schema(fields: DataFrame, group_col="type_name", doc_col="doc_id",
                       max_fields: int | None = MAX_SCHEMA_FIELDS) -> DataFrame:
    """One schema per type (``group_col``: one column or several, such as
    tenant and type name, so that no tenant's fields shape another's type).
    frequency = documents having the field / documents of the type; required
    when >= 0.5; the type is the most common normalised type (ties →
    alphabetical); at most ``max_fields`` fields (None: all) by frequency then
    name. Duplicates inside a document count once."""
    g = [group_col] if isinstance(group_col, str) else list(group_col)
    # one aggregate over the field table; everything else derives from it
    base = fields.groupBy(*g, "name", doc_col, normalize_field_type("type").alias("_t")).agg(
        F.count(F.lit(1)).alias("_c"))
    n_docs = base.groupBy(*g).agg(F.countDistinct(doc_col).alias("_n"))
    having = base.groupBy(*g, "name").agg(F.countDistinct(doc_col).alias("_have"))
    tcount = base.groupBy(*g, "name", "_t").agg(F.sum("_c").alias("_tc"))
    best_t = tcount.groupBy(*g, "name").agg(
        F.min(F.struct((-F.col("_tc")).alias("neg"), F.col("_t").alias("t"))).alias("_b"))
    out = (having.join(best_t, [*g, "name"]).join(n_docs, g)
           .select(*g, "name", F.col("_b.t").alias("type"),
                   F.round(F.col("_have") / F.col("_n"), 6).alias("frequency"),
                   (F.col("_have") / F.col("_n") >= REQUIRED_SHARE).alias("required")))
    w = Window.partitionBy(*g).orderBy(F.col("frequency").desc(), F.col("name").asc())
    out = out.withColumn("position", F.row_number().over(w))
    return out if max_fields is None else out.filter(F.col("position") <= max_fields)


def inference_report(fields: DataFrame, types: DataFrame) -> DataFrame:
    """Per tenant and type its id (null while it has none), the fields
    found and the documents sampled, and one row of totals over all (tenant and
    type null). A type of the same name belongs to another tenant's row."""
    counted = fields.groupingSets([["user_id", "type_name"], []], "user_id", "type_name").agg(
        F.countDistinct("name").alias("field_count"), F.countDistinct("doc_id").alias("sample_count"))
    ids = types.groupBy("user_id", F.col("name").alias("type_name")).agg(F.min("id").alias("type_id"))
    return counted.join(ids, ["user_id", "type_name"], "left")


def populated_fields(docs: DataFrame, json_col="extracted_data") -> DataFrame:
    """Non-null, non-empty values per document; low confidence when none."""
    fs = display_fields(parse_extracted(json_col))
    n = F.size(F.filter(fs, lambda f: f.getField("value").isNotNull() & (f.getField("value") != "")))
    return docs.withColumn("populated", n.cast("bigint")).withColumn("low_confidence", F.col("populated") == 0)


def run_metrics(stages: DataFrame) -> DataFrame:
    """Per run the wall time (first start to the end of the stage that
    ends last), cost (null as 0), ordered stage list and whether OCR was
    skipped (cache hit). A run is a handful of stages."""
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    end_us = ts_us + F.coalesce(F.col("duration_ms"), F.lit(0)) * 1000
    return stages.groupBy("run_id").agg(
        F.floor((F.max(end_us) - F.min(ts_us)) / 1000).cast("bigint").alias("total_duration_ms"),
        F.round(F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))), 9).alias("total_cost_usd"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "stage"))),
                                 lambda s: s.getField("stage")), ",").alias("stages"),
        (~F.max(F.col("stage") == "ocr")).alias("cache_hit"))


def usage_mismatch(usage: DataFrame) -> DataFrame:
    """Stored counter vs recount; the corrected counter is the recount."""
    return usage.select("user_id", F.col("docs_used_this_period").alias("stored"),
                        F.col("docs_in_period").alias("recounted"),
                        (F.col("docs_used_this_period") != F.col("docs_in_period")).alias("mismatch"),
                        F.col("docs_in_period").alias("corrected"))


def success_rate(completed, total) -> Column:
    """Round-half-up(completed/total*1000)/10; 0 when empty."""
    t = F.col(total) if isinstance(total, str) else total
    c = F.col(completed) if isinstance(completed, str) else completed
    return F.when(t > 0, js_round(c.cast("double") / t * 1000) / 10).otherwise(F.lit(0.0))


STORAGE_QUOTA_BYTES = 5 * 1024 ** 3


def storage_usage(docs: DataFrame, group_cols=("user_id",)) -> DataFrame:
    """Estimated bytes and percent of the 5 GiB quota (capped at 100)."""
    out = docs.groupBy(*group_cols).agg(F.round(F.sum(estimate_size("filename")), 3).alias("est_bytes"))
    return out.withColumn("percent", F.round(F.least(F.col("est_bytes") / STORAGE_QUOTA_BYTES * 100, F.lit(100.0)), 6))


def mrr_by_plan(subs: DataFrame, plans: DataFrame) -> DataFrame:
    """Active subscribers x price per plan, with a grand total (rollup)."""
    j = subs.filter(F.col("active")).join(F.broadcast(plans.select("plan", "price")), "plan", "left")
    return j.rollup("plan").agg(F.count(F.lit(1)).alias("subscribers"),
                                F.sum("price").cast("bigint").alias("mrr"))


def docs_by_period(events: DataFrame, asof: str, ts_col="ts", key="run_id", cost="cost_usd") -> DataFrame:
    """Documents and cost today / this week / this month as of ``asof``.
    One scan: each run's events are reduced to its flags and costs, then the
    runs are counted."""
    a = F.to_timestamp(F.lit(asof)).cast("timestamp_ntz")
    units = {"today": "day", "this_week": "week", "this_month": "month"}
    inside = {p: (F.col(ts_col) >= F.date_trunc(u, a).cast("timestamp_ntz")) for p, u in units.items()}
    any_of = inside["today"] | inside["this_week"] | inside["this_month"]
    e = events.filter((F.col(ts_col) < a + F.expr("INTERVAL 1 DAY")) & any_of)
    runs = e.groupBy(key).agg(*[F.max(c).alias(f"_in_{p}") for p, c in inside.items()],
                              *[F.sum(F.when(c, F.col(cost))).alias(f"_cost_{p}") for p, c in inside.items()])
    total = runs.agg(*[F.count_if(f"_in_{p}").alias(f"_n_{p}") for p in units],
                     *[F.round(F.coalesce(F.sum(f"_cost_{p}"), F.lit(0.0)), 9).alias(f"_c_{p}") for p in units])
    rows = F.array(*[F.struct(F.col(f"_n_{p}").alias("documents"), F.col(f"_c_{p}").alias("cost_usd"),
                              F.lit(p).alias("period")) for p in units])
    return total.select(F.explode(rows).alias("r")).select("r.*")


def cost_by_provider_day(events: DataFrame, providers=("ocr", "model")) -> DataFrame:
    """Per day documents, cost per provider and total, in one aggregate."""
    e = events.withColumn("day", F.to_date("ts")).withColumn("_p", F.coalesce(F.col("provider"), F.lit("other")))
    names = [*providers, "other"]
    out = e.groupBy("day").agg(F.countDistinct("run_id").alias("documents"), *[
        F.round(F.coalesce(F.sum(F.when(F.col("_p") == p, F.col("cost_usd"))), F.lit(0.0)), 9).alias(f"{p}_cost") for p in names])
    return out.withColumn("total_cost", F.round(sum(F.col(f"{p}_cost") for p in names), 9))


def rate_text(num, den, decimals=1, suffix="%") -> Column:
    return F.when(den > 0, F.concat(F.format_string(f"%.{decimals}f", num / den * (100 if suffix == "%" else 1)),
                                    F.lit(suffix))).otherwise(F.lit("N/A"))


def repeat_rate(flags: DataFrame, group_cols=()) -> DataFrame:
    """Repeated and first requests, and the share of repeats to one
    decimal or 'N/A'."""
    out = flags.groupBy(*group_cols).agg(_cnt(F.col("repeated")).alias("repeats"),
                                         _cnt(~F.col("repeated")).alias("first_requests"))
    return out.withColumn("repeat_rate", rate_text(F.col("repeats"), F.col("repeats") + F.col("first_requests")))


def call_spacing(calls: DataFrame, group_cols=("provider",)) -> DataFrame:
    """D18, on the audited log: calls, calls closer than the provider's
    spacing, by how many milliseconds in all and on average ('N/A' without
    calls)."""
    out = calls.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("calls"), _cnt(F.col("delay_breach")).alias("too_close"),
                                         F.sum("wait_ms").cast("bigint").alias("short_ms"))
    avg = F.when(F.col("calls") > 0, F.concat(
        F.format_string("%.0f", F.col("short_ms") / F.col("calls")), F.lit("ms"))).otherwise("N/A")
    return out.withColumn("avg_short", avg)


def batch_summary(results: DataFrame, group_cols=("user_id",)) -> DataFrame:
    """Total, processed, pending and errors of a batch's results."""
    s = F.col("status")
    return results.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"), _cnt(s == "completed").alias("processed"),
        _cnt(s == "pending_confirmation").alias("pending"), _cnt(s == "error").alias("errors"))


def quota_check(subs_limits: DataFrame, type_counts: DataFrame) -> DataFrame:
    """Document quota (used >= limit, -1 unlimited) and type quota."""
    j = subs_limits.join(type_counts, "user_id", "left").withColumn(
        "type_count", F.coalesce(F.col("type_count"), F.lit(0)).cast("bigint"))
    return j.select(
        "user_id", "plan", "docs_used_this_period", "docs_per_month", "type_count", "doc_types_max",
        ((F.col("docs_per_month") != -1) & (F.col("docs_used_this_period") >= F.col("docs_per_month")))
        .alias("doc_denied"),
        ((F.col("doc_types_max") != -1) & (F.col("type_count") >= F.col("doc_types_max"))).alias("type_denied"))


def chat_counts(docs_typed: DataFrame) -> DataFrame:
    """The suggested questions per tenant: documents, completed, type
    names in use, newest document."""
    return docs_typed.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("documents"), _cnt(F.col("status") == "completed").alias("completed"),
        F.countDistinct("document_type_name").alias("types_in_use"),
        F.max_by("filename", F.struct("created_at", "id")).alias("newest_filename"))
