"""Registered queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import stage_cost
from ..operators import matching as M
from ..operators import stats as S
from ..schemas import PLAN_VALUES_SQL, plan_limits_df
from ..sources.fixtures import ASOF_EVENTS, ASOF_ORDERS
from .registry import query

TOK_SQL = "CASE WHEN {c} IS NULL OR {c} = 0 THEN 0 ELSE CAST(ceil({c} / 4) AS BIGINT) END"
STAGE_COST_SQL = f"""CAST(CASE WHEN provider = 'ocr' AND pages IS NOT NULL AND pages <> 0 THEN pages * 0.001
  WHEN provider = 'vision' OR coalesce(is_vision, false) THEN 0.002
  ELSE {TOK_SQL.format(c='input_chars')} / 1000000 * 0.075 + {TOK_SQL.format(c='output_chars')} / 1000000 * 0.30 END AS DOUBLE)"""
STAGES_SQL = f"SELECT *, {STAGE_COST_SQL} AS cost_usd FROM v_stage_metrics"


def stages_with_cost(fx):
    s = fx.v_stage_metrics
    return s.withColumn("cost_usd", stage_cost("provider", "pages", "is_vision", "input_chars", "output_chars"))


@query("batch_status", """
WITH req AS (SELECT id, user_id FROM v_documents UNION ALL SELECT id, user_id + 1 FROM v_documents),
f AS (SELECT d.* FROM v_documents d WHERE EXISTS (SELECT 1 FROM req r WHERE r.id = d.id AND r.user_id = d.user_id))
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'pending_confirmation') AS pending,
  count(*) FILTER (WHERE status = 'error') AS errors,
  count(*) FILTER (WHERE status = 'processing') = 0 AS all_done
FROM f GROUP BY user_id""")
def q_batch_status(fx):
    """Each tenant polls all its ids plus ids of another tenant."""
    d = fx.v_documents
    req = d.select("id", "user_id").unionByName(d.select("id", (F.col("user_id") + 1).alias("user_id")))
    return S.batch_status(req, d)


@query("status_stats", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'error') AS error,
  count(*) FILTER (WHERE status = 'pending_confirmation') AS pending
FROM v_documents GROUP BY user_id""")
def q_status_stats(fx):
    """Document counts by status per tenant."""
    return S.status_stats(fx.v_documents)


@query("docs_per_type", """
SELECT user_id, document_type_id, count(*) AS doc_count FROM v_documents GROUP BY 1, 2""")
def q_docs_per_type(fx):
    """D3: documents per (tenant, type), the null type kept."""
    return S.docs_per_type(fx.v_documents)


@query("field_sum", """
WITH f AS (SELECT d.user_id, x.f.name AS field_name, x.f.value AS field_value
  FROM v_documents d, (SELECT id, unnest(from_json(coalesce(json_extract(extracted_data, '$.fields'),
      json_extract(extracted_data, '$.key_fields')), '[{"name":"VARCHAR","value":"VARCHAR"}]')) AS f FROM v_documents) x
  WHERE d.id = x.id),
v AS (SELECT user_id, TRY_CAST(field_value AS DECIMAL(38,6)) AS v FROM f WHERE field_name = 'total')
SELECT user_id, CAST(sum(v) AS DOUBLE) AS value_sum, round(CAST(sum(v) AS DOUBLE) / count(v), 6) AS value_avg,
  count(v) AS value_count FROM v GROUP BY user_id""")
def q_field_sum(fx):
    """sum/avg/count of field 'total' per tenant."""
    d = fx.v_documents
    f = M.field_access(d).join(d.select("id", "user_id"), "id")
    return S.field_sum(f, "total")


SCHEMA_NAMES_SQL = """array_to_string(list_transform(from_json(coalesce(json_extract({c}, '$.fields'),
  json_extract({c}, '$.key_fields')), '[{{"name":"VARCHAR"}}]'), lambda x: x.name), ',')"""


@query("inferred_types", f"""
WITH p AS (SELECT *, coalesce(nullif(inferred_type, ''), 'Documento Desconocido') AS group_name
           FROM v_documents WHERE status = 'pending_confirmation'),
g AS (SELECT user_id, group_name, count(*) AS doc_count, min(id) AS first_doc_id,
             arg_min(extracted_data, id) AS sj FROM p GROUP BY 1, 2)
SELECT user_id, group_name, doc_count, first_doc_id, {SCHEMA_NAMES_SQL.format(c='sj')} AS schema_fields FROM g""")
def q_inferred_types(fx):
    """Pending groups with count, first document and its field names."""
    g = S.inferred_types(fx.v_documents)
    return g.withColumn("schema_fields", S.schema_names("_schema_json")).drop("_schema_json")


GROUP_ITEMS_SQL = """
SELECT id, user_id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE inferred_type END AS cls_inferred,
  CASE WHEN id % 3 = 0 THEN NULL ELSE json_extract_string(extracted_data, '$.summary') END AS data_inferred
FROM v_documents"""


@query("group_by_inferred", f"""
WITH i AS ({GROUP_ITEMS_SQL}),
k AS (SELECT *, coalesce(nullif(cls_inferred, ''), nullif(data_inferred, ''), 'Desconocido') AS group_key FROM i)
SELECT user_id, group_key, count(*) AS doc_count, min(id) AS first_doc_id FROM k GROUP BY 1, 2""")
def q_group_by_inferred(fx):
    """Key fallbacks: classification, inferred data, 'Desconocido'."""
    d = fx.v_documents
    i = d.select("id", "user_id",
                 F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.lit(""))
                 .otherwise(F.col("inferred_type")).alias("cls_inferred"),
                 F.when(F.col("id") % 3 == 0, F.lit(None))
                 .otherwise(F.get_json_object("extracted_data", "$.summary")).alias("data_inferred"))
    g = S.group_by_inferred(i)
    return g.groupBy("user_id", "group_key").agg(F.count(F.lit(1)).alias("doc_count"),
                                                  F.min("id").alias("first_doc_id"))


NORM_TYPE_SQL = """CASE WHEN lower(trim(type)) IN ('number','integer','float','currency') THEN 'number'
  WHEN lower(trim(type)) IN ('date','datetime','timestamp') THEN 'date'
  WHEN lower(trim(type)) IN ('boolean','bool') THEN 'boolean'
  WHEN lower(trim(type)) IN ('array','list') THEN 'array' ELSE 'string' END"""


# A schema belongs to one tenant's type.
TENANT_TYPE = ("user_id", "type_name")
D7_SQL = f"""
f7 AS (SELECT *, {NORM_TYPE_SQL} AS t FROM v_fields),
n7 AS (SELECT user_id, type_name, count(DISTINCT doc_id) AS n FROM f7 GROUP BY 1, 2),
h7 AS (SELECT user_id, type_name, name, count(DISTINCT doc_id) AS have FROM f7 GROUP BY 1, 2, 3),
tc7 AS (SELECT user_id, type_name, name, t, count(*) AS c FROM f7 GROUP BY 1, 2, 3, 4),
bt7 AS (SELECT user_id, type_name, name, t FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, type_name, name ORDER BY c DESC, t) AS r FROM tc7) WHERE r = 1),
o7 AS (SELECT user_id, type_name, name, bt7.t AS type, round(h7.have / n7.n, 6) AS frequency, h7.have / n7.n >= 0.5 AS required
       FROM h7 JOIN bt7 USING (user_id, type_name, name) JOIN n7 USING (user_id, type_name)),
sch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type_name ORDER BY frequency DESC, name) AS position FROM o7)
        WHERE position <= 30)"""


@query("consolidate_schema", f"WITH {D7_SQL}\nSELECT * FROM sch")
def q_consolidate_schema(fx):
    """One schema per tenant and type from the fields its documents carry."""
    return S.consolidate_schema(fx.v_fields, TENANT_TYPE)


@query("populated_fields", """
SELECT id, coalesce(len(list_filter(from_json(coalesce(json_extract(extracted_data, '$.fields'),
  json_extract(extracted_data, '$.key_fields')), '[{"value":"VARCHAR"}]'), lambda x: x.value IS NOT NULL AND x.value <> '')), 0) AS populated,
  coalesce(len(list_filter(from_json(coalesce(json_extract(extracted_data, '$.fields'),
  json_extract(extracted_data, '$.key_fields')), '[{"value":"VARCHAR"}]'), lambda x: x.value IS NOT NULL AND x.value <> '')), 0) = 0 AS low_confidence
FROM v_documents""")
def q_populated_fields(fx):
    """Populated (non-null, non-empty) fields per document; low confidence at 0."""
    return S.populated_fields(fx.v_documents.select("id", "extracted_data")).drop("extracted_data")


@query("run_metrics", f"""
WITH s AS ({STAGES_SQL})
SELECT run_id, CAST(floor((max(epoch_us(ts) + coalesce(duration_ms, 0) * 1000) - epoch_us(min(ts))) / 1000) AS BIGINT) AS total_duration_ms,
  round(sum(coalesce(cost_usd, 0.0)), 9) AS total_cost_usd,
  string_agg(stage, ',' ORDER BY ts, event_id) AS stages,
  NOT bool_or(stage = 'ocr') AS cache_hit
FROM s GROUP BY run_id""")
def q_run_metrics(fx):
    """Per run wall time, cost, ordered stages and OCR cache hit."""
    return S.run_metrics(stages_with_cost(fx))


USAGE_SQL = """
SELECT s.user_id, s.docs_used_this_period, count(d.id) AS docs_in_period
FROM v_subscriptions s LEFT JOIN v_documents d ON s.user_id = d.user_id
  AND (s.period_start IS NULL OR d.created_at >= s.period_start)
  AND (s.period_end IS NULL OR d.created_at < s.period_end)
GROUP BY s.user_id, s.docs_used_this_period"""


@query("usage_mismatch", f"""
WITH u AS ({USAGE_SQL})
SELECT user_id, docs_used_this_period AS stored, docs_in_period AS recounted,
  docs_used_this_period <> docs_in_period AS mismatch, docs_in_period AS corrected FROM u""")
def q_usage_mismatch(fx):
    """Stored usage counter against the recount, and the fix."""
    u = M.usage_in_period(fx.v_subscriptions, fx.v_documents)
    return S.usage_mismatch(u)


@query("success_rate", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
  CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (WHERE status = 'completed') / count(*) * 1000 + 0.5) / 10 ELSE 0 END AS success_rate
FROM v_documents GROUP BY user_id""")
def q_success_rate(fx):
    """Completed share per tenant, one decimal, half up."""
    s = S.status_stats(fx.v_documents).select("user_id", "total", "completed")
    return s.withColumn("success_rate", S.success_rate("completed", "total"))


EST_SQL = """CASE lower(string_split(filename, '.')[-1]) WHEN 'pdf' THEN 1.2 * 1024 * 1024
  WHEN 'png' THEN 800.0 * 1024 WHEN 'jpg' THEN 800.0 * 1024 WHEN 'jpeg' THEN 800.0 * 1024 WHEN 'webp' THEN 800.0 * 1024
  WHEN 'xlsx' THEN 200.0 * 1024 WHEN 'csv' THEN 200.0 * 1024 ELSE 500.0 * 1024 END"""


@query("storage_usage", f"""
SELECT user_id, round(CAST(sum({EST_SQL}) AS DOUBLE), 3) AS est_bytes,
  round(least(CAST(sum({EST_SQL}) AS DOUBLE) / 5368709120 * 100, 100.0), 6) AS percent
FROM v_documents GROUP BY user_id""")
def q_storage_usage(fx):
    """Estimated storage per tenant and percent of the 5 GiB quota."""
    return S.storage_usage(fx.v_documents)


@query("mrr_by_plan", f"""
SELECT s.plan, count(*) AS subscribers, CAST(sum(pl.price) AS BIGINT) AS mrr
FROM v_subscriptions s LEFT JOIN {PLAN_VALUES_SQL} ON s.plan = pl.plan
WHERE s.active GROUP BY ROLLUP (s.plan)""")
def q_mrr_by_plan(fx):
    """Active subscribers and monthly revenue per plan, with the total."""
    return S.mrr_by_plan(fx.v_subscriptions, plan_limits_df(fx.spark))


def _period_sql(label, unit):
    return f"""SELECT '{label}' AS period, count(DISTINCT run_id) AS documents,
  round(coalesce(sum(cost_usd), 0.0), 9) AS cost_usd FROM s
  WHERE ts >= date_trunc('{unit}', TIMESTAMP '{ASOF_EVENTS}') AND ts < TIMESTAMP '{ASOF_EVENTS}' + INTERVAL 1 DAY"""


@query("docs_by_period", f"""
WITH s AS ({STAGES_SQL})
{_period_sql('today', 'day')} UNION ALL {_period_sql('this_week', 'week')} UNION ALL {_period_sql('this_month', 'month')}""")
def q_docs_by_period(fx):
    """Runs and cost today / this week / this month as of the events' as-of."""
    return S.docs_by_period(stages_with_cost(fx), ASOF_EVENTS)


@query("cost_by_provider_day", f"""
WITH s AS ({STAGES_SQL}),
d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT run_id) AS documents,
  round(coalesce(sum(cost_usd) FILTER (WHERE provider = 'ocr'), 0.0), 9) AS ocr_cost,
  round(coalesce(sum(cost_usd) FILTER (WHERE provider = 'model'), 0.0), 9) AS model_cost,
  round(coalesce(sum(cost_usd) FILTER (WHERE provider IS NULL), 0.0), 9) AS other_cost FROM s GROUP BY 1)
SELECT *, round(ocr_cost + model_cost + other_cost, 9) AS total_cost FROM d""")
def q_cost_by_provider_day(fx):
    """Per day documents and cost by provider."""
    return S.cost_by_provider_day(stages_with_cost(fx))


@query("batch_summary", """
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS processed,
  count(*) FILTER (WHERE status = 'pending_confirmation') AS pending, count(*) FILTER (WHERE status = 'error') AS errors
FROM v_documents GROUP BY user_id""")
def q_batch_summary(fx):
    """Batch totals: processed, pending and errors per tenant."""
    return S.batch_summary(fx.v_documents)


@query("quota_check", f"""
WITH tc AS (SELECT user_id, count(*) AS type_count FROM v_document_types GROUP BY 1)
SELECT s.user_id, s.plan, s.docs_used_this_period, pl.docs_per_month, coalesce(tc.type_count, 0) AS type_count, pl.doc_types_max,
  pl.docs_per_month <> -1 AND s.docs_used_this_period >= pl.docs_per_month AS doc_denied,
  pl.doc_types_max <> -1 AND coalesce(tc.type_count, 0) >= pl.doc_types_max AS type_denied
FROM v_subscriptions s LEFT JOIN {PLAN_VALUES_SQL} ON s.plan = pl.plan LEFT JOIN tc ON s.user_id = tc.user_id""")
def q_quota_check(fx):
    """Document and type quota verdicts per user."""
    sl = M.plan_limits_join(fx.v_subscriptions, plan_limits_df(fx.spark))
    tc = fx.v_document_types.groupBy("user_id").agg(F.count(F.lit(1)).alias("type_count"))
    return S.quota_check(sl, tc)


@query("plan_status", f"""
WITH u AS (
  SELECT s.user_id, s.plan, s.period_end, s.active, count(d.id) AS docs_used
  FROM v_subscriptions s LEFT JOIN v_documents d ON s.user_id = d.user_id
    AND (s.period_start IS NULL OR d.created_at >= s.period_start)
    AND (s.period_end IS NULL OR d.created_at < s.period_end)
  GROUP BY 1, 2, 3, 4)
SELECT u.user_id, u.plan, u.docs_used, pl.docs_per_month AS docs_limit, pl.doc_types_max AS doc_types_limit,
  pl.max_file_size_mb, pl.price, u.period_end, u.active
FROM u LEFT JOIN {PLAN_VALUES_SQL} ON u.plan = pl.plan""")
def q_plan_status(fx):
    """Plan, recounted usage and limits per user."""
    u = M.usage_in_period(fx.v_subscriptions, fx.v_documents)
    j = M.plan_limits_join(u, plan_limits_df(fx.spark))
    return j.select("user_id", "plan", F.col("docs_in_period").alias("docs_used"),
                    F.col("docs_per_month").alias("docs_limit"), F.col("doc_types_max").alias("doc_types_limit"),
                    "max_file_size_mb", "price", "period_end", "active")


@query("new_types_this_month", f"""
WITH first_use AS (SELECT document_type_id AS type_id, min(created_at) AS created_at FROM v_documents
                   WHERE document_type_id IS NOT NULL GROUP BY 1)
SELECT t.user_id, count(*) AS new_types FROM v_document_types t JOIN first_use f ON t.id = f.type_id
WHERE f.created_at >= date_trunc('month', TIMESTAMP '{ASOF_ORDERS}') GROUP BY t.user_id""")
def q_new_types_this_month(fx):
    """Types (created at their first document) since the first of the
    as-of month, per tenant."""
    first = (fx.v_documents.filter(F.col("document_type_id").isNotNull())
             .groupBy(F.col("document_type_id").alias("type_id")).agg(F.min("created_at").alias("created_at")))
    start = F.date_trunc("month", F.lit(ASOF_ORDERS).cast("timestamp_ntz")).cast("timestamp_ntz")
    t = fx.v_document_types.select("id", "user_id").join(first, F.col("id") == F.col("type_id"))
    return t.filter(F.col("created_at") >= start).groupBy("user_id").agg(F.count(F.lit(1)).alias("new_types"))


@query("distinct_type_names", """
SELECT DISTINCT user_id, inferred_type FROM v_documents WHERE status <> 'error'""")
def q_distinct_type_names(fx):
    """Distinct inferred type names per tenant, error rows excluded."""
    return fx.v_documents.filter(F.col("status") != "error").select("user_id", "inferred_type").distinct()


@query("inference_report", """
WITH r AS (SELECT user_id, type_name, count(DISTINCT name) AS field_count, count(DISTINCT doc_id) AS sample_count
           FROM v_fields GROUP BY GROUPING SETS ((user_id, type_name), ())),
ids AS (SELECT user_id, name AS type_name, min(id) AS type_id FROM v_document_types GROUP BY ALL)
SELECT r.user_id, r.type_name, field_count, sample_count, type_id
FROM r LEFT JOIN ids ON r.user_id = ids.user_id AND r.type_name = ids.type_name""")
def q_inference_report(fx):
    """Per tenant and type its id, field and sample counts, plus the totals row."""
    return S.inference_report(fx.v_fields, fx.v_document_types)


@query("chat_counts", """
SELECT d.user_id, count(*) AS documents, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(DISTINCT t.name) AS types_in_use, arg_max(d.filename, (d.created_at, d.id)) AS newest_filename
FROM v_documents d LEFT JOIN v_document_types t ON d.document_type_id = t.id GROUP BY d.user_id""")
def q_chat_counts(fx):
    """The chat's suggested questions per tenant."""
    return S.chat_counts(M.docs_with_type(fx.v_documents, fx.v_document_types))
