"""Registered queries: streaming flows in their batch form.

The same transformation runs under ``readStream``; the tests check that a
stream run to completion equals these batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import ASOF_EVENTS
from ..streaming import flows as ST
from . import jobs as K
from .catalog_jobs import k1_cte
from .registry import query

STATUS_SQL = """CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'completed'
  WHEN 'purchase' THEN 'pending_confirmation' WHEN 'error' THEN 'error' END"""


@query("inbox_stream", """
SELECT o_orderkey AS id, o_custkey AS user_id, concat('doc_', CAST(o_orderkey AS VARCHAR), '.pdf') AS filename, 'queued' AS status,
  concat_ws('/', CAST(o_custkey AS VARCHAR), 'inbox', concat(CAST(epoch_ms(o_orderdate) AS VARCHAR), '-doc_', CAST(o_orderkey AS VARCHAR), '.pdf')) AS storage_key
FROM orders""")
def q_inbox_stream(fx):
    """Files arriving in the inbox become queued rows."""
    o = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                         F.concat(F.lit("doc_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
                         F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("received_ms"))
    return ST.inbox_rows(o, F.col("received_ms"))


@query("status_stream", f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, status, count(*) AS n
FROM (SELECT ts, {STATUS_SQL} AS status FROM events) GROUP BY 1, 2, 3""")
def q_status_stream(fx):
    """Status counts per hour of event time."""
    log = fx.events.select("ts", ST.event_status().alias("status"))
    return ST.status_counts(log)


@query("stream_dedup", """
WITH RECURSIVE e AS (SELECT content_hash, event_id, ts FROM v_stage_metrics WHERE stage = 'ocr'),
kept AS (
  SELECT content_hash, min(struct_pack(ts := ts, id := event_id)) AS k FROM e GROUP BY content_hash
  UNION ALL
  SELECT kept.content_hash, (SELECT min(struct_pack(ts := e.ts, id := e.event_id)) FROM e
                             WHERE e.content_hash = kept.content_hash AND e.ts >= kept.k.ts + INTERVAL 24 HOUR)
  FROM kept WHERE kept.k IS NOT NULL)
SELECT content_hash, k.id AS event_id, k.ts AS ts FROM kept WHERE k IS NOT NULL""")
def q_stream_dedup(fx):
    """The first sighting of each content, then one at least 24 h after
    the last that was kept."""
    r = fx.v_stage_metrics.filter(F.col("stage") == "ocr").select("content_hash", "event_id", "ts")
    return ST.stream_dedup(r)


@query("process_queue", f"""WITH {k1_cte()}
SELECT doc_id, user_id, status, gate_error, document_type_name, typed_key FROM k1""")
def q_process_queue(fx):
    """I4: every queued upload through K1, failures per row."""
    queue = K.uploads_from_documents(fx.v_labeled_documents).withColumn("status", F.lit("queued"))
    done = ST.process_queue_batch(queue, lambda q: K.process_documents(q, fx.v_type_catalogue))
    return done.select("doc_id", "user_id", "status", "gate_error", "document_type_name", "typed_key")


@query("usage_by_period", f"""
SELECT user_id, date_trunc('month', ts) AS period, count(*) AS docs_used FROM events WHERE {STATUS_SQL} = 'completed' GROUP BY 1, 2""")
def q_usage_by_period(fx):
    """Successful documents per user and month."""
    s = fx.events.filter(ST.event_status() == "completed").select("user_id", "ts")
    return ST.usage_counter(s)


BILLING_SQL = """
WITH e AS (SELECT * FROM v_billing_events WHERE customer_ref IN (SELECT customer_ref FROM v_subscriptions)),
c AS (SELECT customer_ref, ts, event_id,
  CASE WHEN event_type = 'checkout.session.completed' THEN coalesce(target_plan, 'starter')
       WHEN event_type = 'customer.subscription.updated' THEN CASE price_id WHEN 'price_starter' THEN 'starter' WHEN 'price_pro' THEN 'pro' END
       WHEN event_type = 'customer.subscription.deleted' THEN 'free' END AS w_plan,
  CASE WHEN event_type IN ('checkout.session.completed', 'customer.subscription.deleted') THEN true
       WHEN event_type = 'customer.subscription.updated' THEN status IN ('active', 'trialing')
       WHEN event_type = 'invoice.payment_failed' THEN false END AS w_active,
  CASE WHEN event_type = 'checkout.session.completed' THEN 0 END AS w_used,
  CASE event_type WHEN 'checkout.session.completed' THEN ts WHEN 'customer.subscription.updated' THEN period_start END AS w_start,
  CASE event_type WHEN 'checkout.session.completed' THEN ts + INTERVAL 30 DAY WHEN 'customer.subscription.updated' THEN period_end END AS w_end,
  CASE WHEN event_type = 'checkout.session.completed' THEN true WHEN event_type = 'customer.subscription.deleted' THEN false END AS w_has_sub
  FROM e),
l AS (SELECT customer_ref,
  arg_max(w_plan, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_plan IS NOT NULL) AS w_plan,
  arg_max(w_active, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_active IS NOT NULL) AS w_active,
  arg_max(w_used, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_used IS NOT NULL) AS w_used,
  arg_max(w_start, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_start IS NOT NULL) AS w_start,
  arg_max(w_end, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_end IS NOT NULL) AS w_end,
  arg_max(w_has_sub, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_has_sub IS NOT NULL) AS w_has_sub
  FROM c GROUP BY customer_ref)
SELECT s.user_id, s.customer_ref, coalesce(l.w_plan, s.plan) AS plan, coalesce(l.w_active, s.active) AS active,
  CAST(coalesce(l.w_used, s.docs_used_this_period) AS INTEGER) AS docs_used_this_period,
  coalesce(l.w_start, s.period_start) AS period_start, coalesce(l.w_end, s.period_end) AS period_end,
  coalesce(l.w_has_sub, false) AS has_subscription
FROM v_subscriptions s LEFT JOIN l USING (customer_ref)"""


@query("billing_fold", BILLING_SQL)
def q_billing_fold(fx):
    """Subscriptions after folding the billing events."""
    return ST.billing_fold(fx.v_billing_events, fx.v_subscriptions)


@query("call_rate_stream", """
WITH c AS (SELECT provider, epoch_us(ts) AS us FROM v_stage_metrics WHERE provider IS NOT NULL),
w AS (SELECT provider, (us // 10000000) * 10000000 - k * 10000000 AS start_us FROM c, range(6) t(k))
SELECT make_timestamp(start_us) AS window_start, make_timestamp(start_us + 60000000) AS window_end, provider,
  count(*) AS calls, count(*) > 10 AS over_limit FROM w GROUP BY start_us, provider""")
def q_call_rate_stream(fx):
    """Calls per provider in sliding 60 s windows (10 s slide)."""
    calls = fx.v_stage_metrics.filter(F.col("provider").isNotNull()).select("provider", "ts")
    return ST.call_rate(calls)


JOB_SQL = f"""
WITH u AS (SELECT run_id AS job_id, ts, event_id, stage = 'save' AS is_save, duration_ms,
  CAST(duration_ms % 130 - 10 AS INTEGER) AS raw_progress FROM v_stage_metrics),
w AS (SELECT job_id, ts, event_id,
  CASE WHEN NOT is_save THEN (SELECT stage FROM v_stage_metrics x WHERE x.event_id = u.event_id)
       WHEN duration_ms % 2 = 0 THEN 'done' END AS w_step,
  CASE WHEN NOT is_save THEN least(100, greatest(0, raw_progress)) WHEN duration_ms % 2 = 0 THEN 100 ELSE 0 END AS w_progress,
  CASE WHEN NOT is_save THEN concat('Paso ', (SELECT stage FROM v_stage_metrics x WHERE x.event_id = u.event_id))
       WHEN duration_ms % 2 = 0 THEN 'Completado' ELSE 'Error' END AS w_message,
  CASE WHEN is_save AND duration_ms % 2 = 0 THEN 'completed' WHEN is_save THEN 'failed' END AS w_status,
  CASE WHEN is_save THEN ts END AS w_completed_at FROM u),
l AS (SELECT job_id,
  arg_max(w_step, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_step IS NOT NULL) AS w_step,
  arg_max(w_progress, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_progress IS NOT NULL) AS w_progress,
  arg_max(w_message, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_message IS NOT NULL) AS w_message,
  arg_max(w_status, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_status IS NOT NULL) AS w_status,
  arg_max(w_completed_at, struct_pack(a := ts, b := event_id)) FILTER (WHERE w_completed_at IS NOT NULL) AS w_completed_at
  FROM w GROUP BY job_id)
SELECT job_id, coalesce(w_step, 'queued') AS step, coalesce(w_progress, 0) AS progress, coalesce(w_message, 'En cola...') AS message,
  coalesce(w_status, 'processing') AS status, w_completed_at AS completed_at,
  coalesce(epoch_us(TIMESTAMP '{ASOF_EVENTS}') - epoch_us(w_completed_at) > 3600000000, false) AS expired
FROM l"""


@query("job_state", JOB_SQL)
def q_job_state(fx):
    """I8: latest step, progress and status per job; finished jobs expire after 1 h."""
    return ST.job_state(fx.v_stage_metrics, ASOF_EVENTS)


@query("status_history", f"""
WITH s AS (SELECT CAST(floor(event_id / 5) AS BIGINT) AS doc_id, event_id, ts, {STATUS_SQL} AS status FROM events),
l AS (SELECT doc_id, event_id, lag(status) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS prev_status, status FROM s)
SELECT doc_id, event_id, prev_status, status,
  prev_status IS NULL OR status = 'processing'
  OR (prev_status, status) IN (('queued', 'processing'), ('processing', 'completed'), ('processing', 'pending_confirmation'),
                               ('processing', 'error'), ('pending_confirmation', 'completed'), ('pending_confirmation', 'deleted')) AS valid
FROM l""")
def q_status_history(fx):
    """Status transitions per document, flagged when not allowed."""
    log = fx.events.select(F.floor(F.col("event_id") / 5).cast("bigint").alias("doc_id"), "event_id", "ts",
                           ST.event_status().alias("status"))
    return ST.status_history(log)
