"""Registered queries: window-style operators (E1-E7) and the aggregates on
top of them (D17, D18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import stats as S
from ..operators import windows as W
from ..sources.fixtures import ASOF_ORDERS
from .registry import query


@query("dedup_by_content", """
WITH d AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
f AS (SELECT content_hash, min(doc_id) AS first_id FROM d GROUP BY 1)
SELECT d.doc_id, d.content_hash, d.doc_id = f.first_id AS kept FROM d JOIN f USING (content_hash)""")
def q_dedup_by_content(fx):
    """First upload per content hash kept, copies reported."""
    d = fx.documents.select("doc_id", content_hash("text").alias("content_hash"))
    return W.dedup_by_content(d)


REPEAT_SQL = """
WITH r AS (SELECT event_id, ts, content_hash FROM v_stage_metrics WHERE stage = 'ocr'),
flags AS (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ts, event_id) > 1 AS repeated,
    CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY content_hash))) / 1000) AS BIGINT) AS since_first_ms
  FROM r)"""


def _repeats(fx):
    req = fx.v_stage_metrics.filter(F.col("stage") == "ocr").select("event_id", "ts", "content_hash")
    return W.repeat_requests(req)


@query("repeat_requests", f"{REPEAT_SQL}\nSELECT event_id, ts, content_hash, repeated, since_first_ms FROM flags")
def q_repeat_requests(fx):
    """OCR requests whose content was asked for before."""
    return _repeats(fx)


@query("repeat_rate", f"""{REPEAT_SQL}
SELECT count(*) FILTER (WHERE repeated) AS repeats, count(*) FILTER (WHERE NOT repeated) AS first_requests,
  CASE WHEN count(*) > 0 THEN concat(printf('%.1f', count(*) FILTER (WHERE repeated) / count(*) * 100), '%') ELSE 'N/A' END AS repeat_rate
FROM flags""")
def q_repeat_rate(fx):
    """Repeated and first OCR requests and the share of repeats."""
    return S.repeat_rate(_repeats(fx))


CALLS_SQL = "SELECT provider, event_id, ts FROM v_stage_metrics WHERE provider IS NOT NULL"
AUDIT_SQL = f"""
WITH c AS ({CALLS_SQL}),
x AS (
  SELECT a.provider, a.event_id, a.ts,
    (SELECT count(*) FROM c b WHERE b.provider = a.provider
       AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))
       AND epoch_us(a.ts) - epoch_us(b.ts) < 60000000) AS prev_in_window,
    CAST(floor((epoch_us(a.ts) - epoch_us(lag(a.ts) OVER (PARTITION BY a.provider ORDER BY a.ts, a.event_id))) / 1000) AS BIGINT) AS gap_ms,
    CASE a.provider WHEN 'ocr' THEN 3000 WHEN 'model' THEN 4000 END AS min_delay
  FROM c a),
audit AS (
  SELECT provider, event_id, prev_in_window, gap_ms, prev_in_window >= 10 AS rpm_breach,
    coalesce(gap_ms < min_delay, false) AS delay_breach,
    CAST(greatest(0, coalesce(min_delay - gap_ms, 0)) AS BIGINT) AS wait_ms FROM x)"""


def _audit(fx):
    calls = fx.v_stage_metrics.filter(F.col("provider").isNotNull()).select("provider", "event_id", "ts")
    return W.rate_audit(calls)


@query("rate_audit", f"{AUDIT_SQL}\nSELECT * FROM audit")
def q_rate_audit(fx):
    """Trailing-60 s call counts, gaps and breaches per provider."""
    return _audit(fx)


@query("call_spacing", f"""{AUDIT_SQL}
SELECT provider, count(*) AS calls, count(*) FILTER (WHERE delay_breach) AS too_close, CAST(sum(wait_ms) AS BIGINT) AS short_ms,
  CASE WHEN count(*) > 0 THEN concat(printf('%.0f', sum(wait_ms) / count(*)), 'ms') ELSE 'N/A' END AS avg_short
FROM audit GROUP BY provider""")
def q_call_spacing(fx):
    """Calls closer than the provider's spacing, and by how much."""
    return S.call_spacing(_audit(fx))


@query("daily_activity", f"""
WITH g AS (SELECT DISTINCT user_id FROM v_documents),
days AS (SELECT CAST(unnest(generate_series(CAST(TIMESTAMP '{ASOF_ORDERS}' AS DATE) - 13, CAST(TIMESTAMP '{ASOF_ORDERS}' AS DATE), INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS total,
        count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'error') AS errors
      FROM v_documents GROUP BY 1, 2)
SELECT g.user_id, d.day, coalesce(c.total, 0) AS total, coalesce(c.completed, 0) AS completed, coalesce(c.errors, 0) AS errors
FROM g CROSS JOIN days d LEFT JOIN c ON c.user_id = g.user_id AND c.day = d.day""")
def q_daily_activity(fx):
    """14 zero-filled days per tenant ending at the as-of day."""
    return W.daily_activity(fx.v_documents, ASOF_ORDERS)


@query("growth", """
WITH m AS (SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, count(*) AS value FROM v_documents GROUP BY 1)
SELECT period, value, lag(value) OVER (ORDER BY period) AS previous,
  CASE WHEN lag(value) OVER (ORDER BY period) > 0
       THEN round((value - lag(value) OVER (ORDER BY period)) / lag(value) OVER (ORDER BY period) * 100, 1) END AS growth_pct
FROM m""")
def q_growth(fx):
    """E5: month-over-month change of uploaded documents."""
    m = fx.v_documents.groupBy(F.to_date(F.date_trunc("month", "created_at")).alias("period")).agg(
        F.count(F.lit(1)).alias("value"))
    return W.growth(m)


@query("chunk_items", """
SELECT user_id, id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) - 1) / 5) AS BIGINT) AS chunk
FROM v_documents WHERE status = 'queued'""")
def q_chunk_items(fx):
    """All queued documents of every tenant in chunks of 5."""
    q = fx.v_documents.filter(F.col("status") == "queued").select("user_id", "id", "created_at")
    return W.chunk_items(q, 5, ["user_id"], (F.col("created_at"), F.col("id"))).drop("created_at")


@query("roll_period", f"""
WITH s AS (SELECT * FROM v_subscriptions WHERE plan <> 'free'),
j AS (SELECT c.c_custkey AS user_id, s.plan, s.docs_used_this_period, s.period_start, s.period_end
      FROM customer c LEFT JOIN s ON c.c_custkey = s.user_id),
k AS (SELECT *, plan IS NULL AS missing,
        plan IS NOT NULL AND coalesce(TIMESTAMP '{ASOF_ORDERS}' > period_end, false) AS expired FROM j)
SELECT user_id, coalesce(plan, 'free') AS plan,
  CAST(CASE WHEN missing OR expired THEN 0 ELSE docs_used_this_period END AS INTEGER) AS docs_used_this_period,
  CASE WHEN missing OR expired THEN TIMESTAMP '{ASOF_ORDERS}' ELSE period_start END AS period_start,
  CASE WHEN missing OR expired THEN TIMESTAMP '{ASOF_ORDERS}' + INTERVAL 1 MONTH ELSE period_end END AS period_end,
  CASE WHEN missing THEN 'created' WHEN expired THEN 'reset' ELSE 'unchanged' END AS action
FROM k""")
def q_roll_period(fx):
    """Free users have no subscription row yet and get one; expired
    periods restart."""
    users = fx.customer.select(F.col("c_custkey").alias("user_id"))
    subs = fx.v_subscriptions.filter(F.col("plan") != "free").select(
        "user_id", "plan", "docs_used_this_period", "period_start", "period_end")
    return W.roll_period(users, subs, ASOF_ORDERS)
