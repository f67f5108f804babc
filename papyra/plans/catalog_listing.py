"""Registered queries: sorts, pages, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import stage_cost
from ..operators import listing as L
from .catalog_gates import TENANT
from .catalog_stats import STAGE_COST_SQL
from .registry import query


@query("paginate", """
WITH r AS (SELECT id, user_id, filename, created_at,
             row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM v_documents),
t AS (SELECT user_id, count(*) AS total FROM v_documents GROUP BY 1)
SELECT r.*, t.total, 2 AS page, 5 AS "limit", CAST(ceil(t.total / 5) AS BIGINT) AS total_pages
FROM r JOIN t USING (user_id) WHERE rank > 5 AND rank <= 10""")
def q_paginate(fx):
    """page 2 (5 per page, newest first) of every tenant, with totals."""
    d = fx.v_documents.select("id", "user_id", "filename", "created_at")
    return L.paginate(d, page="2", limit="5", group_cols=["user_id"])


@query("recent_activity", """
SELECT user_id, id, status, filename, rank,
  CASE WHEN status = 'completed' THEN printf('Documento "%s" procesado exitosamente', filename)
       WHEN status = 'processing' THEN printf('Procesando documento "%s"', filename)
       ELSE printf('Error al procesar "%s"', filename) END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM v_documents)
WHERE rank <= 5""")
def q_recent_activity(fx):
    """newest five documents of every tenant as activity lines."""
    d = fx.v_documents.select("user_id", "id", "status", "filename", "created_at")
    return L.recent_activity(d).drop("created_at")


@query("sort_documents", """
SELECT user_id, id, filename, status, created_at FROM v_documents ORDER BY user_id, status, id""")
def q_sort_documents(fx):
    """storage list sorted by status (id tie-break) per tenant."""
    d = fx.v_documents.select("user_id", "id", "filename", "status", "created_at")
    return L.sort_documents(d, "status")


@query("take_queued", """
SELECT user_id, id, filename, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rank FROM v_documents WHERE status = 'queued')
WHERE rank <= 20""")
def q_take_queued(fx):
    """up to 20 queued documents per tenant."""
    d = fx.v_documents.select("user_id", "id", "filename", "status", "created_at")
    return L.take_queued(d).select("user_id", "id", "filename", "rank")


@query("cap_rows", """
WITH t AS (SELECT count(*) AS n FROM v_documents)
SELECT c.*, c.row_no <= 25 AS in_preview, t.n > 1000 AS truncated FROM (
  SELECT id, user_id, filename, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS row_no
  FROM v_documents ORDER BY created_at DESC, id DESC LIMIT 1000) c, t""")
def q_cap_rows(fx):
    """a result capped at 1000 rows with the 25-row preview flag."""
    d = fx.v_documents.select("id", "user_id", "filename", "created_at")
    return L.cap_rows(d, (F.col("created_at").desc(), F.col("id").desc()))


@query("top_users", f"""
WITH d AS (SELECT user_id, count(*) AS doc_count FROM v_documents GROUP BY 1),
c AS (SELECT CAST(substr(content_hash, 2) AS BIGINT) AS user_id, sum({STAGE_COST_SQL}) AS cost_usd FROM v_stage_metrics GROUP BY 1)
SELECT d.user_id, d.doc_count, round(coalesce(c.cost_usd, 0.0), 6) AS cost_usd
FROM d LEFT JOIN c USING (user_id) ORDER BY doc_count DESC, cost_usd DESC, user_id LIMIT 10""")
def q_top_users(fx):
    """the ten users with most documents (then cost)."""
    s = fx.v_stage_metrics
    costs = s.select(F.substring("content_hash", 2, 1 << 20).cast("bigint").alias("user_id"),
                     stage_cost("provider", "pages", "is_vision", "input_chars", "output_chars").alias("cost_usd"))
    return L.top_users(fx.v_documents, costs)


@query("recent_users", """
WITH u AS (SELECT user_id, min(created_at) AS first_seen, count(*) AS doc_count FROM v_documents GROUP BY 1
           ORDER BY first_seen DESC, user_id DESC LIMIT 10)
SELECT u.user_id, u.first_seen, u.doc_count, s.plan FROM u LEFT JOIN v_subscriptions s USING (user_id)""")
def q_recent_users(fx):
    """the ten newest users with plan and document count."""
    return L.recent_users(fx.v_documents, fx.v_subscriptions)


@query("list_types", f"""
SELECT id, user_id, name, description FROM v_document_types WHERE user_id = {TENANT} ORDER BY id DESC""")
def q_list_types(fx):
    """F8: the tenant's catalogue, newest first."""
    return L.list_types(fx.v_document_types.select("id", "user_id", "name", "description"), TENANT)


@query("merge_results", """
SELECT id, user_id, status, 'Error al procesar' AS message, NULL AS inferred_type, NULL AS document_type_id
  FROM v_documents WHERE status = 'error'
UNION ALL SELECT id, user_id, status, NULL, inferred_type, NULL FROM v_documents WHERE status = 'pending_confirmation'
UNION ALL SELECT id, user_id, status, NULL, NULL, document_type_id FROM v_documents WHERE status = 'completed'""")
def q_merge_results(fx):
    """Error, pending and processed rows in one result table."""
    d = fx.v_documents
    errors = d.filter(F.col("status") == "error").select("id", "user_id", "status",
                                                         F.lit("Error al procesar").alias("message"))
    pending = d.filter(F.col("status") == "pending_confirmation").select("id", "user_id", "status", "inferred_type")
    done = d.filter(F.col("status") == "completed").select("id", "user_id", "status", "document_type_id")
    return L.merge_results(errors, pending, done)
