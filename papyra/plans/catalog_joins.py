"""Registered queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import is_others
from ..operators import listing as L
from ..operators import matching as M
from ..schemas import PLAN_VALUES_SQL, plan_limits_df
from .registry import query


@query("docs_with_type", """
SELECT d.id, d.user_id, d.document_type_id, t.name AS document_type_name
FROM v_documents d LEFT JOIN v_document_types t ON d.document_type_id = t.id""")
def q_docs_with_type(fx):
    """Documents with their type name (left join)."""
    return M.docs_with_type(fx.v_documents.select("id", "user_id", "document_type_id"), fx.v_document_types)


# Classified names derived from each document's inferred type: the exact
# name, a 3-letter prefix (the type name contains it) or the name plus a
# suffix (it contains the type name).
ITEMS_SQL = """
SELECT id, user_id, confidence_score,
  CASE WHEN id % 3 = 0 THEN lower(substr(inferred_type, 1, 3))
       WHEN id % 3 = 1 THEN concat(inferred_type, ' extra') ELSE inferred_type END AS classified_name,
  coalesce(confidence_score < 0.3, false) AS is_others
FROM v_documents"""


def _items(fx):
    d = fx.v_documents
    name = (F.when(F.col("id") % 3 == 0, F.lower(F.substring("inferred_type", 1, 3)))
            .when(F.col("id") % 3 == 1, F.concat("inferred_type", F.lit(" extra")))
            .otherwise(F.col("inferred_type")))
    return d.select("id", "user_id", "confidence_score", name.alias("classified_name"),
                    is_others(F.lit(None).cast("boolean"), "confidence_score", 0.3).alias("is_others"))


def _best_sql(partial: bool) -> str:
    cond = "t.tn = i.cn OR contains(t.tn, i.cn) OR contains(i.cn, t.tn)" if partial else "t.tn = i.cn"
    return f"""
items AS ({ITEMS_SQL}),
t AS (SELECT user_id AS tu, id AS tid, name AS tname, lower(trim(name)) AS tn FROM v_document_types),
cand AS (
  SELECT i.id, t.tid, t.tname, CASE WHEN t.tn = i.cn THEN 0 ELSE 1 END AS rk,
         row_number() OVER (PARTITION BY i.id ORDER BY CASE WHEN t.tn = i.cn THEN 0 ELSE 1 END, t.tid) AS rn
  FROM (SELECT *, lower(trim(classified_name)) AS cn FROM items) i JOIN t ON i.user_id = t.tu AND ({cond})),
best AS (SELECT id, tid AS match_type_id, tname AS match_type_name,
                CASE WHEN rk = 0 THEN 'exact' ELSE 'partial' END AS match_kind FROM cand WHERE rn = 1)"""


@query("match_type_exact", f"""
WITH {_best_sql(False)}
SELECT i.id, i.user_id, i.classified_name, b.match_type_id, b.match_type_name, b.match_kind
FROM items i LEFT JOIN best b ON i.id = b.id""")
def q_match_type_exact(fx):
    """Exact type match on lower(trim(name)) within the tenant."""
    it = _items(fx).select("id", "user_id", "classified_name")
    return M.match_type_exact(it, fx.v_document_types)


@query("match_type_partial", f"""
WITH {_best_sql(True)}
SELECT i.id, i.user_id, i.classified_name, b.match_type_id, b.match_type_name, b.match_kind
FROM items i LEFT JOIN best b ON i.id = b.id""")
def q_match_type_partial(fx):
    """Exact, else partial (contains either way) type match; lowest id first."""
    it = _items(fx).select("id", "user_id", "classified_name")
    return M.match_type_partial(it, fx.v_document_types)


@query("resolve_type", f"""
WITH {_best_sql(True)}
SELECT i.id, i.user_id, i.classified_name, i.is_others,
  CASE WHEN i.is_others THEN 'others' WHEN b.match_type_id IS NULL THEN 'others_fallback' ELSE b.match_kind END AS route,
  CASE WHEN NOT i.is_others THEN b.match_type_id END AS resolved_type_id,
  CASE WHEN NOT i.is_others THEN b.match_type_name END AS resolved_type_name,
  i.is_others OR b.match_type_id IS NULL AS resolved_is_others
FROM items i LEFT JOIN best b ON i.id = b.id""")
def q_resolve_type(fx):
    """C4: route each document: Others flag, exact, partial or Others fallback."""
    it = _items(fx).select("id", "user_id", "classified_name", "is_others")
    return M.resolve_type(it, fx.v_document_types)


@query("split_matched", f"""
WITH {_best_sql(True)}
SELECT i.id, i.user_id, (NOT i.is_others AND b.match_type_id IS NOT NULL) AS matched
FROM items i LEFT JOIN best b ON i.id = b.id""")
def q_split_matched(fx):
    """Matched / unmatched, tagged."""
    it = _items(fx).select("id", "user_id", "classified_name", "is_others")
    hit, miss = M.split_matched(it, fx.v_document_types)
    return (hit.select("id", "user_id", F.lit(True).alias("matched"))
            .unionByName(miss.select("id", "user_id", F.lit(False).alias("matched"))))


@query("existing_or_new_types", """
WITH n AS (SELECT DISTINCT user_id, inferred_type AS inferred_name FROM v_documents),
t AS (SELECT user_id AS u, lower(trim(name)) AS nn, min(id) AS type_id FROM v_document_types GROUP BY 1, 2)
SELECT n.user_id, n.inferred_name, t.type_id, t.type_id IS NULL AS is_new
FROM n LEFT JOIN t ON n.user_id = t.u AND lower(trim(n.inferred_name)) = t.nn""")
def q_existing_or_new(fx):
    """Inferred names per tenant joined to the catalogue, with is_new."""
    return M.existing_or_new_types(fx.v_documents, fx.v_document_types)


FIELDS_JSON_SQL = """
SELECT id, unnest(from_json(coalesce(json_extract(extracted_data, '$.fields'), json_extract(extracted_data, '$.key_fields')),
  '[{"name":"VARCHAR","type":"VARCHAR","value":"VARCHAR"}]')) AS f FROM v_documents"""


@query("field_access", f"""
SELECT id, f.name AS field_name, f.type AS field_type, f.value AS field_value FROM ({FIELDS_JSON_SQL})""")
def q_field_access(fx):
    """Every field of every document, fields or key_fields."""
    return M.field_access(fx.v_documents)


@query("attach_files", """
SELECT g.id, g.user_id, g.inferred_type AS group_name, k.key, k.filename, c.confidence_score
FROM v_documents g JOIN v_object_keys k ON g.id = k.id JOIN v_documents c ON g.id = c.id""")
def q_attach_files(fx):
    """Group membership ⨝ files ⨝ classification on document id."""
    d = fx.v_documents
    groups = d.select("id", "user_id", F.col("inferred_type").alias("group_name"))
    files = fx.v_object_keys.select("id", "key", "filename")
    classified = d.select("id", "confidence_score")
    return M.attach_files(groups, files, classified)


ASSIGN_SQL = """
SELECT id AS document_id, CASE WHEN id % 7 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
  CASE WHEN id % 4 = 1 THEN concat(inferred_type, ' nuevo') ELSE inferred_type END AS type_name,
  CASE WHEN id % 2 = 0 THEN user_id * 10 + (id % 5) + 1 END AS type_id
FROM v_documents WHERE status = 'pending_confirmation'"""


@query("resolve_assignments", f"""
WITH a AS ({ASSIGN_SQL}),
bn AS (SELECT user_id AS nu, name AS nname, min(id) AS nid FROM v_document_types GROUP BY 1, 2),
j AS (
  SELECT a.*, d.id IS NOT NULL AS found, ti.id AS iid, ti.name AS iname, bn.nid, bn.nname
  FROM a LEFT JOIN v_documents d ON a.document_id = d.id AND a.user_id = d.user_id
  LEFT JOIN v_document_types ti ON a.type_id = ti.id AND a.user_id = ti.user_id
  LEFT JOIN bn ON a.type_id IS NULL AND a.user_id = bn.nu AND a.type_name = bn.nname)
SELECT document_id, user_id, CASE WHEN found THEN 'completed' ELSE 'error' END AS status,
  CASE WHEN NOT found THEN 'not_found' WHEN iid IS NOT NULL THEN 'by_id' WHEN nid IS NOT NULL THEN 'by_name' ELSE 'new_type' END AS resolution,
  CASE WHEN found THEN coalesce(iid, nid) END AS resolved_type_id,
  CASE WHEN found THEN coalesce(iname, nname, type_name) END AS resolved_type_name,
  CASE WHEN NOT found THEN 'Not found' END AS message
FROM j""")
def q_resolve_assignments(fx):
    """Assignments of pending documents (some from the wrong tenant,
    some naming new types)."""
    d = fx.v_documents
    a = d.filter(F.col("status") == "pending_confirmation").select(
        F.col("id").alias("document_id"),
        F.when(F.col("id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("id") % 4 == 1, F.concat("inferred_type", F.lit(" nuevo")))
        .otherwise(F.col("inferred_type")).alias("type_name"),
        F.when(F.col("id") % 2 == 0, F.col("user_id") * 10 + F.col("id") % 5 + 1).alias("type_id"))
    return M.resolve_assignments(a, d, fx.v_document_types)


@query("plan_limits_join", f"""
SELECT s.user_id, s.plan, pl.docs_per_month, pl.doc_types_max, pl.max_file_size_mb, pl.batch_infer_max, pl.price
FROM v_subscriptions s LEFT JOIN {PLAN_VALUES_SQL} ON s.plan = pl.plan""")
def q_plan_limits_join(fx):
    """C11: subscriptions with their plan limits and price."""
    s = fx.v_subscriptions.select("user_id", "plan")
    return M.plan_limits_join(s, plan_limits_df(fx.spark))


@query("usage_in_period", """
SELECT s.user_id, s.period_start, s.period_end, count(d.id) AS docs_in_period
FROM v_subscriptions s LEFT JOIN v_documents d ON s.user_id = d.user_id
  AND (s.period_start IS NULL OR d.created_at >= s.period_start)
  AND (s.period_end IS NULL OR d.created_at < s.period_end)
GROUP BY s.user_id, s.period_start, s.period_end""")
def q_usage_in_period(fx):
    """Half-open period, null bound open."""
    s = fx.v_subscriptions.select("user_id", "period_start", "period_end")
    return M.usage_in_period(s, fx.v_documents)


@query("types_with_counts", """
WITH c AS (SELECT document_type_id AS tid, user_id AS u, count(*) AS n FROM v_documents GROUP BY 1, 2)
SELECT t.user_id, t.id AS type_id, t.name AS type_name, coalesce(c.n, 0) AS doc_count
FROM v_document_types t LEFT JOIN c ON t.id = c.tid
UNION ALL
SELECT u, NULL, NULL, n FROM c WHERE tid IS NULL""")
def q_types_with_counts(fx):
    """Every type with its document count; untyped documents apart."""
    return M.types_with_counts(fx.v_document_types, fx.v_documents)


@query("type_options", """
WITH inf AS (SELECT DISTINCT user_id, inferred_type AS name FROM v_documents WHERE status = 'pending_confirmation')
SELECT t.user_id, t.id AS type_id, t.name FROM v_document_types t
WHERE NOT EXISTS (SELECT 1 FROM inf WHERE inf.user_id = t.user_id AND inf.name = t.name)""")
def q_type_options(fx):
    """C14: existing types not named among the tenant's inferred types."""
    inf = fx.v_documents.filter(F.col("status") == "pending_confirmation").select(
        "user_id", F.col("inferred_type").alias("name"))
    return (fx.v_document_types.join(inf, ["user_id", "name"], "left_anti")
            .select("user_id", F.col("id").alias("type_id"), "name"))


@query("type_options_union", """
WITH inf AS (SELECT DISTINCT user_id, inferred_type AS name FROM v_documents WHERE status = 'pending_confirmation')
SELECT user_id, CAST(NULL AS BIGINT) AS type_id, name, TRUE AS is_new FROM inf
UNION ALL
SELECT t.user_id, t.id, t.name, FALSE FROM v_document_types t
WHERE NOT EXISTS (SELECT 1 FROM inf WHERE inf.user_id = t.user_id AND inf.name = t.name)""")
def q_type_options_union(fx):
    """G1: inferred (new) ∪ existing not among inferred."""
    inf = fx.v_documents.filter(F.col("status") == "pending_confirmation").select(
        "user_id", F.col("inferred_type").alias("name"))
    return L.type_options_union(inf, fx.v_document_types)
