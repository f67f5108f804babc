"""Registered queries: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json_repair import json_summary
from ..functions.text import mime_from_extension
from ..operators import gates as G
from ..operators.matching import docs_with_type
from .guard import guarded_select
from .registry import query

# Fixed parameters of the registered examples.
TENANT = 7

EXT_SQL = "lower(string_split(filename, '.')[-1])"
MIME_SQL = f"""CASE {EXT_SQL} WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png'
  WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp'
  WHEN 'csv' THEN 'text/csv' WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END"""


@query("tenant_view", f"SELECT * FROM v_documents WHERE user_id = CAST(NULLIF('{TENANT}', '') AS BIGINT)")
def q_tenant_view(fx):
    """B1: rows of the session tenant."""
    return G.tenant_view(fx.v_documents, str(TENANT))


@query("file_gate", f"""
SELECT id, user_id, filename, size_bytes, {MIME_SQL} AS mime,
  CASE WHEN size_bytes > 10485760 THEN concat('El archivo "', filename, '" pesa ', printf('%.1f', size_bytes / 1048576.0),
         'MB. El tamaño máximo permitido es 10MB.')
       WHEN {MIME_SQL} NOT IN ('application/pdf','image/jpeg','image/jpg','image/png','image/webp')
       THEN concat('Formato no soportado: "', {MIME_SQL}, '". Solo se permiten archivos PDF e imágenes (JPEG, PNG, WebP).')
  END AS gate_error
FROM v_object_keys""")
def q_file_gate(fx):
    """B2: per-file size then format check."""
    f = fx.v_object_keys.select("id", "user_id", "filename", "size_bytes").withColumn(
        "mime", mime_from_extension("filename"))
    return G.file_gate(f)


@query("batch_gate", f"""
WITH f AS (
  SELECT id, user_id, filename, size_bytes, {MIME_SQL} AS mime FROM v_object_keys),
e AS (
  SELECT *, CASE WHEN mime NOT IN ('application/pdf','image/png','image/jpeg','image/jpg')
                 THEN printf('Tipo no permitido: %s (%s)', filename, mime)
                 WHEN size_bytes > 10485760 THEN printf('Archivo muy grande: %s', filename) END AS file_error
  FROM f),
b AS (
  SELECT user_id, count(*) AS n_files, count(*) FILTER (WHERE file_error IS NULL) AS n_valid FROM e GROUP BY user_id),
bb AS (
  SELECT *, CASE WHEN n_files < 2 THEN 'Se requieren al menos 2 documentos para inferir tipos'
                 WHEN n_files > 10 THEN 'Maximo 10 archivos permitidos' END AS batch_error FROM b)
SELECT e.user_id, e.id, e.filename, e.size_bytes, e.mime, e.file_error, bb.n_files, bb.n_valid, bb.batch_error,
  (bb.batch_error IS NULL AND bb.n_valid > 0) AS batch_accepted,
  (bb.batch_error IS NULL AND bb.n_valid > 0) AND e.file_error IS NULL AS file_kept
FROM e JOIN bb ON e.user_id = bb.user_id""")
def q_batch_gate(fx):
    """Per-file errors plus per-batch (tenant) count verdict."""
    f = fx.v_object_keys.select("id", "user_id", "filename", "size_bytes").withColumn(
        "mime", mime_from_extension("filename"))
    return G.batch_gate(f)


DOCS_TYPED_SQL = """
SELECT d.*, t.name AS document_type_name, json_extract_string(d.extracted_data, '$.summary') AS summary
FROM v_documents d LEFT JOIN v_document_types t ON d.document_type_id = t.id"""


def _docs_typed(fx):
    d = docs_with_type(fx.v_documents, fx.v_document_types)
    return d.withColumn("summary", json_summary("extracted_data"))


@query("filter_documents", f"""
WITH x AS ({DOCS_TYPED_SQL})
SELECT id, user_id, filename, status, document_type_id, document_type_name, summary FROM x
WHERE status = 'completed'
  AND (contains(lower(filename), 'urg') OR coalesce(contains(lower(document_type_name), 'urg'), false)
       OR coalesce(contains(lower(summary), 'urg'), false))""")
def q_filter_documents(fx):
    """status = completed, any type, text 'URG'."""
    d = G.filter_documents(_docs_typed(fx), status="completed", type_id="all", q="URG")
    return d.select("id", "user_id", "filename", "status", "document_type_id", "document_type_name", "summary")


@query("search_documents", f"""
WITH x AS ({DOCS_TYPED_SQL})
SELECT id, user_id, filename, document_type_name, summary FROM x
WHERE contains(lower(filename), '.png') OR coalesce(contains(lower(document_type_name), '.png'), false)
   OR coalesce(contains(lower(summary), '.png'), false)
   OR FALSE""")
def q_search_documents(fx):
    """Literal, case-insensitive '.PNG' over filename, type name, summary."""
    d = G.search_documents(_docs_typed(fx), ".PNG")
    return d.select("id", "user_id", "filename", "document_type_name", "summary")


@query("search_types", """
SELECT id, user_id, name, description FROM v_document_types
WHERE contains(lower(name), 'high') OR coalesce(contains(lower(description), 'high'), false)""")
def q_search_types(fx):
    """Name or description contains 'High'."""
    return G.search_types(fx.v_document_types, "High").select("id", "user_id", "name", "description")


@query("document_by_id", """
WITH req AS (SELECT id, user_id FROM v_documents UNION ALL SELECT id, user_id + 1 FROM v_documents)
SELECT d.id, d.user_id, d.filename, d.status, t.name AS document_type_name,
  json_extract_string(d.extracted_data, '$.summary') AS summary,
  json_array_length(coalesce(json_extract(d.extracted_data, '$.fields'), json_extract(d.extracted_data, '$.key_fields'))) AS n_fields
FROM v_documents d JOIN req r ON d.id = r.id AND d.user_id = r.user_id
LEFT JOIN v_document_types t ON d.document_type_id = t.id""")
def q_document_by_id(fx):
    """Lookups of (id, tenant); only the owner's requests find the row."""
    d = fx.v_documents
    req = d.select("id", "user_id").unionByName(d.select("id", (F.col("user_id") + 1).alias("user_id")))
    out = G.documents_by_request(d, fx.v_document_types, req)
    return out.select("id", "user_id", "filename", "status", "document_type_name",
                      F.try_variant_get("extracted", "$.summary", "string").alias("summary"),
                      F.coalesce(F.try_variant_get("extracted", "$.fields", "array<variant>"),
                                 F.try_variant_get("extracted", "$.key_fields", "array<variant>"))
                      .alias("_f")).withColumn("n_fields", F.size("_f").cast("bigint")).drop("_f")


CANNED_SQL = ("SELECT status, COUNT(*) AS n, SUM(size_bytes) AS bytes FROM my_documents "
              "WHERE user_id = $1 GROUP BY status")


@query("guarded_select", f"""
SELECT status, COUNT(*) AS n, SUM(size_bytes) AS bytes FROM v_documents
WHERE user_id = {TENANT} GROUP BY status LIMIT 1000""")
def q_guarded_select(fx):
    """A canned chat question through the guard, over the tenant views."""
    return guarded_select(fx.spark, CANNED_SQL, TENANT, docs=fx.v_documents, types=fx.v_document_types)


TEXT_ERR_SQL = "CASE WHEN text IS NULL OR length(text) = 0 THEN 'OCR: sin texto' END"


def _ocr_docs(fx):
    d = fx.documents
    err = F.when(F.col("text").isNull() | (F.length("text") == 0), F.lit("OCR: sin texto"))
    return d.select("doc_id", "lang", "source", "n_chars", "text").withColumn("error", err)


@query("usable_text", f"""
SELECT doc_id, lang, n_chars FROM (SELECT *, {TEXT_ERR_SQL} AS error FROM documents)
WHERE error IS NULL AND text IS NOT NULL AND length(text) > 0""")
def q_usable_text(fx):
    """Documents without an OCR error and with text."""
    return G.usable_text(_ocr_docs(fx)).select("doc_id", "lang", "n_chars")


@query("visible_columns", """
SELECT document_type_id, filename, status, inferred_type, size_bytes, created_at FROM v_documents""")
def q_visible_columns(fx):
    """Internal columns dropped from a result."""
    return G.visible_columns(fx.v_documents)


@query("split_errors", f"""
SELECT doc_id, error, error IS NULL AS ok FROM (SELECT *, {TEXT_ERR_SQL} AS error FROM documents)""")
def q_split_errors(fx):
    """Ok and failed rows of one plan, tagged."""
    return G.tag_errors(_ocr_docs(fx)).select("doc_id", "error", "ok")


@query("pending_only_guard", """
WITH req AS (SELECT id AS doc_id, user_id FROM v_documents UNION ALL SELECT id, user_id + 1 FROM v_documents)
SELECT r.doc_id, r.user_id,
  EXISTS (SELECT 1 FROM v_documents d WHERE d.id = r.doc_id AND d.user_id = r.user_id
          AND d.status = 'pending_confirmation') AS accepted
FROM req r""")
def q_pending_only_guard(fx):
    """Requests by owner and by another tenant; only pending docs of
    the owner are accepted."""
    d = fx.v_documents
    req = d.select(F.col("id").alias("doc_id"), "user_id").unionByName(
        d.select(F.col("id").alias("doc_id"), (F.col("user_id") + 1).alias("user_id")))
    return G.tag_pending(req, d)
