"""Registered queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..session import cut_lineage
from ..operators import model as MD
from ..operators import stats as S
from ..sources import catalogue as CAT
from ..sources import objects as O
from ..sources import tables as TB
from .catalog_gates import TENANT
from .catalog_model import CONFORM_CTE, SLUG_SQL_FN
from .catalog_stats import TENANT_TYPE
from .registry import query


@query("scan_documents", f"SELECT * FROM v_documents WHERE user_id = {TENANT}")
def q_scan_documents(fx):
    """A1: the tenant's documents, newest first."""
    return TB.scan_documents(fx.v_documents, TENANT)


@query("list_files", f"""
SELECT key, size_bytes, string_split(key, '/')[-1] AS filename FROM v_object_keys WHERE starts_with(key, '{TENANT}/')""")
def q_list_files(fx):
    """A2: the tenant's objects with file names."""
    return O.list_files(fx.v_object_keys.select("key", "size_bytes"), TENANT)


@query("audit_extracted_objects", """
SELECT string_split(key, '/')[1] AS tenant, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes
FROM v_object_keys WHERE string_split(key, '/')[2] = 'extracted' GROUP BY 1""")
def q_audit_extracted(fx):
    """A3: leftover extracted/ objects per tenant."""
    return O.audit_extracted_objects(fx.v_object_keys.select("key", "size_bytes"))


@query("upsert_documents", """
WITH base AS (SELECT id, user_id, status, document_type_id, created_at AS updated_at, 0 AS src FROM v_documents),
ch AS (SELECT id, user_id, 'completed' AS status, document_type_id, created_at + INTERVAL 1 DAY AS updated_at, 1 AS src
       FROM v_documents WHERE status = 'queued'
       UNION ALL SELECT id + 100000000, user_id, 'queued', CAST(NULL AS BIGINT), created_at, 1 FROM v_documents WHERE status = 'error'),
u AS (SELECT * FROM base UNION ALL SELECT * FROM ch)
SELECT id, user_id, status, document_type_id, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, src DESC) AS rn FROM u) WHERE rn = 1""")
def q_upsert_documents(fx):
    """A4: processed queue rows replace theirs; failed documents uploaded
    again arrive as new rows and insert."""
    d = fx.v_documents
    base = d.select("id", "user_id", "status", "document_type_id", F.col("created_at").alias("updated_at"))
    done = d.filter(F.col("status") == "queued").select(
        "id", "user_id", F.lit("completed").alias("status"), "document_type_id",
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    new = d.filter(F.col("status") == "error").select(
        (F.col("id") + 100000000).alias("id"), "user_id", F.lit("queued").alias("status"),
        F.lit(None).cast("bigint").alias("document_type_id"), F.col("created_at").alias("updated_at"))
    return TB.upsert_documents(base, done.unionByName(new))


DELETE_SQL = "SELECT id FROM v_document_types WHERE name = 'LOW'"


@query("cascade_delete", f"""
SELECT d.id, d.user_id, d.document_type_id FROM v_documents d
WHERE NOT EXISTS (SELECT 1 FROM ({DELETE_SQL}) x WHERE x.id = d.document_type_id)""")
def q_cascade_delete(fx):
    """A5: documents left after deleting every 'LOW' type with cascade."""
    ids = fx.v_document_types.filter(F.col("name") == "LOW").select("id")
    _, docs = TB.cascade_delete(fx.v_document_types, fx.v_documents.select("id", "user_id", "document_type_id"), ids)
    return docs


@query("delete_guard", f"""
SELECT t.id, t.user_id, t.name, c.documents FROM v_document_types t
JOIN (SELECT document_type_id AS id, count(*) AS documents FROM v_documents GROUP BY 1) c ON c.id = t.id
WHERE t.id IN ({DELETE_SQL})""")
def q_delete_guard(fx):
    """A5: plain deletes refused because the type still has documents."""
    ids = fx.v_document_types.filter(F.col("name") == "LOW").select("id")
    return TB.delete_guard(fx.v_document_types, fx.v_documents, ids)


@query("export_fields", f"""
WITH {CONFORM_CTE}
SELECT doc_id, type_name, max(CASE WHEN field = 'cliente' THEN value END) AS cliente,
  max(CASE WHEN field = 'estado' THEN value END) AS estado, max(CASE WHEN field = 'fecha' THEN value END) AS fecha,
  max(CASE WHEN field = 'total' THEN value END) AS total
FROM conf GROUP BY doc_id, type_name""")
def q_export_fields(fx):
    """Conformed documents as a wide table, one column per field."""
    # the schema is at most 30 fields per type: materialised once, it gives
    # the (bounded) column list of the pivot and drives the conform step
    schema = cut_lineage(S.consolidate_schema(fx.v_fields, TENANT_TYPE))
    conformed = MD.conform_fields(None, schema, fx.v_fields, type_col=TENANT_TYPE)
    names = sorted({r["name"] for r in schema.select("name").distinct().collect()})
    return TB.export_fields(conformed, names)


@query("typed_layout", f"""
WITH t AS (SELECT d.id, d.user_id, d.filename, x.name AS type_name FROM v_documents d JOIN v_document_types x ON d.document_type_id = x.id),
k AS (SELECT *, concat_ws('/', CAST(user_id AS VARCHAR), 'tipos', {SLUG_SQL_FN('type_name')}, filename) AS typed_key,
             {SLUG_SQL_FN('type_name')} AS type_slug FROM t)
SELECT id, typed_key, type_slug, count(*) OVER (PARTITION BY typed_key) > 1 AS collision FROM k""")
def q_typed_layout(fx):
    """Typed keys, slugs and key collisions."""
    d = M.docs_with_type(fx.v_documents, fx.v_document_types)
    return O.typed_layout(d).select("id", "typed_key", "type_slug", "collision")


@query("ingest_documents", """
SELECT concat('doc_', CAST(doc_id AS VARCHAR), '.txt') AS filename, 'text/plain' AS mime,
  CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS content_hash FROM documents""")
def q_ingest_documents(fx):
    """Document texts as uploaded files: name, type, size, hash."""
    files = fx.documents.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                                F.col("text").alias("content"))
    return O.ingest_rows(files).drop("content")


PASTE_SQL = """
WITH f AS (SELECT DISTINCT type_name, name, type FROM v_fields),
l AS (SELECT type_name, name, concat(name, chr(9), CASE WHEN name = 'estado' THEN '' ELSE upper(substr(name, 1, 1)) || substr(name, 2) END,
        chr(9), CASE lower(type) WHEN 'number' THEN 'Numero' WHEN 'currency' THEN 'moneda' WHEN 'datetime' THEN 'fecha' ELSE 'texto' END,
        chr(9), CASE WHEN name = 'total' THEN 'Sí' WHEN name = 'fecha' THEN '1' ELSE 'no' END, chr(9), ' Campo ', name, ' ') AS line FROM f)
SELECT type_name, string_agg(line, chr(10) ORDER BY name, line) || chr(10) || '   ' || chr(10) AS text FROM l GROUP BY type_name"""


def _pastes(fx):
    f = fx.v_fields.select("type_name", "name", "type").distinct()
    line = F.concat(F.col("name"), F.lit("\t"),
                    F.when(F.col("name") == "estado", F.lit(""))
                    .otherwise(F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 1 << 20))),
                    F.lit("\t"),
                    F.when(F.lower("type") == "number", "Numero").when(F.lower("type") == "currency", "moneda")
                    .when(F.lower("type") == "datetime", "fecha").otherwise("texto"),
                    F.lit("\t"),
                    F.when(F.col("name") == "total", "Sí").when(F.col("name") == "fecha", "1").otherwise("no"),
                    F.lit("\t"), F.lit(" Campo "), F.col("name"), F.lit(" "))
    g = f.withColumn("line", line).groupBy("type_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda s: s["line"]), "\n")
        .alias("text"))
    return g.withColumn("text", F.concat("text", F.lit("\n   \n")))


@query("load_type_catalogue", f"""
WITH p AS ({PASTE_SQL}),
r AS (SELECT type_name, unnest(string_split(text, chr(10))) AS row, unnest(range(len(string_split(text, chr(10))))) AS row_no FROM p),
c AS (SELECT type_name, row_no, string_split(row, chr(9)) AS cols FROM r WHERE regexp_replace(row, '^\\s+|\\s+$', '', 'g') <> ''),
t AS (SELECT type_name, row_no, list_transform(cols, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS c FROM c)
SELECT type_name, coalesce(c[1], '') AS name, coalesce(nullif(c[2], ''), nullif(c[1], ''), '') AS label,
  CASE lower(c[3]) WHEN 'numero' THEN 'number' WHEN 'number' THEN 'number' WHEN 'fecha' THEN 'date' WHEN 'date' THEN 'date'
    WHEN 'booleano' THEN 'boolean' WHEN 'boolean' THEN 'boolean' WHEN 'lista' THEN 'array' WHEN 'array' THEN 'array'
    ELSE 'string' END AS type,
  coalesce(lower(c[4]) IN ('si', 'sí', 'true', '1'), false) AS required, coalesce(nullif(c[5], ''), '') AS description,
  row_number() OVER (PARTITION BY type_name ORDER BY row_no) AS position
FROM t""")
def q_load_type_catalogue(fx):
    """Pasted tab-separated schemas parsed into field definitions."""
    return CAT.parse_catalogue(_pastes(fx))
