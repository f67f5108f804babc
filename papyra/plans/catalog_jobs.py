"""Registered queries: composed jobs (K1-K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut_lineage
from . import changes as CH
from . import jobs as K
from .catalog_gates import TENANT
from .catalog_model import J3_CTE, KEY_SQL, LINE_RE, SLUG_SQL_FN, convert_sql, j2_sql
from .catalog_stats import NORM_TYPE_SQL
from .registry import query

VALUE_LINE_SQL = r"\d{2,}|@|\$\s*\d+|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"
UP_CTE = """
up0 AS (SELECT doc_id, CAST(floor(doc_id / 8) % 50 AS BIGINT) AS user_id, CAST(floor(doc_id / 8) AS BIGINT) AS batch_id,
        concat('doc_', CAST(doc_id AS VARCHAR), ['.pdf', '.png', '.jpg', '.webp', '.gif'][doc_id % 5 + 1]) AS filename,
        CAST(length(text) * 200 AS BIGINT) AS size_bytes, text FROM v_labeled_documents),
up AS (SELECT *, CASE lower(string_split(filename, '.')[-1]) WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png'
        WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' WHEN 'csv' THEN 'text/csv'
        WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM up0)"""


# J2's columns as the rule below answers: what it says, and what that matches.
MODEL_J2 = """
cat AS (SELECT * FROM v_type_catalogue),
says AS (SELECT doc_id, CASE WHEN contains(text, chr(10) || 'Folio: ') THEN 'folio' WHEN contains(text, chr(10) || 'Referencia Pedido: ') THEN 'ref'
           WHEN contains(text, chr(10) || 'Emitido el: ') THEN 'date' ELSE 'none' END AS kind FROM v_labeled_documents),
j2 AS (SELECT doc_id, kind, CASE kind WHEN 'folio' THEN 1 WHEN 'ref' THEN 2 END AS best_type_id,
         CASE kind WHEN 'folio' THEN 'Venta' WHEN 'ref' THEN 'Pedido' END AS best_type_name,
         CASE kind WHEN 'folio' THEN 0.9 WHEN 'ref' THEN 0.8 WHEN 'date' THEN 0.95 ELSE 0.0 END AS score,
         kind IN ('date', 'none') AS is_others,
         CASE kind WHEN 'folio' THEN 'Venta' WHEN 'ref' THEN 'pedido de compra' WHEN 'date' THEN 'Recibo Simple' END AS answer
       FROM says)"""


def k1_cte(threshold: float = 0.7) -> str:
    return f"""{j2_sql(threshold)},{J3_CTE},{UP_CTE},
g1 AS (SELECT *, CASE WHEN size_bytes > 10485760 THEN concat('El archivo "', filename, '" pesa ', printf('%.1f', size_bytes / 1048576.0),
          'MB. El tamaño máximo permitido es 10MB.')
        WHEN mime NOT IN ('application/pdf', 'image/jpeg', 'image/jpg', 'image/png', 'image/webp')
        THEN concat('Formato no soportado: "', mime, '". Solo se permiten archivos PDF e imágenes (JPEG, PNG, WebP).') END AS gate_error
      FROM up),
q1 AS (SELECT doc_id, CASE WHEN length(text) < 100 THEN false
        ELSE len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{VALUE_LINE_SQL}'))) / len(string_split(text, chr(10))) >= 0.2 END AS quality_ok
       FROM up),
pm AS (SELECT doc_id, count(value) AS populated FROM j3 GROUP BY 1),
po AS (SELECT l.doc_id, count(*) FILTER (WHERE l.raw_value <> '') AS populated FROM lines3 l JOIN j2 USING (doc_id) WHERE j2.is_others GROUP BY 1),
pop AS (SELECT * FROM pm UNION ALL SELECT * FROM po),
k1x AS (SELECT g1.*, j2.best_type_id, j2.best_type_name, j2.score, j2.is_others, q1.quality_ok, pop.populated,
          CASE WHEN g1.gate_error IS NULL THEN CASE WHEN j2.is_others THEN 'Otros Documentos' ELSE j2.best_type_name END END AS tname
        FROM g1 LEFT JOIN j2 USING (doc_id) LEFT JOIN q1 USING (doc_id) LEFT JOIN pop USING (doc_id)),
k1 AS (
  SELECT doc_id, user_id, CASE WHEN gate_error IS NULL THEN 'completed' ELSE 'error' END AS status, gate_error,
    CASE WHEN gate_error IS NULL THEN CASE WHEN quality_ok THEN 'standard' WHEN mime = 'application/pdf' THEN 'standard_low_quality'
      ELSE 'vision' END END AS route,
    CASE WHEN gate_error IS NULL THEN CASE WHEN NOT quality_ok AND mime <> 'application/pdf' THEN 0.90 ELSE 0.95 END END AS ocr_confidence,
    CASE WHEN gate_error IS NULL AND NOT is_others THEN best_type_id END AS document_type_id,
    tname AS document_type_name,
    CASE WHEN gate_error IS NULL THEN score END AS confidence,
    CASE WHEN gate_error IS NULL THEN is_others END AS is_others,
    CASE WHEN tname IS NOT NULL THEN concat_ws('/', CAST(user_id AS VARCHAR), 'tipos', {SLUG_SQL_FN('tname')}, filename) END AS typed_key,
    CASE WHEN gate_error IS NULL THEN coalesce(populated, 0) END AS populated,
    CASE WHEN gate_error IS NULL THEN CASE WHEN score > 0 THEN best_type_name ELSE 'Documento Sin Clasificar' END END AS inferred_type
  FROM k1x)"""


# ---- K1 with a caller's function: a rule that answers as a model would
def label_rule(prompt: str) -> str:
    if "\nFolio: " in prompt:
        return '{"inferred_type": "Venta", "confidence": 0.9}'
    if "\nReferencia Pedido: " in prompt:
        return 'Claro:\n```json\n{"inferred_type": "pedido de compra", "confidence": 0.8,}\n```'
    if "\nEmitido el: " in prompt:
        return "{'inferred_type': 'Recibo Simple', 'confidence': 0.95}"
    raise ValueError("sin datos")


MODEL_K1_CTE = f"""{k1_cte().replace(j2_sql(0.7), MODEL_J2)},
k1m AS (
  SELECT k1.* REPLACE (
      CASE WHEN k1.gate_error IS NULL AND kind = 'none' THEN 'error' ELSE k1.status END AS status,
      coalesce(k1.gate_error, CASE WHEN kind = 'none' THEN 'ValueError: sin datos' END) AS gate_error,
      CASE WHEN kind <> 'none' THEN route END AS route, CASE WHEN kind <> 'none' THEN ocr_confidence END AS ocr_confidence,
      CASE WHEN kind <> 'none' THEN document_type_name END AS document_type_name,
      CASE WHEN kind <> 'none' THEN confidence END AS confidence, CASE WHEN kind <> 'none' THEN k1.is_others END AS is_others,
      CASE WHEN kind <> 'none' THEN typed_key END AS typed_key, CASE WHEN kind <> 'none' THEN populated END AS populated,
      CASE WHEN k1.gate_error IS NULL AND kind <> 'none' THEN answer END AS inferred_type)
  FROM k1 JOIN j2 USING (doc_id))"""


@query("process_documents_model", f"WITH {MODEL_K1_CTE}\nSELECT * FROM k1m")
def q_process_documents_model(fx):
    """K1 with a caller's function: prompt, one call per distinct prompt,
    reply repaired, low confidence and unknown names to Others, failures per
    row."""
    return K.process_documents(_uploads(fx), fx.v_type_catalogue, model=label_rule)


def _uploads(fx):
    return K.uploads_from_documents(fx.v_labeled_documents)


@query("process_documents", f"WITH {k1_cte()}\nSELECT * FROM k1")
def q_process_documents(fx):
    """K1: every uploaded document through gate, classification, routing,
    extraction and typed storage key."""
    return K.process_documents(_uploads(fx), fx.v_type_catalogue)


@query("usage_counter", f"""WITH {k1_cte()}
SELECT user_id, count(*) AS docs_used FROM k1 WHERE status = 'completed' GROUP BY user_id""")
def q_usage_counter(fx):
    """I5 (batch form): successful documents per user."""
    return K.usage_increments(K.process_documents(_uploads(fx), fx.v_type_catalogue))


K2_ROWS = f"""{k1_cte()},
un AS (SELECT doc_id, user_id, coalesce(nullif(inferred_type, ''), nullif(inferred_type, ''), 'Desconocido') AS group_key
       FROM k1 WHERE status = 'completed' AND is_others),
cnt2 AS (SELECT user_id, group_key AS variant, count(*) AS n FROM un GROUP BY 1, 2),
key2 AS (SELECT *, {KEY_SQL.format(c='variant')} AS hkey FROM cnt2),
canon2 AS (SELECT user_id, hkey, variant AS canonical FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, hkey ORDER BY n DESC, length(variant), variant) AS rn FROM key2) WHERE rn = 1),
map2 AS (SELECT k.user_id, k.variant, c.canonical FROM key2 k JOIN canon2 c USING (user_id, hkey)),
rows2 AS (
  SELECT doc_id, user_id, status, gate_error AS message, CAST(NULL AS VARCHAR) AS group_name, CAST(NULL AS INTEGER) AS document_type_id,
         CAST(NULL AS VARCHAR) AS document_type_name FROM k1 WHERE status = 'error'
  UNION ALL SELECT u.doc_id, u.user_id, 'pending_confirmation', NULL, coalesce(m.canonical, u.group_key), NULL, NULL
         FROM un u LEFT JOIN map2 m ON m.user_id = u.user_id AND m.variant = u.group_key
  UNION ALL SELECT doc_id, user_id, status, NULL, NULL, document_type_id, document_type_name FROM k1
         WHERE status = 'completed' AND NOT is_others)"""


@query("process_batch", f"WITH {K2_ROWS}\nSELECT * FROM rows2")
def q_process_batch(fx):
    """K2: matched → completed, unmatched → pending groups, gate → error."""
    rows, _ = K.process_batch(_uploads(fx), fx.v_type_catalogue)
    return rows


@query("process_batch_summary", f"""WITH {K2_ROWS}
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS processed,
  count(*) FILTER (WHERE status = 'pending_confirmation') AS pending, count(*) FILTER (WHERE status = 'error') AS errors
FROM rows2 GROUP BY user_id""")
def q_process_batch_summary(fx):
    """Per tenant batch totals."""
    _, summary = K.process_batch(_uploads(fx), fx.v_type_catalogue)
    return summary


FIELD_NAME_SQL = ("regexp_replace(regexp_replace(strip_accents(lower(trim({c}))), '[^a-z0-9]+', '_', 'g'), "
                  "'^_+|_+$', '', 'g')")
GUESS_SQL = (r"CASE WHEN regexp_matches(trim({c}), '^(\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})$') THEN 'date' "
             r"WHEN regexp_matches(regexp_replace(trim({c}), '^[$€]\s*', ''), '^-?[0-9][0-9.,]*$') THEN 'number' "
             r"ELSE 'string' END")
K3_CTE = f"""{j2_sql()},{UP_CTE},
f3 AS (SELECT doc_id, user_id, batch_id, filename, size_bytes, mime, text,
         CASE WHEN mime NOT IN ('application/pdf', 'image/png', 'image/jpeg', 'image/jpg') THEN printf('Tipo no permitido: %s (%s)', filename, mime)
              WHEN size_bytes > 10485760 THEN printf('Archivo muy grande: %s', filename) END AS file_error FROM up),
b3 AS (SELECT batch_id, count(*) AS n_files, count(*) FILTER (WHERE file_error IS NULL) AS n_valid FROM f3 GROUP BY 1),
kept3 AS (SELECT f3.* FROM f3 JOIN b3 USING (batch_id) WHERE b3.n_files BETWEEN 2 AND 10 AND b3.n_valid > 0 AND f3.file_error IS NULL),
h3 AS (SELECT *, concat(CAST(batch_id AS VARCHAR), ':', sha256(text)) AS ch FROM kept3),
first3 AS (SELECT ch, min(doc_id) AS doc_id FROM h3 GROUP BY 1),
d0 AS (SELECT h3.* FROM h3 JOIN first3 USING (ch, doc_id) WHERE text IS NOT NULL AND length(text) > 0),
d1 AS (SELECT d0.doc_id, d0.user_id, d0.batch_id, d0.text,
         CASE WHEN NOT j2.is_others THEN j2.best_type_name ELSE 'Documento Sin Clasificar' END AS inferred_name
       FROM d0 JOIN j2 USING (doc_id)),
hc3 AS (SELECT user_id, inferred_name AS variant, count(*) AS n FROM d1 GROUP BY 1, 2),
hk3 AS (SELECT *, {KEY_SQL.format(c='variant')} AS hkey FROM hc3),
hcan3 AS (SELECT user_id, hkey, variant AS canonical FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, hkey ORDER BY n DESC, length(variant), variant) AS rn FROM hk3) WHERE rn = 1),
hmap3 AS (SELECT hk3.user_id, hk3.variant, hcan3.canonical FROM hk3 JOIN hcan3 USING (user_id, hkey)),
d2 AS (SELECT d1.*, coalesce(m.canonical, d1.inferred_name) AS type_name FROM d1
       LEFT JOIN hmap3 m ON m.user_id = d1.user_id AND m.variant = d1.inferred_name),
catn AS (SELECT min(type_id) AS existing_type_id, lower(trim(type_name)) AS low_name FROM v_type_catalogue GROUP BY 2),
d3 AS (SELECT d2.*, catn.existing_type_id, catn.existing_type_id IS NULL AS is_new FROM d2 LEFT JOIN catn ON lower(trim(d2.type_name)) = low_name),
rl3 AS (SELECT doc_id, regexp_extract_all(text, '{LINE_RE}', 0) AS ls FROM d3),
ll3 AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM rl3),
lk3 AS (SELECT doc_id, line_no, lower(trim(regexp_extract(line, '^([^:\n]+):', 1))) AS label_key,
          trim(regexp_extract(line, '^[^:\n]+:[ \t]*(.*)$', 1)) AS raw_value FROM ll3),
kf3 AS (SELECT l.doc_id, concat(CAST(d3.batch_id AS VARCHAR), '|', d3.type_name) AS grp,
          {FIELD_NAME_SQL.format(c='l.label_key')} AS name, {GUESS_SQL.format(c='l.raw_value')} AS type, l.raw_value AS value
        FROM lk3 l JOIN d3 USING (doc_id) WHERE d3.is_new),
kf4 AS (SELECT * FROM kf3 WHERE name <> ''),
base3 AS (SELECT grp, name, doc_id, {NORM_TYPE_SQL} AS t, count(*) AS c FROM kf4 GROUP BY 1, 2, 3, 4),
nd3 AS (SELECT grp, count(DISTINCT doc_id) AS n FROM base3 GROUP BY 1),
hv3 AS (SELECT grp, name, count(DISTINCT doc_id) AS have FROM base3 GROUP BY 1, 2),
tc3 AS (SELECT grp, name, t, sum(c) AS tc FROM base3 GROUP BY 1, 2, 3),
bt3 AS (SELECT grp, name, t FROM (SELECT *, row_number() OVER (PARTITION BY grp, name ORDER BY tc DESC, t) AS r FROM tc3) WHERE r = 1),
o3 AS (SELECT hv3.grp, hv3.name, bt3.t AS type, round(hv3.have / nd3.n, 6) AS frequency FROM hv3 JOIN bt3 USING (grp, name) JOIN nd3 USING (grp)),
nsch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY frequency DESC, name) AS position FROM o3) WHERE position <= 30),
dn3 AS (SELECT doc_id, concat(CAST(batch_id AS VARCHAR), '|', type_name) AS grp FROM d3 WHERE is_new),
vn3 AS (SELECT doc_id, name AS field, min(value) AS raw FROM kf4 GROUP BY 1, 2),
sn3 AS (SELECT dn3.doc_id, nsch.name AS field, nsch.type AS ftype FROM dn3 JOIN nsch USING (grp)),
cn3 AS (SELECT sn3.doc_id, {convert_sql('vn3.raw', 'sn3.ftype')} AS value FROM sn3
        LEFT JOIN vn3 ON sn3.doc_id = vn3.doc_id AND sn3.field = vn3.field),
de3 AS (SELECT doc_id, existing_type_id AS type_id FROM d3 WHERE NOT is_new),
keys3e AS (SELECT DISTINCT type_id, name AS field, lower(trim(label)) AS label_key FROM v_type_catalogue
           UNION SELECT type_id, name, lower(trim(name)) FROM v_type_catalogue),
cand3e AS (SELECT l.doc_id, k.field, l.line_no, l.raw_value FROM lk3 l JOIN de3 USING (doc_id)
           JOIN keys3e k ON k.type_id = de3.type_id AND k.label_key = l.label_key),
fv3 AS (SELECT doc_id, field, arg_min(raw_value, line_no) AS raw_value FROM cand3e GROUP BY 1, 2),
so3 AS (SELECT de3.doc_id, c.name AS field, c.type AS ftype FROM de3 JOIN v_type_catalogue c ON c.type_id = de3.type_id),
co3 AS (SELECT so3.doc_id, {convert_sql('fv3.raw_value', 'so3.ftype')} AS value FROM so3
        LEFT JOIN fv3 ON so3.doc_id = fv3.doc_id AND so3.field = fv3.field),
pop3 AS (SELECT doc_id, count(value) AS populated, count(*) AS n_fields FROM (SELECT * FROM cn3 UNION ALL SELECT * FROM co3) GROUP BY 1),
docs3 AS (SELECT d3.doc_id, d3.user_id, d3.batch_id, d3.type_name, d3.is_new, coalesce(pop3.n_fields, 0) AS n_fields,
            coalesce(pop3.populated, 0) AS populated,
            CASE WHEN coalesce(pop3.populated, 0) > 0 THEN 'completed' ELSE 'error' END AS status,
            CASE WHEN coalesce(pop3.populated, 0) > 0 THEN 0.95 ELSE 0.5 END AS confidence
          FROM d3 LEFT JOIN pop3 USING (doc_id))"""


@query("infer_types", f"""WITH {K3_CTE}
SELECT user_id, batch_id, type_name, is_new, max(n_fields) AS field_count, count(*) AS sample_count
FROM docs3 GROUP BY user_id, batch_id, type_name, is_new""")
def q_infer_types(fx):
    """K3 (flagship): infer document types from sample batches: per batch
    and type, new or existing, field count and sample count."""
    _, report = K.infer_types(_uploads(fx), fx.v_type_catalogue)
    return report


@query("infer_types_documents", f"WITH {K3_CTE}\nSELECT * FROM docs3")
def q_infer_types_documents(fx):
    """K3: per sample document its type, conformed field count and status."""
    docs, _ = K.infer_types(_uploads(fx), fx.v_type_catalogue)
    return docs


MODEL_K3_CTE = K3_CTE.replace(j2_sql(), MODEL_J2).replace(
    "CASE WHEN NOT j2.is_others THEN j2.best_type_name ELSE 'Documento Sin Clasificar' END AS inferred_name",
    "coalesce(CASE WHEN NOT j2.is_others THEN j2.best_type_name END, j2.answer, 'Documento Sin Clasificar') AS inferred_name")


@query("infer_types_model", f"""WITH {MODEL_K3_CTE}
SELECT user_id, batch_id, type_name, is_new, max(n_fields) AS field_count, count(*) AS sample_count
FROM docs3 GROUP BY user_id, batch_id, type_name, is_new""")
def q_infer_types_model(fx):
    """K3 with a caller's function: new names come from its answers."""
    _, report = K.infer_types(_uploads(fx), fx.v_type_catalogue, model=label_rule)
    return report


CONFIRM_REQ_SQL = """
SELECT id AS doc_id, CASE WHEN id % 7 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
  CASE id % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'assign_type' ELSE 'create_type' END AS action,
  CASE WHEN id % 3 = 1 AND id % 5 <> 0 THEN user_id * 10 + (id % 5) + 1 END AS type_id,
  CASE WHEN id % 3 = 2 AND id % 4 = 0 THEN concat('Tipo ', inferred_type) WHEN id % 3 = 2 AND id % 4 = 1 THEN '' END AS type_name
FROM v_documents"""


# Parts that K4 and K5 share: fields of a document, schema of a type, what a
# document holds after it is extracted again (``chosen``: doc_id, type_id).
STORED_CTE = """
parsed AS (SELECT id, json_extract_string(extracted_data, '$.summary') AS summary,
  from_json(coalesce(json_extract(extracted_data, '$.fields'), json_extract(extracted_data, '$.key_fields')),
            '[{"name":"VARCHAR","type":"VARCHAR","value":"VARCHAR"}]') AS fs FROM v_documents),
held AS (SELECT id AS doc_id, unnest(range(1, len(fs) + 1)) AS pos, unnest(fs) AS f FROM parsed)"""


def _made_cte(type_expr: str, described: str) -> str:
    return f"""
firsts AS (SELECT user_id, name, min(doc_id) AS doc_id FROM wanted GROUP BY 1, 2),
made AS (
  SELECT (SELECT max(id) FROM v_types) + row_number() OVER (ORDER BY w.user_id, w.name) AS id, w.user_id, w.name, {described} AS description,
    to_json({{'fields': list({{'name': h.name, 'type': h.ntype, 'label': h.name, 'required': false, 'description': ''}} ORDER BY pos)}})::VARCHAR AS field_schema
  FROM firsts w JOIN parsed p ON p.id = w.doc_id JOIN (SELECT doc_id, pos, f.name AS name, {type_expr} AS ntype FROM (SELECT *, f.type AS type FROM held)) h
    ON h.doc_id = w.doc_id GROUP BY w.user_id, w.name, p.summary),
types_after AS (SELECT id, user_id, name, description, field_schema FROM v_types UNION ALL SELECT * FROM made)"""


IMAGE_CTE = f"""
schemas AS (SELECT id AS type_id, unnest(range(1, len(fs) + 1)) AS position, unnest(fs) AS s FROM (
  SELECT id, from_json(json_extract(field_schema, '$.fields'), '[{{"name":"VARCHAR","type":"VARCHAR"}}]') AS fs FROM types_after)),
vals AS (SELECT doc_id, f.name AS name, min(f.value) AS value FROM held GROUP BY 1, 2),
slots AS (SELECT c.doc_id, position, s.name AS field, s.type AS ftype, v.value AS raw FROM chosen c JOIN schemas USING (type_id)
          LEFT JOIN vals v ON v.doc_id = c.doc_id AND v.name = s.name),
conf AS (SELECT doc_id, position, field, ftype, {convert_sql('raw', 'ftype')} AS value FROM slots),
packed AS (SELECT doc_id, count(nullif(value, '')) AS populated,
             to_json(list({{'name': field, 'type': ftype, 'value': value}} ORDER BY position))::VARCHAR AS fields FROM conf GROUP BY 1),
images AS (SELECT c.doc_id, c.type_id, coalesce(populated, 0) AS populated,
             concat('{{"summary":', coalesce(to_json(p.summary)::VARCHAR, 'null'), ',"fields":', coalesce(fields, '[]'), '}}') AS data
           FROM chosen c JOIN parsed p ON p.id = c.doc_id LEFT JOIN packed USING (doc_id))"""

AFTER_SQL = """SELECT id, user_id, CAST(coalesce(i.type_id, document_type_id) AS BIGINT) AS document_type_id, filename,
  CASE WHEN i.doc_id IS NOT NULL THEN 'completed' ELSE status END AS status, confidence_score, inferred_type, size_bytes,
  coalesce(i.data, extracted_data) AS extracted_data, created_at
FROM v_documents LEFT JOIN images i ON i.doc_id = id"""

CONFIRM_CTE = f"""
r AS ({CONFIRM_REQ_SQL}),
j AS (SELECT r.*, d.user_id AS owner, d.status, d.filename,
        CASE WHEN action = 'create_type' THEN coalesce(nullif(r.type_name, ''), nullif(d.inferred_type, ''), 'Tipo Sin Nombre')
             WHEN action = 'assign_type' THEN a.name END AS final_name, a.id AS aid
      FROM r LEFT JOIN v_documents d ON r.doc_id = d.id AND r.user_id = d.user_id
      LEFT JOIN v_types a ON r.type_id = a.id AND r.user_id = a.user_id),
bn AS (SELECT user_id AS nu, name AS nn, min(id) AS nid FROM v_types GROUP BY 1, 2),
res AS (SELECT *, CASE WHEN owner IS NULL OR status <> 'pending_confirmation' THEN 'error' WHEN action = 'cancel' THEN 'deleted'
                       WHEN action = 'assign_type' AND aid IS NULL THEN 'error' ELSE 'completed' END AS result
        FROM j LEFT JOIN bn ON nu = user_id AND nn = final_name),{STORED_CTE},
wanted AS (SELECT user_id, final_name AS name, doc_id FROM res WHERE result = 'completed' AND action = 'create_type' AND nid IS NULL),
{_made_cte(NORM_TYPE_SQL, "coalesce(nullif(p.summary, ''), concat('Tipo \"', w.name, '\" creado desde batch'))").strip()},
chosen AS (SELECT res.doc_id, coalesce(CASE WHEN action = 'assign_type' THEN aid END, nid, m.id) AS type_id
           FROM res LEFT JOIN made m ON m.user_id = res.user_id AND m.name = final_name WHERE result = 'completed'),
{IMAGE_CTE.strip()}"""


def _confirm(fx):
    d = fx.v_documents
    req = d.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "cancel").when(F.col("id") % 3 == 1, "assign_type")
        .otherwise("create_type").alias("action"),
        F.when((F.col("id") % 3 == 1) & (F.col("id") % 5 != 0), F.col("user_id") * 10 + F.col("id") % 5 + 1)
        .alias("type_id"),
        F.when((F.col("id") % 3 == 2) & (F.col("id") % 4 == 0), F.concat(F.lit("Tipo "), F.col("inferred_type")))
        .when((F.col("id") % 3 == 2) & (F.col("id") % 4 == 1), F.lit("")).alias("type_name"))
    return CH.confirm_changes(req, d, fx.v_types)


@query("confirm_types", f"""
WITH {CONFIRM_CTE}
SELECT res.doc_id, user_id, action, result, c.type_id,
  CASE WHEN result = 'completed' THEN final_name END AS type_name,
  (result = 'completed' AND action = 'create_type' AND nid IS NULL) AS new_type,
  CASE WHEN result = 'completed' AND action = 'assign_type' THEN i.populated = 0 END AS low_confidence,
  CASE WHEN result = 'completed' THEN concat_ws('/', CAST(user_id AS VARCHAR), 'tipos', {SLUG_SQL_FN('final_name')}, filename) END AS typed_key,
  CASE WHEN owner IS NULL THEN 'Documento no encontrado'
       WHEN status <> 'pending_confirmation' THEN printf('El documento no está pendiente de confirmación (status: %s)', status)
       WHEN action = 'assign_type' AND r_type IS NULL THEN 'typeId es requerido para assign_type'
       WHEN action = 'assign_type' AND aid IS NULL THEN 'Tipo de documento no encontrado' END AS message
FROM (SELECT *, type_id AS r_type FROM res) res LEFT JOIN (SELECT doc_id, type_id FROM chosen) c ON c.doc_id = res.doc_id
LEFT JOIN images i ON i.doc_id = res.doc_id""")
def q_confirm_types(fx):
    """K4: create / assign / cancel requests against every document."""
    return _confirm(fx).results


@query("confirm_documents", f"""
WITH {CONFIRM_CTE}
{AFTER_SQL} WHERE id NOT IN (SELECT doc_id FROM res WHERE result = 'deleted')""")
def q_confirm_documents(fx):
    """K4: the document table after the requests: completed ones extracted
    again to their type's schema, cancelled ones gone."""
    return CH.apply_changes(fx.v_documents, fx.v_types, _confirm(fx))[0]


@query("confirm_type_table", f"WITH {CONFIRM_CTE}\nSELECT * FROM types_after")
def q_confirm_type_table(fx):
    """K4: the type table after the requests, new types with their ids."""
    return CH.apply_changes(fx.v_documents, fx.v_types, _confirm(fx))[1]


RESOLVE_SQL = """
  SELECT id AS document_id, CASE WHEN id % 7 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
    CASE WHEN id % 4 = 1 THEN concat(inferred_type, ' nuevo') ELSE inferred_type END AS type_name,
    CASE WHEN id % 2 = 0 THEN user_id * 10 + (id % 5) + 1 END AS type_id
  FROM v_documents WHERE status = 'pending_confirmation'"""


@query("resolve_pending", f"""
WITH a AS ({RESOLVE_SQL})
SELECT a.user_id, count(*) AS total, count(d.id) AS completed
FROM a LEFT JOIN v_documents d ON a.document_id = d.id AND a.user_id = d.user_id GROUP BY a.user_id""")
def q_resolve_pending(fx):
    """K5: assignments resolved, with the per-tenant completion summary."""
    _, summary = K.resolve_pending(_assignments(fx), fx.v_documents, fx.v_document_types)
    return summary


def _assignments(fx):
    return fx.v_documents.filter(F.col("status") == "pending_confirmation").select(
        F.col("id").alias("document_id"),
        F.when(F.col("id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("id") % 4 == 1, F.concat("inferred_type", F.lit(" nuevo")))
        .otherwise(F.col("inferred_type")).alias("type_name"),
        F.when(F.col("id") % 2 == 0, F.col("user_id") * 10 + F.col("id") % 5 + 1).alias("type_id"))


RESOLVE_CTE = f"""
a AS ({RESOLVE_SQL}),
bn AS (SELECT user_id AS nu, name AS nn, min(id) AS nid FROM v_types GROUP BY 1, 2),
ra AS (SELECT a.document_id AS doc_id, a.user_id, type_name AS name, CASE WHEN type_id IS NOT NULL THEN t.id ELSE nid END AS known
       FROM a JOIN v_documents d ON d.id = a.document_id AND d.user_id = a.user_id
       LEFT JOIN v_types t ON t.id = a.type_id AND t.user_id = a.user_id
       LEFT JOIN bn ON a.type_id IS NULL AND nu = a.user_id AND nn = a.type_name),{STORED_CTE},
wanted AS (SELECT user_id, name, doc_id FROM ra WHERE known IS NULL),
{_made_cte("coalesce(nullif(type, ''), 'string')", "concat('Tipo \"', w.name, '\" creado desde procesamiento batch')").strip()},
chosen AS (SELECT ra.doc_id, coalesce(known, m.id) AS type_id FROM ra LEFT JOIN made m ON m.user_id = ra.user_id AND m.name = ra.name),
{IMAGE_CTE.strip()}"""


@query("resolve_documents", f"WITH {RESOLVE_CTE}\n{AFTER_SQL}")
def q_resolve_documents(fx):
    """K5: the document table after the assignments."""
    return CH.apply_changes(fx.v_documents, fx.v_types, CH.resolve_changes(_assignments(fx), fx.v_documents, fx.v_types))[0]


@query("resolve_type_table", f"WITH {RESOLVE_CTE}\nSELECT * FROM types_after")
def q_resolve_type_table(fx):
    """K5: the type table after the assignments."""
    return CH.apply_changes(fx.v_documents, fx.v_types, CH.resolve_changes(_assignments(fx), fx.v_documents, fx.v_types))[1]


FILED_CTE = f"""{k1_cte()},
need AS (SELECT DISTINCT user_id FROM k1 WHERE status = 'completed' AND is_others),
own AS (SELECT user_id, min(id) AS id FROM v_types WHERE name = 'Otros Documentos' GROUP BY 1),
made AS (SELECT (SELECT max(id) FROM v_types) + row_number() OVER (ORDER BY user_id) AS id, user_id, 'Otros Documentos' AS name,
           '{CH.OTHERS_DESCRIPTION}' AS description, '{CH.OTHERS_SCHEMA}' AS field_schema
         FROM need WHERE user_id NOT IN (SELECT user_id FROM own)),
catch_all AS (SELECT user_id, id FROM own UNION ALL SELECT user_id, id FROM made)"""


@query("process_documents_filed", f"""WITH {FILED_CTE}
SELECT k1.* REPLACE (CAST(CASE WHEN status = 'completed' AND is_others THEN c.id ELSE document_type_id END AS INTEGER) AS document_type_id)
FROM k1 LEFT JOIN catch_all c ON c.user_id = k1.user_id""")
def q_process_documents_filed(fx):
    """K1 applied: documents that match no type are filed under their
    tenant's catch-all type (A4 by document id)."""
    table = cut_lineage(K.process_documents(_uploads(fx), fx.v_type_catalogue))
    return CH.apply_changes(table, fx.v_types, CH.file_others(table, fx.v_types), "doc_id", "doc_id")[0]


@query("process_type_table", f"""WITH {FILED_CTE}
SELECT id, user_id, name, description, field_schema FROM v_types UNION ALL SELECT * FROM made""")
def q_process_type_table(fx):
    """K1 applied: the type table with the catch-all types it made, one per
    tenant that had none."""
    table = cut_lineage(K.process_documents(_uploads(fx), fx.v_type_catalogue))
    return CH.apply_changes(table, fx.v_types, CH.file_others(table, fx.v_types), "doc_id", "doc_id")[1]


K1_CTE_NAMES = ("cat var vt dt hits found nf sc best names j2 dtyp raw3 lines3 keys3 cand3 firstv slots3 j3 "
                "up0 up g1 q1 pm po pop k1x k1").split()


def k1_cte_renamed(threshold: float, suffix: str) -> str:
    """The K1 CTE chain with every CTE name suffixed (a second copy in one
    statement; none of the names is also a column name or inside a literal)."""
    import re
    sql = k1_cte(threshold)
    pattern = re.compile(r"\b(" + "|".join(sorted(K1_CTE_NAMES, key=len, reverse=True)) + r")\b")
    return pattern.sub(lambda m: m.group(1) + suffix, sql)


REPROCESS_SQL = f"""WITH {k1_cte()},
{k1_cte_renamed(0.5, '_r')},
ids AS (SELECT doc_id FROM k1 WHERE status = 'completed' AND is_others),
again AS (SELECT doc_id, user_id, CASE WHEN status = 'completed' AND is_others THEN 'pending_confirmation' ELSE status END AS status,
            gate_error, route, ocr_confidence, document_type_id, document_type_name, confidence, is_others, typed_key, populated,
            inferred_type FROM k1_r WHERE doc_id IN (SELECT doc_id FROM ids))
SELECT * FROM k1 WHERE doc_id NOT IN (SELECT doc_id FROM ids)
UNION ALL SELECT * FROM again"""


@query("reprocess", REPROCESS_SQL)
def q_reprocess(fx):
    """K6: documents filed under Others re-run with a 0.5 threshold; still
    unmatched ones go to pending_confirmation."""
    up = _uploads(fx)
    table = K.process_documents(up, fx.v_type_catalogue)
    ids = table.filter((F.col("status") == "completed") & F.col("is_others")).select("doc_id")
    return K.reprocess(table, up, ids, fx.v_type_catalogue, threshold=0.5)


ASK_SQL = "SELECT id, filename, status, created_at FROM my_documents WHERE user_id = $1 ORDER BY created_at DESC"


@query("ask", f"""
SELECT filename, status, created_at FROM v_documents WHERE user_id = {TENANT} ORDER BY created_at DESC LIMIT 1000""")
def q_ask(fx):
    """K7: a chat question answered by guarded SQL, capped, internal columns hidden."""
    return K.ask(fx.spark, ASK_SQL, TENANT, fx.v_documents, fx.v_document_types)
