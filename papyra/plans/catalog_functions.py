"""Registered queries: scalar functions (H) and display expressions (R)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import display as R
from ..functions import fields as H
from ..functions import json_repair as J
from ..functions import text as X
from ..operators import matching as M
from ..sources.fixtures import ASOF_ORDERS
from .catalog_stats import STAGE_COST_SQL, TOK_SQL
from .registry import query

CLEAN_SQL = r"""
WITH c AS (SELECT id, regexp_replace(regexp_replace(response, '(?m)^```(?:json)?\s*\n?', '', 'g'), '(?m)\n?```\s*$', '', 'g') AS t
           FROM v_responses),
s AS (SELECT id, nullif(regexp_extract(t, '\{[\s\S]*\}', 0), '') AS span FROM c),
k AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(span, ',(\s*[}\]])', '\1', 'g'), '(?m)//.*$', '', 'g'),
                 '/\*[\s\S]*?\*/', '', 'g') AS j FROM s)"""


@query("parse_model_json", CLEAN_SQL + """
SELECT id, coalesce(json_valid(j), false) AS parsed_ok,
  CASE WHEN json_valid(j) THEN json_extract_string(j, '$.inferred_type') END AS inferred_type,
  CASE WHEN json_valid(j) THEN TRY_CAST(json_extract_string(j, '$.n') AS BIGINT) END AS n
FROM k""")
def q_parse_model_json(fx):
    """H1: model replies with fences, prose, trailing commas, dicts, no JSON."""
    v = J.parse_model_json("response", mode="reference")
    r = fx.v_responses.select("id", v.alias("v"))
    return r.select("id", F.col("v").isNotNull().alias("parsed_ok"),
                    J.vget("v", "$.inferred_type").alias("inferred_type"),
                    J.vget("v", "$.n", "bigint").alias("n"))


@query("repair_python_dict", r"""
WITH f AS (SELECT id, response,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(response, '''', '"', 'g'), '\bTrue\b', 'true', 'g'),
    '\bFalse\b', 'false', 'g'), '\bNone\b', 'null', 'g') AS fixed FROM v_responses),
j AS (SELECT id, CASE WHEN json_valid(response) THEN response WHEN json_valid(fixed) THEN fixed END AS j FROM f)
SELECT id, j IS NOT NULL AS repaired_ok, json_extract_string(j, '$.inferred_type') AS inferred_type,
  TRY_CAST(json_extract_string(j, '$.ok') AS BOOLEAN) AS ok_flag FROM j""")
def q_repair_python_dict(fx):
    """H2: plain parse, else quote and keyword repair, else null."""
    r = fx.v_responses.select("id", J.repair_python_dict("response").alias("v"))
    return r.select("id", F.col("v").isNotNull().alias("repaired_ok"),
                    J.vget("v", "$.inferred_type").alias("inferred_type"),
                    J.vget("v", "$.ok", "boolean").alias("ok_flag"))


@query("json_summary", "SELECT id, json_extract_string(extracted_data, '$.summary') AS summary FROM v_documents")
def q_json_summary(fx):
    """H4: the stored extraction's summary."""
    return fx.v_documents.select("id", J.json_summary("extracted_data").alias("summary"))


SLUG_SQL = "trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', '-', 'g'), '-')"


@query("slugify", f"""
SELECT 'part' AS src, p_partkey AS key, {SLUG_SQL.format(c='p_name')} AS slug FROM part
UNION ALL SELECT 'doc', doc_id, {SLUG_SQL.format(c='text')} FROM documents""")
def q_slugify(fx):
    """H5: part names and whole document texts (four languages)."""
    p = fx.part.select(F.lit("part").alias("src"), F.col("p_partkey").alias("key"), X.slugify("p_name").alias("slug"))
    d = fx.documents.select(F.lit("doc").alias("src"), F.col("doc_id").alias("key"), X.slugify("text").alias("slug"))
    return p.unionByName(d)


@query("storage_keys", f"""
SELECT d.id, concat_ws('/', CAST(d.user_id AS VARCHAR), 'originals', d.filename) AS storage_key,
  CASE WHEN t.name IS NOT NULL THEN concat_ws('/', CAST(d.user_id AS VARCHAR), 'tipos', {SLUG_SQL.format(c='t.name')}, d.filename) END AS typed_key
FROM v_documents d LEFT JOIN v_document_types t ON d.document_type_id = t.id""")
def q_storage_keys(fx):
    """H6, H7: object key and typed key of every document."""
    d = M.docs_with_type(fx.v_documents, fx.v_document_types)
    return d.select("id", X.storage_key("user_id", F.lit("originals"), "filename").alias("storage_key"),
                    F.when(F.col("document_type_name").isNotNull(),
                           X.typed_key("user_id", "document_type_name", "filename")).alias("typed_key"))


NORM_TYPE_SQL = """CASE WHEN lower(trim(type)) IN ('number','integer','float','currency') THEN 'number'
  WHEN lower(trim(type)) IN ('date','datetime','timestamp') THEN 'date'
  WHEN lower(trim(type)) IN ('boolean','bool') THEN 'boolean'
  WHEN lower(trim(type)) IN ('array','list') THEN 'array' ELSE 'string' END"""


@query("normalize_field_type", f"SELECT doc_id, name, type, {NORM_TYPE_SQL} AS normalized FROM v_fields")
def q_normalize_field_type(fx):
    """H8: field type synonyms normalised."""
    return fx.v_fields.select("doc_id", "name", "type", H.normalize_field_type("type").alias("normalized"))


@query("is_others", """
SELECT doc_id, confidence, is_others AS flagged,
  coalesce(is_others, false) OR coalesce(confidence < 0.7, false) AS others
FROM v_classified""")
def q_is_others(fx):
    """Default threshold 0.7; a missing confidence passes."""
    c = fx.v_classified
    return c.select("doc_id", "confidence", F.col("is_others").alias("flagged"),
                    H.is_others("is_others", "confidence").alias("others"))


@query("truncate_marked", """
SELECT doc_id,
  md5(concat(substr(text, 1, 2000), CASE WHEN length(text) > 2000 THEN chr(10) || '...(truncado)' ELSE '' END)) AS t2000,
  md5(concat(substr(text, 1, 3000), CASE WHEN length(text) > 3000 THEN '...(truncated)' ELSE '' END)) AS t3000,
  length(concat(substr(text, 1, 6000), CASE WHEN length(text) > 6000 THEN '...(truncated)' ELSE '' END)) AS len6000
FROM documents""")
def q_truncate_marked(fx):
    """The three prompt truncations."""
    d = fx.documents
    return d.select("doc_id",
                    F.md5(X.truncate_marked("text", 2000, "\n...(truncado)")).alias("t2000"),
                    F.md5(X.truncate_marked("text", 3000, "...(truncated)")).alias("t3000"),
                    F.length(X.truncate_marked("text", 6000, "...(truncated)")).cast("bigint").alias("len6000"))


@query("join_pages", """
WITH p AS (SELECT conv_id, turn, coalesce(nullif(text, ''), '') AS t FROM conversations),
j AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) || '--- PÁGINA ---' || chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> '') AS txt,
      count(*) AS pages FROM p GROUP BY conv_id)
SELECT conv_id, pages, md5(coalesce(txt, '')) AS text_md5, length(coalesce(txt, '')) AS text_len,
  CASE WHEN txt IS NULL OR length(txt) = 0 THEN 'no_text' END AS error FROM j""")
def q_join_pages(fx):
    """One text per conversation (its turns as pages)."""
    c = fx.conversations.select("conv_id", "turn", X.page_text(F.lit(None).cast("string"), "text").alias("t"))
    g = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", "t"))),
                                          lambda s: s.getField("t") != ""),
                                 lambda s: s.getField("t")), X.PAGE_SEPARATOR).alias("txt"))
    return g.select("conv_id", "pages", F.md5("txt").alias("text_md5"), F.length("txt").cast("bigint").alias("text_len"),
                    F.when(F.length("txt") == 0, F.lit("no_text")).alias("error"))


VALUE_LINE_SQL = r"\d{2,}|@|\$\s*\d+|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"


@query("text_quality", f"""
SELECT doc_id,
  round(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{VALUE_LINE_SQL}'))) / len(string_split(text, chr(10))), 6) AS value_ratio,
  CASE WHEN length(text) < 100 THEN false
       ELSE len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{VALUE_LINE_SQL}'))) / len(string_split(text, chr(10))) >= 0.2 END AS quality_ok
FROM documents""")
def q_text_quality(fx):
    """H13 over whole documents."""
    d = fx.documents
    return d.select("doc_id", F.round(X.value_line_ratio("text"), 6).alias("value_ratio"),
                    X.text_quality("text").alias("quality_ok"))


@query("stage_cost", f"""
SELECT event_id, {TOK_SQL.format(c='input_chars')} AS input_tokens, {TOK_SQL.format(c='output_chars')} AS output_tokens,
  round({STAGE_COST_SQL}, 9) AS cost_usd FROM v_stage_metrics""")
def q_stage_cost(fx):
    """Token estimates and stage cost of every pipeline stage."""
    s = fx.v_stage_metrics
    return s.select("event_id", H.token_estimate("input_chars").alias("input_tokens"),
                    H.token_estimate("output_chars").alias("output_tokens"),
                    F.round(H.stage_cost("provider", "pages", "is_vision", "input_chars", "output_chars"), 9)
                    .alias("cost_usd"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def q_content_hash(fx):
    """Hex SHA-256 of every document text."""
    return fx.documents.select("doc_id", X.content_hash("text").alias("content_hash"))


EXT_SQL = "lower(string_split(filename, '.')[-1])"


@query("file_estimates", f"""
SELECT id, CASE {EXT_SQL} WHEN 'pdf' THEN 1.2 * 1024 * 1024 WHEN 'png' THEN 800.0 * 1024 WHEN 'jpg' THEN 800.0 * 1024
  WHEN 'jpeg' THEN 800.0 * 1024 WHEN 'webp' THEN 800.0 * 1024 WHEN 'xlsx' THEN 200.0 * 1024 WHEN 'csv' THEN 200.0 * 1024
  ELSE 500.0 * 1024 END AS est_bytes,
  CASE WHEN ends_with(lower(filename), '.pdf') THEN 'application/pdf' ELSE 'image/jpeg' END AS mime
FROM v_documents""")
def q_file_estimates(fx):
    """Estimated size and assumed MIME type by file name."""
    return fx.v_documents.select("id", X.estimate_size("filename").alias("est_bytes"),
                                 X.mime_from_name("filename").alias("mime"))


@query("usage_percent", """
WITH pl AS (SELECT * FROM (VALUES ('free', 50), ('starter', 500), ('pro', 1000), ('enterprise', -1)) AS t(plan, lim))
SELECT s.user_id, CAST(CASE WHEN pl.lim IS NULL OR pl.lim <= 0 THEN 0
  ELSE floor(s.docs_used_this_period / pl.lim * 100 + 0.5) END AS BIGINT) AS usage_percent
FROM v_subscriptions s LEFT JOIN pl ON s.plan = pl.plan""")
def q_usage_percent(fx):
    """Plan usage percent (unlimited or no limit → 0)."""
    from ..schemas import plan_limits_df
    j = M.plan_limits_join(fx.v_subscriptions, plan_limits_df(fx.spark))
    return j.select("user_id", H.usage_percent("docs_used_this_period", "docs_per_month").alias("usage_percent"))


@query("display_fields", """
SELECT id, CASE WHEN json_extract(extracted_data, '$.fields') IS NOT NULL THEN 'fields'
  WHEN json_extract(extracted_data, '$.key_fields') IS NOT NULL THEN 'key_fields' END AS source,
  coalesce(json_array_length(coalesce(json_extract(extracted_data, '$.fields'), json_extract(extracted_data, '$.key_fields'))), 0) AS n_fields
FROM v_documents""")
def q_display_fields(fx):
    """Fields, else key_fields, else []."""
    e = H.parse_extracted("extracted_data")
    d = fx.v_documents.select("id", e.alias("e"))
    return d.select("id", F.when(F.col("e.fields").isNotNull(), "fields")
                    .when(F.col("e.key_fields").isNotNull(), "key_fields").alias("source"),
                    F.size(H.display_fields("e")).cast("bigint").alias("n_fields"))


@query("utc_timestamp", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
                                 ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS raw FROM events)
SELECT event_id, raw, strftime(CAST(replace(raw, 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS utc_text FROM r""")
def q_utc_timestamp(fx):
    """Timestamps written with and without 'Z' read as UTC."""
    e = fx.events
    fmt = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(F.col("event_id") % 2 == 0, fmt).otherwise(F.concat(fmt, F.lit("Z")))
    r = e.select("event_id", raw.alias("raw"))
    return r.select("event_id", "raw", F.date_format(H.utc_timestamp("raw"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("utc_text"))


@query("add_month", """
SELECT id, created_at, created_at + INTERVAL 1 MONTH AS next_period_end FROM v_documents""")
def q_add_month(fx):
    """+ 1 calendar month (month ends clamp)."""
    return fx.v_documents.select("id", "created_at", H.add_month("created_at").alias("next_period_end"))


@query("field_defaults", """
WITH x AS (SELECT id, unnest(from_json(coalesce(json_extract(extracted_data, '$.fields'), json_extract(extracted_data, '$.key_fields')),
  '[{"name":"VARCHAR","type":"VARCHAR","label":"VARCHAR","required":"BOOLEAN","description":"VARCHAR"}]')) AS f FROM v_documents)
SELECT id, f.name AS name, coalesce(nullif(f.type, ''), 'string') AS type, coalesce(nullif(f.label, ''), f.name) AS label,
  coalesce(f.required, false) AS required, coalesce(f.description, '') AS description FROM x""")
def q_field_defaults(fx):
    """Defaults filled for every stored field."""
    d = fx.v_documents.select("id", H.field_defaults(H.display_fields(H.parse_extracted("extracted_data"))).alias("fs"))
    return d.select("id", F.explode("fs").alias("f")).select("id", "f.name", "f.type", "f.label", "f.required",
                                                             "f.description")


ERR_MSG_SQL = """CASE event_type WHEN 'error' THEN 'Mistral OCR: No se pudo extraer texto del documento'
  WHEN 'view' THEN 'Gemini: Failed to parse classification' WHEN 'click' THEN concat('socket hang up ', props)
  WHEN 'purchase' THEN 'RESOURCE EXHAUSTED: quota' ELSE 'unexpected response' END"""
ERR_STATUS_SQL = "CASE WHEN event_id % 7 = 0 THEN 429 WHEN event_id % 11 = 0 THEN 503 WHEN event_id % 13 = 0 THEN 404 ELSE 200 END"


def _call_log(fx):
    e = fx.events
    msg = (F.when(F.col("event_type") == "error", F.lit("Mistral OCR: No se pudo extraer texto del documento"))
           .when(F.col("event_type") == "view", F.lit("Gemini: Failed to parse classification"))
           .when(F.col("event_type") == "click", F.concat(F.lit("socket hang up "), F.col("props")))
           .when(F.col("event_type") == "purchase", F.lit("RESOURCE EXHAUSTED: quota"))
           .otherwise(F.lit("unexpected response")))
    st = (F.when(F.col("event_id") % 7 == 0, 429).when(F.col("event_id") % 11 == 0, 503)
          .when(F.col("event_id") % 13 == 0, 404).otherwise(200))
    return e.select("event_id", msg.alias("message"), st.alias("status"))


@query("failure_category", f"""
SELECT event_id, CASE WHEN contains(m, 'No se pudo extraer texto') OR contains(m, 'Mistral') OR contains(m, 'OCR') THEN 'ocr'
  WHEN contains(m, 'Gemini') OR contains(m, 'Failed to parse') OR contains(m, 'generateContent') THEN 'model' ELSE 'other' END AS category
FROM (SELECT event_id, {ERR_MSG_SQL} AS m FROM events)""")
def q_failure_category(fx):
    """Failure category (ocr / model / other) from the error message."""
    return _call_log(fx).select("event_id", R.failure_category("message").alias("category"))


@query("is_retryable", f"""
SELECT event_id, status IN (429, 500, 502, 503) OR contains(lower(m), 'econnreset') OR contains(lower(m), 'econnrefused')
  OR contains(lower(m), 'etimedout') OR contains(lower(m), 'socket hang up') OR contains(lower(m), 'resource exhausted')
  OR contains(lower(m), 'rate limit') OR contains(lower(m), 'quota') AS retryable
FROM (SELECT event_id, {ERR_MSG_SQL} AS m, {ERR_STATUS_SQL} AS status FROM events)""")
def q_is_retryable(fx):
    """Retryable calls by status code or message phrase."""
    return _call_log(fx).select("event_id", R.is_retryable("status", "message").alias("retryable"))


@query("round_confidence", """
SELECT doc_id, CAST(CAST(confidence AS DECIMAL(5,2)) AS DOUBLE) AS confidence_score,
  printf('%.1f%%', CAST(confidence AS DOUBLE) * 100) AS confidence_text FROM v_classified""")
def q_round_confidence(fx):
    """Confidence as decimal(5,2) and as percent text."""
    c = fx.v_classified
    return c.select("doc_id", H.round_confidence("confidence").cast("double").alias("confidence_score"),
                    H.confidence_percent_text("confidence").alias("confidence_text"))


MONTHS_SQL = "['" + "','".join(R.MONTHS_ES) + "']"
MONTHS_SHORT_SQL = "['" + "','".join(R.MONTHS_ES_SHORT) + "']"
LABELS_SQL = ("CASE {e} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.FILE_TYPE_LABELS.items())
              + " ELSE coalesce(nullif(upper({e}), ''), 'Archivo') END")


def _bytes_sql(c):
    i = f"CAST(floor(ln({c}) / ln(1024.0)) AS INTEGER)"
    r = f"(floor({c} / pow(1024.0, {i}) * 10 + 0.5) / 10)"
    return (f"CASE WHEN {c} = 0 THEN '0 B' ELSE concat(CASE WHEN {r} = floor({r}) THEN CAST(CAST(floor({r}) AS BIGINT) AS VARCHAR) "
            f"ELSE printf('%.1f', {r}) END, ' ', ['B','KB','MB','GB'][{i} + 1]) END")


@query("report_documents", f"""
WITH d AS (SELECT *, (epoch_us(TIMESTAMP '{ASOF_ORDERS}') - epoch_us(created_at)) / 1000 AS diff_ms FROM v_documents)
SELECT id,
  replace(format('{{:,}}', size_bytes), ',', '.') AS size_es,
  concat(CAST(day(created_at) AS VARCHAR), ' de ', {MONTHS_SQL}[month(created_at)], ' de ', CAST(year(created_at) AS VARCHAR)) AS date_es,
  CASE WHEN floor(diff_ms / 60000) < 1 THEN 'Hace un momento'
       WHEN floor(diff_ms / 60000) < 60 THEN printf('Hace %d min', CAST(floor(diff_ms / 60000) AS BIGINT))
       WHEN floor(diff_ms / 3600000) < 24 THEN printf('Hace %dh', CAST(floor(diff_ms / 3600000) AS BIGINT))
       WHEN floor(diff_ms / 86400000) < 7 THEN printf('Hace %dd', CAST(floor(diff_ms / 86400000) AS BIGINT))
       ELSE concat(lpad(CAST(day(created_at) AS VARCHAR), 2, '0'), ' ', {MONTHS_SHORT_SQL}[month(created_at)]) END AS relative,
  {_bytes_sql('size_bytes')} AS size_text,
  {LABELS_SQL.format(e=EXT_SQL)} AS file_type,
  lower(regexp_replace(replace(status, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS status_text,
  CASE WHEN status = 'completed' THEN printf('Documento "%s" procesado exitosamente', filename)
       WHEN status = 'processing' THEN printf('Procesando documento "%s"', filename)
       ELSE printf('Error al procesar "%s"', filename) END AS activity,
  CASE status WHEN 'completed' THEN 'Completo' WHEN 'processing' THEN 'En proceso' WHEN 'pending_confirmation' THEN 'Pendiente'
       WHEN 'queued' THEN 'En cola' WHEN 'error' THEN 'Error' ELSE status END AS status_label,
  CASE status WHEN 'completed' THEN 'Procesado' WHEN 'processing' THEN 'Pendiente' WHEN 'error' THEN 'Error' ELSE status END AS storage_label
FROM d""")
def q_report_documents(fx):
    """R1-R4, R6-R9 over every document."""
    from ..operators.listing import activity_text
    d = fx.v_documents
    now = F.lit(ASOF_ORDERS).cast("timestamp_ntz")
    return d.select("id", R.format_number_es("size_bytes").alias("size_es"),
                    R.format_date_es("created_at").alias("date_es"),
                    R.relative_time("created_at", now).alias("relative"),
                    R.format_bytes("size_bytes").alias("size_text"),
                    R.file_type_label("filename").alias("file_type"),
                    R.column_label("status").alias("status_text"),
                    activity_text("status", "filename").alias("activity"),
                    R.status_label("status").alias("status_label"),
                    R.status_label("status", "storage").alias("storage_label"))


VALUE_VARIANT_FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()),
                                                 T.StructField("value", T.VariantType())]))


@query("report_fields", """
WITH x AS (SELECT id, unnest(CAST(coalesce(json_extract(extracted_data, '$.fields'), json_extract(extracted_data, '$.key_fields')) AS JSON[])) AS f
           FROM v_documents)
SELECT id, json_extract_string(f, '$.name') AS name,
  CASE WHEN json_extract(f, '$.value') IS NULL OR json_type(json_extract(f, '$.value')) = 'NULL' THEN 'Sin valor'
       WHEN json_type(json_extract(f, '$.value')) = 'BOOLEAN' THEN CASE WHEN CAST(json_extract(f, '$.value') AS BOOLEAN) THEN 'Sí' ELSE 'No' END
       WHEN json_type(json_extract(f, '$.value')) = 'ARRAY' THEN array_to_string(CAST(json_extract(f, '$.value') AS VARCHAR[]), ', ')
       ELSE json_extract_string(f, '$.value') END AS rendered
FROM x""")
def q_report_fields(fx):
    """Every stored field value rendered for display."""
    parsed = J.strict_parse_json("extracted_data")
    arr = F.coalesce(F.try_variant_get(parsed, "$.fields", "array<variant>"),
                     F.try_variant_get(parsed, "$.key_fields", "array<variant>"))
    d = fx.v_documents.select("id", F.explode(arr).alias("f"))
    return d.select("id", F.try_variant_get("f", "$.name", "string").alias("name"),
                    R.render_value(F.try_variant_get("f", "$.value", "variant")).alias("rendered"))
