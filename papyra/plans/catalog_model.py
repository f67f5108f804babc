"""Registered queries: model stage and baseline (J1-J6), homologation
(D8, C7, G3) and catalogue text (D20, H31)."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from ..operators import answers as AN
from ..operators import cosine as CO
from ..operators import model as MD
from ..operators import prompts as PR
from ..operators import stats as S
from ..session import ensure_checkpoint_dir
from .catalog_stats import D7_SQL, TENANT_TYPE
from .registry import query

TOK = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


# ---------------------------------------------------------------- J1
@query("model_stage", """
WITH p AS (SELECT doc_id, text AS prompt FROM documents)
SELECT doc_id, CASE WHEN length(prompt) >= 100 THEN printf('chars=%d;mod=%d', length(prompt), length(prompt) % 100) END AS response,
  CASE WHEN length(prompt) < 100 THEN 'ValueError: texto insuficiente' END AS error FROM p""")
def q_model_stage(fx):
    """A batch function over unique prompts (Arrow batches), failures
    isolated per row, answers joined back to every document."""
    rows = fx.documents.select("doc_id", F.col("text").alias("prompt"))
    parallelism = int(fx.spark.conf.get("spark.sql.shuffle.partitions"))
    return MD.model_stage(rows, _length_model, partitions=parallelism).select("doc_id", "response", "error")


@query("model_answers", """
SELECT doc_id, CASE WHEN length(text) >= 100 THEN printf('chars=%d;mod=%d', length(text), length(text) % 100) END AS response,
  CASE WHEN length(text) < 100 THEN 'ValueError: texto insuficiente' END AS error FROM documents""")
def q_model_answers(fx):
    """J1 with stored answers: prompts without an answer are called, a few a
    task, and every task's answers are kept from its commit on; then all
    answers are joined back."""
    store = f"{ensure_checkpoint_dir(fx.spark)}/answers-{uuid.uuid4().hex}"
    rows = fx.documents.select("doc_id", F.col("text").alias("prompt"))
    return AN.stored_model_stage(rows, _length_model, store, "length", calls_per_task=2000).select("doc_id", "response", "error")


def _length_model(text: str) -> str:
    if len(text) < 100:
        raise ValueError("texto insuficiente")
    return "chars=%d;mod=%d" % (len(text), len(text) % 100)


# ---------------------------------------------------------------- J2
def j2_sql(threshold: float = 0.7) -> str:
    return J2_TEMPLATE.replace("@THR", repr(threshold))


J2_TEMPLATE = f"""
cat AS (SELECT * FROM v_type_catalogue),
var AS (SELECT type_id, name AS field, 'label' AS variant, {TOK.format(c='label')} AS toks FROM cat
        UNION ALL SELECT type_id, name, 'name', {TOK.format(c="replace(name, '_', ' ')")} FROM cat),
vt AS (SELECT type_id, field, variant, len(toks) AS n_tokens, unnest(toks) AS token FROM var),
dt AS (SELECT doc_id, unnest({TOK.format(c='text')}) AS token FROM v_labeled_documents),
hits AS (SELECT dt.doc_id, vt.type_id, vt.field, vt.variant, vt.n_tokens, count(*) AS m FROM dt JOIN vt USING (token)
         GROUP BY dt.doc_id, vt.type_id, vt.field, vt.variant, vt.n_tokens),
found AS (SELECT DISTINCT doc_id, type_id, field FROM hits WHERE m = n_tokens),
nf AS (SELECT type_id, count(*) AS n_fields FROM cat GROUP BY 1),
sc AS (SELECT f.doc_id, f.type_id, round(count(*) / any_value(nf.n_fields), 6) AS score FROM found f JOIN nf USING (type_id)
       GROUP BY f.doc_id, f.type_id),
best AS (SELECT doc_id, type_id AS best_type_id, score FROM (
           SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type_id) AS rn FROM sc) WHERE rn = 1),
names AS (SELECT DISTINCT type_id, type_name FROM cat),
j2 AS (
  SELECT d.doc_id, b.best_type_id, n.type_name AS best_type_name, coalesce(b.score, 0.0) AS score,
    coalesce(coalesce(b.score, 0.0) < @THR, false) AS is_others
  FROM v_labeled_documents d LEFT JOIN best b USING (doc_id) LEFT JOIN names n ON b.best_type_id = n.type_id)"""


def _classified(fx):
    return MD.lexical_classify(fx.v_labeled_documents, fx.v_type_catalogue)


J2_SQL = j2_sql()


@query("lexical_classify", f"WITH {J2_SQL}\nSELECT * FROM j2")
def q_lexical_classify(fx):
    """Token-overlap classification against the catalogue."""
    return _classified(fx)


# ---------------------------------------------------------------- J3
DMY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
CONVERT_TEMPLATE = r"""CASE WHEN @R IS NULL OR @R = '' THEN NULL
  WHEN @T = 'date' THEN CAST(TRY_CAST(CASE WHEN regexp_extract(@R, '@DMY', 0) <> ''
        THEN printf('%s-%s-%s', regexp_extract(@R, '@DMY', 3), lpad(regexp_extract(@R, '@DMY', 2), 2, '0'),
                    lpad(regexp_extract(@R, '@DMY', 1), 2, '0'))
        ELSE regexp_extract(@R, '^(\d{4}-\d{2}-\d{2})', 1) END AS DATE) AS VARCHAR)
  WHEN @T = 'number' THEN nullif(regexp_extract(CASE
        WHEN regexp_matches(@C, '^[^,]*,[^,]*$') AND regexp_matches(@C, ',[^.]*$') THEN replace(replace(@C, '.', ''), ',', '.')
        WHEN regexp_matches(@C, '^[^.]*[.][^.]*$') AND regexp_matches(@C, '[.][^,]*$') THEN replace(@C, ',', '')
        WHEN contains(@C, ',') AND contains(@C, '.') THEN ''
        ELSE replace(replace(@C, ',', ''), '.', '') END, '^-?[0-9]+([.][0-9]+)?$', 0), '')
  WHEN @T = 'boolean' THEN CASE WHEN lower(@R) IN ('si', 'sí', 'true', 'yes', '1') THEN 'true'
        WHEN lower(@R) IN ('no', 'false', '0') THEN 'false' END
  ELSE @R END"""


def convert_sql(r: str, t: str) -> str:
    cleaned = f"regexp_replace({r}, '[^0-9,.\\-]', '', 'g')"
    return CONVERT_TEMPLATE.replace("@DMY", DMY).replace("@C", cleaned).replace("@R", r).replace("@T", t)


LINE_RE = r"(?m)^([^:\n]+):[ \t]*([^\n]*)$"


J3_CTE = f"""
dtyp AS (SELECT doc_id, best_type_id AS type_id FROM j2 WHERE NOT is_others),
raw3 AS (SELECT doc_id, regexp_extract_all(text, '{LINE_RE}', 1) AS ls, regexp_extract_all(text, '{LINE_RE}', 2) AS vs
         FROM v_labeled_documents),
lines3 AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, lower(trim(unnest(ls))) AS label_key, trim(unnest(vs)) AS raw_value FROM raw3),
keys3 AS (SELECT DISTINCT type_id, name AS field, lower(trim(label)) AS label_key FROM cat
          UNION SELECT type_id, name, lower(trim(name)) FROM cat),
cand3 AS (SELECT l.doc_id, k.field, l.line_no, l.raw_value FROM lines3 l JOIN dtyp d USING (doc_id)
          JOIN keys3 k ON k.type_id = d.type_id AND k.label_key = l.label_key),
firstv AS (SELECT doc_id, field, arg_min(raw_value, line_no) AS raw_value FROM cand3 GROUP BY 1, 2),
slots3 AS (SELECT d.doc_id, d.type_id, c.position, c.name AS field, c.type AS ftype FROM dtyp d JOIN cat c ON c.type_id = d.type_id),
j3 AS (SELECT s.doc_id, s.type_id, s.position, s.field, s.ftype, {convert_sql('f.raw_value', 's.ftype')} AS value
       FROM slots3 s LEFT JOIN firstv f ON s.doc_id = f.doc_id AND s.field = f.field)"""


@query("label_value_extract", f"WITH {J2_SQL},{J3_CTE}\nSELECT * FROM j3")
def q_label_value_extract(fx):
    """Values of the classified type's fields from 'Label: value' lines."""
    c = _classified(fx).filter(~F.col("is_others")).select("doc_id", F.col("best_type_id").alias("type_id"))
    return MD.label_value_extract(fx.v_labeled_documents, c, fx.v_type_catalogue)


# ---------------------------------------------------------------- J4, C7, D8, G3
def SLUG_SQL_FN(c: str) -> str:  # noqa: N802 - SQL text builder
    return f"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', '-', 'g'), '-')"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in MD.STOP_WORDS) + "]"
KEY_SQL = ("array_to_string(list_filter(string_split(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', ' ', 'g'), ' '), "
           f"lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w)), '-')")
NAMES_SQL = """SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
  WHEN 2 THEN concat('El ', p_name) ELSE replace(p_name, ' ', '  ') END AS name FROM part"""
J4_SQL = f"""
names AS ({NAMES_SQL}),
cnt AS (SELECT name AS variant, count(*) AS n FROM names GROUP BY 1),
k AS (SELECT *, {KEY_SQL.format(c='variant')} AS group_key FROM cnt),
canon AS (SELECT group_key, variant AS canonical FROM (
  SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY n DESC, length(variant), variant) AS rn FROM k) WHERE rn = 1),
j4 AS (SELECT k.variant, canon.canonical, k.group_key, k.n FROM k JOIN canon USING (group_key))"""


def _names(fx):
    p = fx.part
    name = (F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.upper("p_name"))
            .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("El "), F.col("p_name")))
            .otherwise(F.regexp_replace("p_name", " ", "  ")))
    return p.select("p_partkey", "p_brand", name.alias("name"))


# Names with their vectors: one per embedding, its label as the tenant.
VECTOR_NAMES_SQL = """v AS (SELECT label AS user_id, concat('tipo ', vec_id) AS name, 1 + vec_id % 7 AS n,
  [x::DOUBLE FOR x IN embedding] AS e, vec_id AS id FROM embeddings)"""


@query("homologate_by_embedding", f"""
WITH RECURSIVE {VECTOR_NAMES_SQL},
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.user_id = b.user_id AND a.id <> b.id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, low) AS (SELECT id, id FROM v UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id WHERE r.low < l.b),
grp AS (SELECT id, min(low) AS root FROM reach GROUP BY id),
canon AS (SELECT root, arg_min(name, struct_pack(a := -n, b := length(name), c := name)) AS canonical FROM grp JOIN v USING (id) GROUP BY root)
SELECT user_id, name AS variant, canonical, n FROM v JOIN grp USING (id) JOIN canon USING (root)""")
def q_homologate_by_embedding(fx):
    """J4, cosine form: names whose embeddings are alike share a canonical."""
    names = fx.embeddings.select(F.col("label").alias("user_id"), F.concat(F.lit("tipo "), F.col("vec_id").cast("string")).alias("name"),
                                 (1 + F.col("vec_id") % 7).alias("n"), "embedding")
    return CO.homologate_by_embedding(names, threshold=0.9)


@query("homologate_names", f"WITH {J4_SQL}\nSELECT * FROM j4")
def q_homologate_names(fx):
    """Spelling variants of part names grouped by normalised key."""
    return MD.homologate_names(_names(fx))


@query("apply_canonical", f"""
WITH {J4_SQL}
SELECT n.p_partkey, n.p_brand, n.name, coalesce(j4.canonical, n.name) AS canonical_name
FROM names n LEFT JOIN j4 ON n.name = j4.variant""")
def q_apply_canonical(fx):
    """Every part's name mapped to its canonical."""
    return MD.apply_canonical_names(_names(fx), MD.homologate_names(_names(fx)))


D8_SQL = f"""
{J4_SQL},
model AS (SELECT variant, canonical FROM j4 WHERE variant <> upper(variant)),
one AS (SELECT variant, min(canonical) AS canonical FROM model GROUP BY 1),
dn AS (SELECT DISTINCT name AS variant FROM names),
cov AS (SELECT o.variant, o.canonical, 'model' AS source FROM one o WHERE o.variant IN (SELECT variant FROM dn)
        UNION ALL SELECT variant, variant, 'own_group' FROM dn WHERE variant NOT IN (SELECT variant FROM one))"""


def _coverage(fx):
    names = _names(fx)
    groups = MD.homologate_names(names).filter(F.col("variant") != F.upper("variant"))
    return names, MD.homologation_coverage(names, groups)


@query("homologation_coverage", f"WITH {D8_SQL}\nSELECT * FROM cov")
def q_homologation_coverage(fx):
    """A partial name mapping completed so every name is in one group."""
    return _coverage(fx)[1]


@query("merge_groups", f"""
WITH {D8_SQL},
g AS (SELECT p_brand, name AS group_name, count(*) AS doc_count FROM names GROUP BY 1, 2),
m AS (SELECT g.p_brand, coalesce(c.canonical, g.group_name) AS merged_name, g.doc_count FROM g
      LEFT JOIN (SELECT variant, min(canonical) AS canonical FROM cov GROUP BY 1) c ON g.group_name = c.variant)
SELECT p_brand, merged_name, sum(doc_count) AS doc_count, count(*) AS source_groups FROM m GROUP BY 1, 2""")
def q_merge_groups(fx):
    """Per brand, name groups merged under their canonical names."""
    names, cov = _coverage(fx)
    groups = names.groupBy("p_brand", F.col("name").alias("group_name")).agg(F.count(F.lit(1)).alias("doc_count"))
    out = MD.merge_groups(groups, cov, group_cols=("p_brand",), mapping_keys=())
    return out.withColumn("doc_count", F.col("doc_count").cast("bigint"))


# ---------------------------------------------------------------- J5
CONFORM_CTE = f"""{D7_SQL},
dt5 AS (SELECT DISTINCT doc_id, user_id, type_name FROM v_fields),
v5 AS (SELECT doc_id, name AS field, min(value) AS raw FROM v_fields GROUP BY 1, 2),
slots5 AS (SELECT dt5.doc_id, dt5.user_id, dt5.type_name, sch.position, sch.name AS field, sch.type AS ftype
           FROM dt5 JOIN sch USING (user_id, type_name)),
conf AS (SELECT s.doc_id, s.user_id, s.type_name, s.position, s.field, s.ftype, {convert_sql('v5.raw', 's.ftype')} AS value
         FROM slots5 s LEFT JOIN v5 ON s.doc_id = v5.doc_id AND s.field = v5.field)"""


@query("conform_fields", f"WITH {CONFORM_CTE}\nSELECT * FROM conf")
def q_conform_fields(fx):
    """Every document carries exactly its type's consolidated schema."""
    schema = S.consolidate_schema(fx.v_fields, TENANT_TYPE)
    return MD.conform_fields(None, schema, fx.v_fields, type_col=TENANT_TYPE)


# ---------------------------------------------------------------- J6
VALUE_LINE_SQL = r"\d{2,}|@|\$\s*\d+|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"


@query("ocr_route", f"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'application/pdf' ELSE 'image/png' END AS mime FROM documents),
q AS (SELECT doc_id, mime, CASE WHEN length(text) < 100 THEN false
        ELSE len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{VALUE_LINE_SQL}'))) / len(string_split(text, chr(10))) >= 0.2 END AS quality_ok FROM d)
SELECT doc_id, mime, quality_ok,
  CASE WHEN quality_ok THEN 'standard' WHEN mime = 'application/pdf' THEN 'standard_low_quality' ELSE 'vision' END AS route,
  CASE WHEN NOT quality_ok AND mime <> 'application/pdf' THEN 0.90 ELSE 0.95 END AS ocr_confidence FROM q""")
def q_ocr_route(fx):
    """Standard OCR, low-quality PDF, or vision for images."""
    d = fx.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "application/pdf")
                            .otherwise("image/png").alias("mime"))
    return MD.ocr_route(d).drop("text")


# ---------------------------------------------------------------- D20, H31
@query("schema_context", f"""
WITH {D7_SQL},
cnt AS (SELECT document_type_id AS tid, count(*) AS n FROM v_documents GROUP BY 1),
fl AS (SELECT user_id, type_name, string_agg(printf('    - "%s" (%s): %s%s', name, type, name, CASE WHEN required THEN ' [required]' ELSE '' END),
         chr(10) ORDER BY position) AS fields FROM sch GROUP BY 1, 2),
td AS (SELECT t.user_id, t.id, printf('  Tipo "%s" (id=%d, %d documentos):', t.name, t.id, coalesce(c.n, 0)) || chr(10)
         || coalesce(fl.fields, '    (sin campos definidos)') AS block
       FROM v_document_types t LEFT JOIN cnt c ON c.tid = t.id LEFT JOIN fl ON fl.user_id = t.user_id AND fl.type_name = t.name)
SELECT user_id, 'Tipos de documento del usuario y sus campos extraídos:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY id) AS context
FROM td GROUP BY user_id
UNION ALL
SELECT user_id, printf('El usuario tiene %d documentos sin tipo definido.', count(*) FILTER (WHERE document_type_id IS NULL))
FROM v_documents WHERE user_id NOT IN (SELECT user_id FROM v_document_types) GROUP BY user_id""")
def q_schema_context(fx):
    """Per tenant, its types with document counts and field lists."""
    return MD.schema_context(fx.v_document_types, fx.v_documents, S.consolidate_schema(fx.v_fields, TENANT_TYPE))


@query("build_prompt", """
WITH tl AS (SELECT type_id, type_name, description, string_agg(label, ', ' ORDER BY position) AS labels
            FROM v_type_catalogue GROUP BY 1, 2, 3),
td AS (SELECT string_agg(printf('%d. "%s": %s | Campos: %s', rn, type_name, coalesce(nullif(description, ''), '-'), labels),
              chr(10) ORDER BY rn) AS types_desc
       FROM (SELECT *, row_number() OVER (ORDER BY type_id) AS rn FROM tl)),
p AS (SELECT d.doc_id, 'Classify this document. Available types:' || chr(10) || (SELECT types_desc FROM td) || chr(10) || chr(10)
        || 'Document text:' || chr(10) || substr(d.text, 1, 3000) || CASE WHEN length(d.text) > 3000 THEN '...(truncated)' ELSE '' END AS prompt
      FROM v_labeled_documents d)
SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_len FROM p""")
def q_build_prompt(fx):
    """H31 (classify only): the classification prompt of every document."""
    p = MD.classify_prompts(fx.v_labeled_documents, fx.v_type_catalogue, max_chars=3000)
    return p.select("doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_len"))



# ---------------------------------------------------------------- H31: extract, homologate
def _label_reader(prompt: str) -> str:
    """An offline stand-in for a model: the first ``Label: value`` line of the
    text whose label is the field's label or name."""
    ask, text = prompt.split("Document text:\n", 1)
    found: dict[str, str] = {}
    for label, value in re.findall(r"(?m)^([^:\n]+):[ \t]*([^\n]*)$", text):
        found.setdefault(label.strip(" ").lower(), (len(found), value.strip(" ")))
    fields = []
    for name, label in re.findall(r"(?m)^- (\S+) \([^)]*\): (.*)$", ask):
        hits = [found[k] for k in {name.lower(), label.strip(" ").lower()} if k in found]
        fields.append({"name": name, "value": min(hits)[1] if hits else None})
    return json.dumps({"summary": "", "fields": fields})


@query("extract_model", f"WITH {J2_SQL},{J3_CTE}\nSELECT * FROM j3")
def q_extract_model(fx):
    """H31 extract: a prompt with the fields of each document's type, one call a
    distinct prompt, values read from the reply and conformed to the type."""
    typed = _classified(fx).filter(~F.col("is_others")).select("doc_id", F.col("best_type_id").alias("type_id"))
    values, _ = PR.extract_with_model(fx.v_labeled_documents.select("doc_id", "text").join(typed, "doc_id"), fx.v_type_catalogue, _label_reader)
    return values


def _key_grouper(prompt: str) -> str:
    """An offline stand-in for a model: names of a call with the same words."""
    groups: dict[str, list[str]] = {}
    for name in re.findall(r"(?m)^\d+\. (.*)$", prompt):
        words = [w for w in re.sub("[^a-z0-9]+", " ", name.lower()).split() if w not in MD.STOP_WORDS]
        groups.setdefault(" ".join(words), []).append(name)
    return json.dumps({"groups": groups})


@query("homologate_model", f"""
WITH names AS ({NAMES_SQL}), k AS (SELECT DISTINCT p_brand, name AS variant, {KEY_SQL.format(c='name')} AS key FROM names)
SELECT p_brand, variant, replace(key, '-', ' ') AS canonical FROM k""")
def q_homologate_model(fx):
    """H31 homologate: a brand's names packed into calls, groups of the replies
    merged where they share a name, every name once."""
    return PR.homologate_with_model(_names(fx), _key_grouper, group_cols=["p_brand"], budget=600)
