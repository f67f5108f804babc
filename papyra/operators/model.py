"""The model stage and its deterministic baseline.

* J1 runs a caller-supplied batch function over unique contents with
  ``mapInPandas`` (Arrow batches); per-row failures become an error column.
* J2/J3 are the offline baseline: token joins and ``Label: value`` line
  joins, all equi-joins and partial aggregates.
* J4 groups type names by a normalised key; J5 conforms every document of
  a type to exactly the type's schema (long form, schema order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import effective_threshold
from ..functions.fields import is_others as is_others_expr
from ..functions.text import content_hash, strip_accents, text_quality

# --------------------------------------------------------------------- J1

ModelFn = Callable[[str], str]


def model_stage(rows: DataFrame, fn: ModelFn, text_col="prompt", key_col="doc_id",
                partitions: int | None = None) -> DataFrame:
    """Call ``fn(text) -> response`` once per distinct content and join
    the answers back to every row. ``partitions`` sets call parallelism.
    A failing call yields ``error`` for its rows only."""
    uniq = rows.select(content_hash(text_col).alias("_h"), F.col(text_col).alias("_x")) \
        .groupBy("_h").agg(F.min("_x").alias("_x"))
    if partitions:
        uniq = uniq.repartition(partitions, "_h")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            resp, err = [], []
            for x in b["_x"]:
                try:
                    resp.append(fn(x))
                    err.append(None)
                except Exception as e:  # noqa: BLE001 - one bad row never fails the partition
                    resp.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"_h": b["_h"], "response": resp, "error": err})

    answered = uniq.mapInPandas(call, "_h string, response string, error string")
    keyed = rows.withColumn("_h", content_hash(text_col))
    return keyed.join(answered, "_h", "left").drop("_h")


def demo_model(text: str) -> str:
    """A deterministic stand-in for the external model (tests, benches):
    answers with the text's first word as type and a length-based confidence;
    refuses short texts like a failing call would."""
    if text is None or len(text) < 100:
        raise ValueError("texto insuficiente")
    words = text.split()
    first = words[0] if words else ""
    conf = (len(text) % 100) / 100.0
    return '{"inferred_type":"%s","confidence":%.2f,"chars":%d}' % (first.replace('"', ""), conf, len(text))


# --------------------------------------------------------------------- J2

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text) -> Column:
    """Distinct lower-case letter/digit tokens of a text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda x: x != ""))


def field_variants(catalogue: DataFrame, keys=()) -> DataFrame:
    """(keys..., type_id, field, variant, n_tokens, token): a field is
    recognised through its label or its name (split at '_'), each as a
    token set."""
    k = list(keys)
    f = catalogue.select(*k, "type_id", F.col("name").alias("field"), "label")
    by_label = f.select(*k, "type_id", "field", F.lit("label").alias("variant"), tokens("label").alias("toks"))
    by_name = f.select(*k, "type_id", "field", F.lit("name").alias("variant"),
                       tokens(F.regexp_replace("field", "_", " ")).alias("toks"))
    v = by_label.unionByName(by_name).withColumn("n_tokens", F.size("toks"))
    return v.select(*k, "type_id", "field", "variant", "n_tokens", F.explode("toks").alias("token"))


def lexical_classify(docs: DataFrame, catalogue: DataFrame, text_col="text", key_col="doc_id",
                     threshold: float | None = None, tenant_col: str | None = None,
                     token_col: str | None = None) -> DataFrame:
    """score(doc, type) = share of the type's fields whose label or name
    tokens all occur in the text; best score, ties to the lowest type id;
    below the threshold (H10) the document is Others.

    With ``tenant_col`` every document is scored only against its own
    tenant's catalogue (an equi-join on (tenant, token)); without it the
    catalogue is shared and only the tokens it knows leave the document row
    (its vocabulary, a scalar subquery, is bounded by the distinct words of
    field labels). No side is broadcast by hint: AQE picks the join from
    the measured sizes. A document is never paired with a type it
    shares no token with. ``token_col`` takes tokens computed earlier (see
    ``text_features``) instead of the text."""
    k = [tenant_col] if tenant_col else []
    var = field_variants(catalogue, k)
    n_fields = catalogue.groupBy(*k, "type_id").agg(F.count(F.lit(1)).alias("n_fields"))
    names = catalogue.select(*k, "type_id", "type_name").distinct()
    toks = F.col(token_col) if token_col else tokens(text_col)
    if not tenant_col:
        # the vocabulary is a scalar subquery (a few dozen words)
        toks = F.array_intersect(toks, var.agg(F.collect_set("token")).scalar())
    dt = docs.select(key_col, *k, F.explode(toks).alias("token"))
    hits = dt.join(var, [*k, "token"])
    found = (hits.groupBy(key_col, *k, "type_id", "field", "variant", "n_tokens").agg(F.count(F.lit(1)).alias("_m"))
             .filter(F.col("_m") == F.col("n_tokens")).select(key_col, *k, "type_id", "field").distinct())
    score = (found.groupBy(key_col, *k, "type_id").agg(F.count(F.lit(1)).alias("_found"))
             .join(n_fields, [*k, "type_id"])
             .withColumn("score", F.round(F.col("_found") / F.col("n_fields"), 6)))
    best = score.groupBy(key_col, *k).agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("type_id"))).alias("_b"))
    best = best.select(key_col, *k, F.col("_b.type_id").alias("best_type_id"), (-F.col("_b.neg")).alias("score"))
    out = docs.select(key_col, *k).join(best, [key_col, *k], "left").join(
        names.withColumnRenamed("type_id", "best_type_id"), [*k, "best_type_id"], "left")
    out = out.withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
    return out.select(key_col, *k, "best_type_id", F.col("type_name").alias("best_type_name"), "score",
                      is_others_expr(F.lit(None).cast("boolean"), "score", threshold).alias("is_others"))


def text_features(docs: DataFrame, catalogue: DataFrame | None = None, text_col="text") -> DataFrame:
    """One pass over the texts: content hash, catalogue tokens (only the
    words the shared catalogue knows; all tokens for per-tenant
    catalogues), OCR quality and the ``Label: value`` lines. The text
    column is dropped, so what is materialised downstream stays small."""
    toks = tokens(text_col)
    if catalogue is not None and "user_id" not in catalogue.columns:
        toks = F.array_intersect(toks, field_variants(catalogue).agg(F.collect_set("token")).scalar())
    return docs.withColumn("_h", content_hash(text_col)).withColumn("_toks", toks) \
        .withColumn("quality_ok", text_quality(text_col)).withColumn("_lines", label_line_array(text_col)) \
        .drop(text_col)


# --------------------------------------------------------------------- J3

# (?d): only "\n" ends a line, as in the other engines
LABEL_LINE = r"(?md)^([^:\n]+):[ \t]*([^\n]*)$"


def label_line_array(text) -> Column:
    """The ``Label: value`` lines of a text, in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(LABEL_LINE), 0)


def label_lines(docs: DataFrame, text_col="text", key_col="doc_id", lines_col: str | None = None) -> DataFrame:
    """Every ``Label: value`` line of every text as (doc, line_no, label_key,
    raw_value); label_key is the lower-cased, trimmed label. ``lines_col``
    takes the line array computed earlier instead of the text."""
    arr = F.col(lines_col) if lines_col else label_line_array(text_col)
    x = docs.select(key_col, F.posexplode(arr).alias("line_no", "line"))
    # split the matched line at its first ':'
    label = F.regexp_extract("line", r"^([^:\n]+):", 1)
    value = F.regexp_extract("line", r"^[^:\n]+:[ \t]*(.*)$", 1)
    return x.select(key_col, "line_no", F.lower(F.trim(label)).alias("label_key"), F.trim(value).alias("raw_value"))


DMY_RE = r"^\d{1,2}/\d{1,2}/\d{4}$"


def convert_value(raw, ftype) -> Column:
    """dates → YYYY-MM-DD (d/m/y or ISO), numbers → their digits with '.' as
    the decimal mark, as many as the text has, booleans, else the text.

    The last separator of a number is its decimal mark if it comes once; other
    separators group digits (1,234.56 and 1.234,56 are 1234.56; 1.234.567 is
    1234567; 1,5 is 1.5). What is then no number is null."""
    r = F.col(raw) if isinstance(raw, str) else raw
    t = F.col(ftype) if isinstance(ftype, str) else ftype
    parts = F.split(r, "/")
    dmy = F.concat_ws("-", F.get(parts, 2), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 0), 2, "0"))
    date_txt = F.when(r.rlike(DMY_RE), dmy).otherwise(F.regexp_extract(r, r"^(\d{4}-\d{2}-\d{2})", 1))
    cleaned = F.regexp_replace(r, r"[^0-9,.\-]", "")
    num = (F.when(cleaned.rlike("^[^,]*,[^,]*$") & cleaned.rlike(",[^.]*$"), F.translate(cleaned, ",.", "."))
           .when(cleaned.rlike("^[^.]*[.][^.]*$") & cleaned.rlike("[.][^,]*$"), F.replace(cleaned, F.lit(","), F.lit("")))
           .when(cleaned.contains(",") & cleaned.contains("."), F.lit(""))
           .otherwise(F.translate(cleaned, ",.", "")))
    low = F.lower(r)
    return (F.when(r.isNull() | (r == ""), F.lit(None))
            .when(t == "date", date_txt.try_cast("date").cast("string"))
            .when(t == "number", F.nullif(F.regexp_extract(num, "^-?[0-9]+([.][0-9]+)?$", 0), F.lit("")))
            .when(t == "boolean", F.when(low.isin("si", "sí", "true", "yes", "1"), "true")
                  .when(low.isin("no", "false", "0"), "false"))
            .otherwise(r))


def label_value_extract(docs: DataFrame | None, doc_types: DataFrame, schema: DataFrame,
                        text_col="text", key_col="doc_id", lines: DataFrame | None = None) -> DataFrame:
    """For each document and each field of its type, the value of the
    first ``Label: value`` line whose label equals the field's label (or
    name), converted by field type; null when absent. Long form. Pass
    ``lines`` (from ``label_lines``) to reuse one extraction pass."""
    lines = lines if lines is not None else label_lines(docs, text_col, key_col)
    s = schema.select("type_id", F.col("name").alias("field"), "label", F.col("type").alias("ftype"), "position")
    keys = (s.select("type_id", "field", F.lower(F.trim("label")).alias("label_key"))
            .unionByName(s.select("type_id", "field", F.lower(F.trim("field")).alias("label_key"))).distinct())
    dt = doc_types.select(key_col, "type_id")
    cand = lines.join(dt, key_col).join(keys, ["type_id", "label_key"])
    first = cand.groupBy(key_col, "field").agg(F.min_by("raw_value", "line_no").alias("raw_value"))
    slots = dt.join(s, "type_id")  # each document x its type's fields (bounded by the schema size)
    out = slots.join(first, [key_col, "field"], "left")
    return out.select(key_col, "type_id", "position", "field", "ftype",
                      convert_value("raw_value", "ftype").alias("value"))


# --------------------------------------------------------------------- J4, D8, G3

# Words ignored when comparing type names.
STOP_WORDS = ("de", "del", "la", "las", "el", "los", "y", "e", "o", "en", "para", "por", "con",
              "the", "of", "and", "a", "an", "for", "to")


def name_key(name) -> Column:
    """Normalised grouping key: slug words without stop words, joined by '-'."""
    n = F.col(name) if isinstance(name, str) else name
    words = F.split(F.regexp_replace(strip_accents(F.lower(n)), "[^a-z0-9]+", " "), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(kept, "-")


def homologate_names(names: DataFrame, name_col="name", group_cols=()) -> DataFrame:
    """J4 (key form): names with the same key form one group; canonical =
    most frequent spelling, then shortest, then alphabetical. Every input
    name appears once. Returns (group_cols..., variant, canonical, group_key, n)."""
    gc = list(group_cols)
    counts = names.groupBy(*gc, F.col(name_col).alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("group_key", name_key("variant"))
    canon = counts.groupBy(*gc, "group_key").agg(F.min(F.struct(
        (-F.col("n")).alias("neg"), F.length("variant").alias("len"), F.col("variant").alias("v"))).alias("_c"))
    return counts.join(canon, [*gc, "group_key"]).select(*gc, "variant", F.col("_c.v").alias("canonical"),
                                                          "group_key", "n")


def homologation_coverage(names: DataFrame, groups: DataFrame, name_col="name", group_cols=()) -> DataFrame:
    """Every input name in exactly one group. A name listed under
    several canonicals keeps the smallest; a missing name becomes its own
    group."""
    gc = list(group_cols)
    one = groups.groupBy(*gc, "variant").agg(F.min("canonical").alias("canonical"))
    distinct_names = names.select(*gc, F.col(name_col).alias("variant")).distinct()
    missing = distinct_names.join(one, [*gc, "variant"], "left_anti").withColumn("canonical", F.col("variant"))
    covered = one.join(distinct_names, [*gc, "variant"], "left_semi")
    return covered.withColumn("source", F.lit("model")).unionByName(missing.withColumn("source", F.lit("own_group")))


def merge_groups(groups: DataFrame, mapping: DataFrame, group_cols=("user_id",), name_col="group_name",
                 count_col="doc_count", mapping_keys=None) -> DataFrame:
    """Groups renamed to their canonical (unmapped keep their name) and
    groups landing on the same name merged (union, never overwrite). A
    variant mapped to several canonicals takes the smallest."""
    gc = list(group_cols)
    mk = gc if mapping_keys is None else list(mapping_keys)
    m = mapping.groupBy(*mk, F.col("variant").alias(name_col)).agg(F.min("canonical").alias("_canon"))
    j = groups.join(m, [*mk, name_col], "left").withColumn("merged_name", F.coalesce("_canon", name_col))
    return j.groupBy(*gc, "merged_name").agg(F.sum(count_col).alias(count_col),
                                             F.count(F.lit(1)).alias("source_groups"))


# --------------------------------------------------------------------- J5

def conform_fields(doc_types: DataFrame, schema: DataFrame, values: DataFrame, key_col="doc_id",
                   type_col="type_name") -> DataFrame:
    """Every document of a type (``type_col``: one column or several) gets
    exactly the type's fields in schema order; missing → null; extra fields dropped; values cast to the field
    type (numbers, dates, booleans; anything else as text). The pairing is
    documents x their own type's fields only, bounded by the schema size."""
    t = [type_col] if isinstance(type_col, str) else list(type_col)
    s = schema.select(*t, F.col("name").alias("field"), F.col("type").alias("ftype"), "position")
    if doc_types is None:
        # values carry the document's type: one aggregate gives both the
        # values and the documents (one read of the field table)
        vt = values.groupBy(key_col, *t, F.col("name").alias("field")).agg(F.min("value").alias("_raw"))
        v = vt.select(key_col, "field", "_raw")
        doc_types = vt.select(key_col, *t)
    else:
        v = values.groupBy(key_col, F.col("name").alias("field")).agg(F.min("value").alias("_raw"))
    slots = doc_types.select(key_col, *t).distinct().join(s, t)
    out = slots.join(v, [key_col, "field"], "left")
    return out.select(key_col, *t, "position", "field", "ftype",
                      convert_value("_raw", "ftype").alias("value"))


# --------------------------------------------------------------------- J6

OCR_CONFIDENCE_STANDARD, OCR_CONFIDENCE_VISION = 0.95, 0.90


def ocr_route(docs: DataFrame, text_col="text", mime_col="mime") -> DataFrame:
    """Quality ok → standard; poor and PDF → standard with a warning;
    poor image → vision. Confidence 0.95 standard, 0.90 vision."""
    q = text_quality(text_col)
    pdf = F.col(mime_col) == "application/pdf"
    route = F.when(q, "standard").when(pdf, "standard_low_quality").otherwise("vision")
    return docs.withColumn("quality_ok", q).withColumn("route", route).withColumn(
        "ocr_confidence", F.when(route == "vision", F.lit(OCR_CONFIDENCE_VISION)).otherwise(F.lit(OCR_CONFIDENCE_STANDARD)))


def apply_canonical_names(items: DataFrame, homologated: DataFrame, name_col="name") -> DataFrame:
    """C7 over a homologation result: each item's name → its canonical."""
    from .matching import apply_canonical
    return apply_canonical(items, homologated.select("variant", "canonical"), name_col)


# ---------------------------------------------------------------- D20, H31

def _ordered_join(parts_col: str, order_col: str, sep: str) -> Column:
    """Concatenate a group's strings in a given order (the group is a
    tenant's catalogue or a type's schema: bounded by the plan limits)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, parts_col))),
                                    lambda s: s.getField(parts_col)), sep)


def schema_context(types: DataFrame, docs: DataFrame, schema: DataFrame) -> DataFrame:
    """Per tenant, each type with id, document count and its own fields
    (``schema`` per tenant and type name; a field shows its ``label``, or its
    name where the schema has none);
    a tenant without types gets the count of its untyped documents."""
    cnt = docs.groupBy(F.col("document_type_id").alias("_tid")).agg(F.count(F.lit(1)).alias("_n"))
    label = F.coalesce("label", "name") if "label" in schema.columns else F.col("name")
    line = F.format_string('    - "%s" (%s): %s%s', "name", "type", label,
                           F.when(F.col("required"), " [required]").otherwise(""))
    fl = schema.withColumn("_line", line).groupBy(F.col("user_id").alias("_tuser"), F.col("type_name").alias("_tname")).agg(
        _ordered_join("_line", "position", "\n").alias("_fields"))
    t = (types.select("user_id", "id", "name").join(cnt, F.col("id") == F.col("_tid"), "left")
         .join(fl, (F.col("user_id") == F.col("_tuser")) & (F.col("name") == F.col("_tname")), "left"))
    block = F.concat(F.format_string('  Tipo "%s" (id=%d, %d documentos):', "name", "id",
                                     F.coalesce(F.col("_n"), F.lit(0))),
                     F.lit("\n"), F.coalesce(F.col("_fields"), F.lit("    (sin campos definidos)")))
    typed = t.withColumn("_block", block).groupBy("user_id").agg(
        F.concat(F.lit("Tipos de documento del usuario y sus campos extraídos:\n"),
                 _ordered_join("_block", "id", "\n\n")).alias("context"))
    untyped = (docs.join(types.select("user_id").distinct(), "user_id", "left_anti").groupBy("user_id")
               .agg(F.format_string("El usuario tiene %d documentos sin tipo definido.",
                                    F.count_if(F.col("document_type_id").isNull())).alias("context")))
    return typed.unionByName(untyped)


CLASSIFY_REPLY = ('Return JSON: {"matchedTypeId": "id or null", "matchedTypeName": "name", "confidence": 0-1, "isOthers": true or false, '
                  '"inferredType": "name, if isOthers"}\nIf confidence is below %s, set isOthers. JSON only.')


def types_description(catalogue: DataFrame, ids: bool = False) -> DataFrame:
    """The numbered catalogue block of the classify prompt (``types``): one row
    per ``user_id`` of a per-tenant catalogue, one row for a shared one; with
    ``ids`` each type's id is told."""
    keys = [c for c in ("user_id",) if c in catalogue.columns]
    tl = catalogue.groupBy(*keys, "type_id", "type_name", "description").agg(
        _ordered_join("label", "position", ", ").alias("labels"))
    tl = tl.withColumn("line", F.format_string('"%s"%s: %s | Campos: %s', "type_name",
                                               F.format_string(" [id=%d]", "type_id") if ids else F.lit(""),
                                               F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("-")),
                                               "labels"))
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("type_id", "line"))),
                           lambda t, i: F.format_string("%d. %s", i + 1, t["line"]))
    return tl.groupBy(*keys).agg(F.array_join(numbered, "\n").alias("types"))


def classify_prompts(docs: DataFrame, catalogue: DataFrame, text_col="text", key_col="doc_id",
                     max_chars: int | None = None, reply_threshold: float | None = None) -> DataFrame:
    """H31: 'Classify this document' prompt per document, with the whole text;
    ``max_chars`` cuts it with a mark, for models of a bounded context. With a
    per-tenant catalogue a prompt lists the types of the document's tenant only. With
    ``reply_threshold`` it lists type ids and asks for the reply that ``classify_with_model`` reads."""
    from ..functions.text import truncate_marked
    text = truncate_marked(text_col, max_chars, "...(truncated)") if max_chars else F.col(text_col)
    described = types_description(catalogue, reply_threshold is not None)
    reply = "" if reply_threshold is None else f"\n\n{CLASSIFY_REPLY % reply_threshold}"
    if "user_id" in catalogue.columns:
        rows = docs.select(F.col(key_col), F.col("user_id").alias("_tenant"), text.alias("_text")).join(
            described.select(F.col("user_id").alias("_tenant"), F.col("types").alias("_types")), "_tenant", "left")
    else:
        rows = docs.select(F.col(key_col), text.alias("_text"), described.scalar().alias("_types"))
    prompt = F.concat(F.lit("Classify this document. Available types:\n"), F.coalesce("_types", F.lit("")),
                      F.lit(f"{reply}\n\nDocument text:\n"), F.coalesce("_text", F.lit("")))
    return rows.select(key_col, prompt.alias("prompt"))


def classify_with_model(docs: DataFrame, catalogue: DataFrame, fn: ModelFn, threshold: float | None = None,
                        max_chars: int | None = None, key_col="doc_id", store: str | None = None,
                        model_name: str = "") -> DataFrame:
    """The model stage as the jobs use it: prompt (H31), one call per distinct
    prompt (J1), reply repaired and read (H1, H2), low confidence to Others
    (H10), name resolved to a type of the tenant (C4). Columns as
    ``lexical_classify`` gives them, plus ``answer`` (the name the model gave)
    and ``model_error`` (a failed call or a reply without JSON). With ``store``
    (a shared folder) answers are kept there by prompt and ``model_name`` and
    only missing ones are called."""
    from .answers import stored_model_stage
    from ..functions.json_repair import parse_model_json, repair_python_dict, vget
    from .matching import resolve_type
    tenant = F.col("user_id") if "user_id" in catalogue.columns else F.lit(0).cast("bigint")
    prompts = classify_prompts(docs, catalogue, key_col=key_col, max_chars=max_chars,
                               reply_threshold=effective_threshold(threshold))
    called = stored_model_stage(prompts, fn, store, model_name) if store else model_stage(prompts, fn, key_col=key_col)
    called = called.select(key_col, "response", "error")
    read = called.withColumn("_v", F.coalesce(parse_model_json("response"), repair_python_dict("response")))

    def told(*names, type_="string"):
        return F.coalesce(*[vget("_v", f"$.{n}", type_) for n in names])

    def name_of(*names):
        return F.nullif(F.trim(told(*names)), F.lit(""))
    matched, inferred = name_of("matchedTypeName", "matched_type_name"), name_of("inferredType", "inferred_type")
    read = read.select(
        key_col, matched.alias("_matched"), inferred.alias("_inferred"), told("matchedTypeId", "matched_type_id", type_="bigint").alias("_id"),
        told("isOthers", "is_others", type_="boolean").alias("_flag"), told("confidence", type_="double").alias("_conf"),
        F.coalesce("error", F.when(F.col("_v").isNull(), F.lit("La respuesta no es JSON"))).alias("model_error"))
    types = catalogue.select(tenant.alias("user_id"), F.col("type_id").alias("id"), F.col("type_name").alias("name")).distinct()
    # an id counts only if it is a type of the document's own tenant
    by_id = types.select("user_id", F.col("id").cast("bigint").alias("_id"), F.col("name").alias("_named"))
    items = docs.select(key_col, tenant.alias("user_id")).join(read, key_col).join(by_id, ["user_id", "_id"], "left")
    items = items.withColumn("_name", F.coalesce("_matched", "_named", "_inferred")).withColumn(
        "_low", is_others_expr(F.col("_flag"), "_conf", threshold)).withColumn(
        "answer", F.when(F.col("_low"), F.coalesce("_inferred", "_name")).otherwise(F.coalesce("_name", "_inferred")))
    got = resolve_type(items, types, "_name", "_low", key_col)
    return got.select(key_col, F.col("resolved_type_id").alias("best_type_id"),
                      F.col("resolved_type_name").alias("best_type_name"),
                      F.coalesce("_conf", F.lit(0.0)).alias("score"), F.col("resolved_is_others").alias("is_others"),
                      "answer", "model_error")
