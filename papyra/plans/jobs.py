"""Composed jobs (K1-K7): the reference's entry points.

Every step is an operator from ``papyra.operators``; the only Python
boundary is the caller's model function (J1), if one is given. Text features
and classifications are materialised when a job is built (reliable
checkpoints in the shared folder); the rest is lazy. Classification runs once per
distinct content and is joined back (the reference's cache and dedup).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, mime_from_extension, typed_key
from ..operators import gates as G
from ..operators import matching as M
from ..operators import model as MD
from ..operators import stats as S
from ..operators.listing import merge_results
from ..operators.windows import dedup_by_content
from ..session import cut_lineage
from .changes import OTHERS_TYPE_NAME, confirm_changes
from .guard import guarded_select

UNCLASSIFIED = "Documento Sin Clasificar"


def classify_unique(docs: DataFrame, catalogue: DataFrame, threshold=None) -> DataFrame:
    """J2 over distinct contents only, joined back to every document. A
    catalogue with a ``user_id`` column is per tenant: then the unit of work
    is (tenant, content), since the same text may match differently.
    ``docs`` carries either the text or ``text_features`` columns."""
    tenant = "user_id" if "user_id" in catalogue.columns else None
    k = [tenant] if tenant else []
    if "_h" in docs.columns:
        h = docs.select("doc_id", *k, "_h", "_toks")
        tok = {"token_col": "_toks"}
    else:
        h = docs.select("doc_id", *k, content_hash("text").alias("_h"), "text")
        tok = {}
    uniq = h.groupBy(*k, "_h").agg(F.min("doc_id").alias("_rep"))
    reps = h.join(uniq.withColumnRenamed("_rep", "doc_id"), [*k, "_h", "doc_id"], "left_semi").drop("doc_id")
    cls = MD.lexical_classify(reps, catalogue, key_col="_h", threshold=threshold, tenant_col=tenant, **tok)
    # the model-stage result is materialised once (reliable checkpoint in the
    # shared folder): it is reused several times downstream and must never
    # be recomputed
    return cut_lineage(h.select("doc_id", *k, "_h").join(cls, [*k, "_h"], "left").drop("_h", *k))


def has_types(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``_has_types``: whether the row's tenant (or anyone, for a shared
    catalogue) has a type to match."""
    if "user_id" not in catalogue.columns:
        return rows.withColumn("_has_types", catalogue.agg((F.count(F.lit(1)) > 0)).scalar())
    owners = catalogue.select("user_id").distinct().withColumn("_has_types", F.lit(True))
    return rows.join(owners, "user_id", "left").withColumn("_has_types", F.coalesce("_has_types", F.lit(False)))


def process_documents(uploads: DataFrame, catalogue: DataFrame, threshold=None, model: MD.ModelFn | None = None,
                      max_chars: int | None = None, store: str | None = None) -> DataFrame:
    """K1: gate → classify (unique contents) → threshold → resolve (matched
    type or Others) → extract → typed key. One row per upload.

    ``model`` is the caller's function from a prompt to a reply (J1): its
    answers are read, repaired and resolved (H1, H10, C4), a failing call
    makes an error row; ``store`` keeps the answers across runs; without a model
    the lexical baseline (J2) classifies. A
    document whose tenant has no type yet waits for one
    (``pending_confirmation``). Text features (hash, catalogue tokens,
    quality, label lines) are materialised and the later steps work on those;
    the gate columns come from a second, pruned scan."""
    g = has_types(G.file_gate(uploads), catalogue)
    ok = g.filter(F.col("gate_error").isNull()).select("doc_id", "user_id", "mime", "text")
    feats = cut_lineage(MD.text_features(ok, catalogue))
    if model is None:
        cls = classify_unique(feats, catalogue, threshold)
        cls = cls.withColumn("answer", F.when(F.col("score") > 0, F.col("best_type_name"))) \
            .withColumn("model_error", F.lit(None).cast("string"))
    else:
        cls = cut_lineage(MD.classify_with_model(ok.select("doc_id", "user_id", "text"), catalogue, model, threshold, max_chars,
                                                  store=store))
    routed = feats.select("doc_id", F.when(F.col("quality_ok"), "standard")
                          .when(F.col("mime") == "application/pdf", "standard_low_quality").otherwise("vision")
                          .alias("route"))
    routed = routed.withColumn("ocr_confidence", F.when(F.col("route") == "vision", F.lit(MD.OCR_CONFIDENCE_VISION))
                               .otherwise(F.lit(MD.OCR_CONFIDENCE_STANDARD)))
    matched = cls.filter(~F.col("is_others")).select("doc_id", F.col("best_type_id").alias("type_id"))
    lines = MD.label_lines(feats, lines_col="_lines")  # one line table serves both branches
    ext = MD.label_value_extract(None, matched, catalogue, lines=lines)
    pop_m = ext.groupBy("doc_id").agg(F.count("value").alias("populated"))
    others_lines = lines.join(cls.filter(F.col("is_others")).select("doc_id"), "doc_id", "left_semi")
    pop_o = others_lines.groupBy("doc_id").agg(F.count_if(F.col("raw_value") != "").alias("populated"))
    pop = pop_m.unionByName(pop_o)
    out = (g.select("doc_id", "user_id", "filename", "gate_error", "_has_types")
           .join(cls, "doc_id", "left").join(routed, "doc_id", "left").join(pop, "doc_id", "left"))
    out = out.withColumn("gate_error", F.coalesce("gate_error", F.when(F.col("_has_types"), F.col("model_error"))))
    good = F.col("gate_error").isNull() & F.col("_has_types")
    type_name = F.when(good, F.when(F.col("is_others"), F.lit(OTHERS_TYPE_NAME)).otherwise(F.col("best_type_name")))
    out = out.withColumns({c: F.when(F.col("gate_error").isNull(), F.col(c)) for c in ("route", "ocr_confidence", "score")}
                          | {c: F.when(good, F.col(c)) for c in ("is_others", "best_type_id")})
    return out.select(
        "doc_id", "user_id", F.when(F.col("gate_error").isNotNull(), "error")
        .when(F.col("_has_types"), "completed").otherwise("pending_confirmation").alias("status"),
        "gate_error", "route", "ocr_confidence",
        F.when(~F.col("is_others"), F.col("best_type_id")).alias("document_type_id"),
        type_name.alias("document_type_name"), F.col("score").alias("confidence"), "is_others",
        F.when(type_name.isNotNull(), typed_key("user_id", type_name, "filename")).alias("typed_key"),
        F.when(F.col("gate_error").isNull(), F.coalesce(F.col("populated"), F.lit(0))).cast("bigint").alias("populated"),
        F.when(F.col("gate_error").isNull(), F.coalesce(F.nullif("answer", F.lit("")), F.lit(UNCLASSIFIED)))
        .alias("inferred_type"))


def usage_increments(processed: DataFrame) -> DataFrame:
    """I5 batch form: +1 per completed document per user."""
    return processed.filter(F.col("status") == "completed").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("docs_used"))


def process_batch(uploads: DataFrame, catalogue: DataFrame, batch_cols=("user_id",), threshold=None,
                  model: MD.ModelFn | None = None):
    """K2: matched documents complete; unmatched ones are grouped by their
    inferred name (homologated per tenant) and left pending; gate and model
    failures are errors. Returns (rows, summary)."""
    p = process_documents(uploads, catalogue, threshold, model)
    p = p.withColumn("is_others", F.coalesce("is_others", F.col("status") == "pending_confirmation")) \
        .withColumn("status", F.when(F.col("status") == "pending_confirmation", "completed").otherwise(F.col("status")))
    unmatched = p.filter((F.col("status") == "completed") & F.col("is_others"))
    grouped = S.group_by_inferred(unmatched, "inferred_type", "inferred_type")
    names = grouped.select(*batch_cols, F.col("group_key").alias("name"))
    mapping = MD.homologate_names(names, "name", batch_cols)
    pending = M.apply_canonical(grouped, mapping, "group_key", keys=batch_cols).select(
        "doc_id", *batch_cols, F.lit("pending_confirmation").alias("status"), F.col("canonical_name").alias("group_name"))
    done = p.filter((F.col("status") == "completed") & ~F.col("is_others")).select(
        "doc_id", *batch_cols, "status", "document_type_id", "document_type_name")
    errors = p.filter(F.col("status") == "error").select("doc_id", *batch_cols, "status",
                                                         F.col("gate_error").alias("message"))
    rows = merge_results(errors, pending, done)
    return rows, S.batch_summary(rows, batch_cols)


def _field_name(label) -> F.Column:
    from ..functions.text import strip_accents
    s = F.regexp_replace(strip_accents(F.lower(F.trim(label))), "[^a-z0-9]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def guess_type(value) -> F.Column:
    v = F.trim(value)
    return (F.when(v.rlike(r"^(\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})$"), "date")
            .when(F.regexp_replace(v, r"^[$€]\s*", "").rlike(r"^-?[0-9][0-9.,]*$"), "number")
            .otherwise("string"))


def infer_types(uploads: DataFrame, catalogue: DataFrame, batch_col="batch_id", threshold=None,
                model: MD.ModelFn | None = None, max_chars: int | None = None, store: str | None = None):
    """K3 (infer types from samples): batch gate → dedup → usable text →
    classify → existing/new → homologate → consolidate → conform → save.
    A document that matches a type of the catalogue gets it; otherwise its
    name is what ``model`` answered, or one bucket with the lexical baseline,
    which has no names of its own. Returns (documents, report)."""
    files = uploads.select("doc_id", "user_id", batch_col, "filename", "size_bytes", "mime", "text")
    gated = G.batch_gate(files, batch_col=batch_col)
    kept = gated.filter(F.col("file_kept")).select("doc_id", "user_id", batch_col, "text")
    # one pass over the sample texts; everything after works on their features
    kept = kept.withColumn("_usable", F.col("text").isNotNull() & (F.length("text") > 0))
    feats = cut_lineage(MD.text_features(kept, catalogue))
    d = dedup_by_content(feats.withColumn("content_hash", F.concat_ws(":", F.col(batch_col).cast("string"), "_h")),
                         hash_col="content_hash", order_col="doc_id")
    d = d.filter(F.col("kept") & F.col("_usable")).drop("kept", "_usable", "content_hash")
    if model is None:
        cls = classify_unique(d, catalogue, threshold).withColumn("answer", F.lit(None).cast("string"))
    else:
        texts = kept.select("doc_id", "user_id", "text").join(d.select("doc_id"), "doc_id", "left_semi")
        cls = cut_lineage(MD.classify_with_model(texts, catalogue, model, threshold, max_chars, store=store)).drop("model_error")
    d = d.join(cls, "doc_id")
    d = d.withColumn("inferred_name", F.when(~F.col("is_others"), F.col("best_type_name"))
                     .otherwise(F.coalesce(F.nullif("answer", F.lit("")), F.lit(UNCLASSIFIED)))).drop("answer")
    ck = ["user_id"] if "user_id" in catalogue.columns else []  # per-tenant catalogue?
    mapping = MD.homologate_names(d.select("user_id", F.col("inferred_name").alias("name")), "name", ["user_id"])
    d = M.apply_canonical(d, mapping, "inferred_name", keys=["user_id"]).withColumnRenamed("canonical_name", "type_name")
    cat_names = (catalogue.withColumn("_name", F.lower(F.trim("type_name"))).groupBy(*ck, "_name")
                 .agg(F.min("type_id").alias("existing_type_id")))
    d = (d.withColumn("_name", F.lower(F.trim("type_name"))).join(cat_names, [*ck, "_name"], "left").drop("_name")
         .withColumn("is_new", F.col("existing_type_id").isNull()))
    d = cut_lineage(d)  # reused by every branch below
    # fields: catalogue schema for existing types, consolidated key fields for new ones
    lines = MD.label_lines(d, lines_col="_lines")
    kf = (lines.join(d.select("doc_id", "user_id", batch_col, "type_name", "is_new"), "doc_id")
          .filter(F.col("is_new")).select("doc_id", "user_id", batch_col, "type_name", _field_name("label_key").alias("name"),
                                          guess_type("raw_value").alias("type"), F.col("raw_value").alias("value"))
          .filter(F.col("name") != ""))
    new_schema = S.consolidate_schema(kf.withColumn("group", F.concat_ws("|", F.col(batch_col).cast("string"), "type_name")),
                                      group_col="group")
    new_schema = new_schema.select(F.col("group"), "name", "type", "position")
    dn = d.filter(F.col("is_new")).withColumn("group", F.concat_ws("|", F.col(batch_col).cast("string"), "type_name"))
    conf_new = MD.conform_fields(dn.select("doc_id", "group"), new_schema, kf.select("doc_id", "name", "value"),
                                 type_col="group")
    de = d.filter(~F.col("is_new")).select("doc_id", F.col("existing_type_id").alias("type_id"))
    conf_old = MD.label_value_extract(None, de, catalogue.select("type_id", "name", "label", "type", "position"),
                                      lines=lines)
    pop = (conf_new.groupBy("doc_id").agg(F.count("value").alias("populated"), F.count(F.lit(1)).alias("n_fields"))
           .unionByName(conf_old.groupBy("doc_id").agg(F.count("value").alias("populated"),
                                                      F.count(F.lit(1)).alias("n_fields"))))
    docs = d.join(pop, "doc_id", "left").select(
        "doc_id", "user_id", batch_col, "type_name", "is_new",
        F.coalesce("n_fields", F.lit(0)).cast("bigint").alias("n_fields"),
        F.coalesce("populated", F.lit(0)).cast("bigint").alias("populated"))
    docs = docs.withColumn("status", F.when(F.col("populated") > 0, "completed").otherwise("error")) \
        .withColumn("confidence", F.when(F.col("populated") > 0, 0.95).otherwise(0.5))
    report = docs.groupBy("user_id", batch_col, "type_name", "is_new").agg(
        F.max("n_fields").alias("field_count"), F.count(F.lit(1)).alias("sample_count"))
    return docs, report


def confirm_types(requests: DataFrame, docs: DataFrame, types: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """K4: the verdict per request; ``confirm_changes`` has the whole change."""
    return confirm_changes(requests, docs, types, values).results


def resolve_pending(assignments: DataFrame, docs: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: C10 per assignment, then the batch summary (total, completed);
    ``resolve_changes`` has the types and documents after it."""
    r = M.resolve_assignments(assignments, docs, types)
    summary = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"),
                                       F.count_if(F.col("status") == "completed").alias("completed"))
    return r, summary


def reprocess(table: DataFrame, uploads: DataFrame, ids: DataFrame, catalogue: DataFrame, threshold=None,
              model: MD.ModelFn | None = None) -> DataFrame:
    """K6: re-run K1 for the chosen documents; a document that still matches
    no type goes to pending_confirmation; the rows are upserted by id. A
    chosen document that has no upload keeps its row."""
    again = process_documents(uploads.join(ids, "doc_id", "left_semi"), catalogue, threshold, model)
    again = again.withColumn("status", F.when((F.col("status") == "completed") & F.col("is_others"),
                                              "pending_confirmation").otherwise(F.col("status")))
    keep = table.join(again.select("doc_id"), "doc_id", "left_anti")
    return keep.unionByName(again.select(*table.columns))


def ask(spark: SparkSession, sql: str, tenant, docs: DataFrame, types: DataFrame) -> DataFrame:
    """K7: a caller's SELECT through the guard, capped and with internal
    columns hidden."""
    return G.visible_columns(guarded_select(spark, sql, tenant, docs, types))


def uploads_from_documents(docs: DataFrame, tenants: int = 50, batch_size: int = 8) -> DataFrame:
    """Upload rows for documents: file name by id, MIME by extension, a size
    proportional to the text, tenant and batch derived from the id."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".png", ".jpg", ".webp", ".gif")]),
                       (F.col("doc_id") % 5 + 1).cast("int"))
    fn = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)
    return docs.select(
        "doc_id", (F.floor(F.col("doc_id") / batch_size) % tenants).cast("bigint").alias("user_id"),
        F.floor(F.col("doc_id") / batch_size).cast("bigint").alias("batch_id"),
        fn.alias("filename"), (F.length("text") * 200).cast("bigint").alias("size_bytes"),
        mime_from_extension(fn).alias("mime"), "text")
