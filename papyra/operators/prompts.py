"""Prompts beside classification (H31): extract, infer, homologate and
consolidate, each with the reply it asks for, and the readers of the replies.

A list that may be longer than a call (a tenant's names, a type's fields) is
packed: rows are placed in a total order with the widths before them, and a call
is one slice of ``budget`` characters, so no task or prompt holds a whole hot
tenant. Names go through two packings, shifted by half a slice; groups of
different calls that share a name are one group (components).

Replies are repaired (H1, H2); what a model leaves out or invents does not
change the rows: every name ends in one group (D8), every document has exactly
its type's fields (J5), every schema keeps computed frequencies (D7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import normalize_field_type
from ..functions.json_repair import parse_model_json, repair_python_dict, vget
from ..session import cut_lineage
from .answers import stored_model_stage
from .cosine import connected
from .model import ModelFn, _ordered_join, conform_fields, model_stage, name_key
from .ranks import before_runs, sorted_runs
from .stats import MAX_SCHEMA_FIELDS, consolidate_schema

EXTRACT_REPLY = ('Return JSON: {"summary": "one or two lines", "fields": [{"name": "field name", "value": "value or null"}]}\n'
                 "Dates as YYYY-MM-DD, numbers as digits, null for what is not in the text. JSON only.")
INFER_REPLY = ('Return JSON: {"inferred_type": "short name", "confidence": 0-1, "summary": "one or two lines", '
               '"fields": [{"name": "snake_case", "type": "string|number|date|boolean|array", "label": "label", "value": "value"}]}\n'
               "JSON only.")
HOMOLOGATE_REPLY = ('Return JSON: {"groups": {"canonical name": ["name", "name"]}}\n'
                    "Every name of the list belongs to exactly one group. JSON only.")
CONSOLIDATE_REPLY = ('Return JSON: {"typeDescription": "one line", "consolidatedFields": [{"name": "name from the list", '
                     '"type": "type", "label": "label", "description": "one line"}]}\n'
                     "Leave out fields that repeat another one. JSON only.")


def answer(rows: DataFrame, fn: ModelFn, store: str | None = None, model: str = "") -> DataFrame:
    """``rows`` (with ``prompt``) and their replies: ``_v`` (VARIANT or null)
    and ``error`` (a failed call, or a reply that is no JSON). The answers are
    materialised, so readers of one reply do not call again."""
    got = stored_model_stage(rows, fn, store, model) if store else model_stage(rows, fn)
    got = cut_lineage(got.drop("prompt"))
    v = F.coalesce(parse_model_json("response"), repair_python_dict("response"))
    return got.withColumn("_v", v).withColumn(
        "error", F.coalesce("error", F.when(F.col("_v").isNull(), F.lit("La respuesta no es JSON")))).drop("response")


# ---------------------------------------------------------------- extract

def extract_prompts(docs: DataFrame, catalogue: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key, type_id, prompt): the fields of the document's type, then the whole
    text. Documents whose type has no fields get no prompt."""
    keys = [c for c in ("user_id",) if c in catalogue.columns] + ["type_id"]
    required = F.when(F.col("required"), ", req").otherwise("") if "required" in catalogue.columns else F.lit("")
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("type"), required, F.lit("): "), F.coalesce("label", "name"))
    fields = catalogue.withColumn("_line", line).groupBy(*keys, "type_name").agg(_ordered_join("_line", "position", "\n").alias("_fields"))
    rows = docs.select(key_col, *keys, F.col(text_col).alias("_text")).join(fields, keys)
    prompt = F.concat(F.lit('Extract data from this "'), F.col("type_name"), F.lit('" document.\n\nFields to extract:\n'), F.col("_fields"),
                      F.lit(f"\n\n{EXTRACT_REPLY}\n\nDocument text:\n"), F.coalesce("_text", F.lit("")))
    return rows.select(key_col, *keys, prompt.alias("prompt"))


def reply_fields(replies: DataFrame, *keep: str) -> DataFrame:
    """The ``fields`` of each reply, one row a field: ``keep``, name, type,
    label, value (nested values as JSON); entries without a name are dropped."""
    fields = F.explode(vget("_v", "$.fields", "array<variant>"))
    got = replies.select(*keep, fields.alias("_f"))
    return got.select(*keep, *[vget("_f", f"$.{c}").alias(c) for c in ("name", "type", "label", "value")]).filter(
        F.coalesce(F.trim("name"), F.lit("")) != "")


def extract_with_model(docs: DataFrame, catalogue: DataFrame, fn: ModelFn, text_col: str = "text", key_col: str = "doc_id",
                       store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every document (key, type_id) with exactly its type's fields (J5), in
    the long form of J3, from one call a distinct prompt; and (key, summary,
    error). A document whose call failed has all its fields null."""
    replies = answer(extract_prompts(docs, catalogue, text_col, key_col), fn, store)
    types = [c for c in ("user_id", "type_id") if c in replies.columns]
    values = conform_fields(replies.select(key_col, *types), catalogue, reply_fields(replies, key_col).select(key_col, "name", "value"),
                            key_col, types)
    return values, replies.select(key_col, vget("_v", "$.summary").alias("summary"), "error")


# ---------------------------------------------------------------- infer

def infer_prompts(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key, prompt): which type of document the whole text is, with its fields."""
    prompt = F.concat(F.lit(f"Identify the type of this document and its main fields.\n\n{INFER_REPLY}\n\nDocument text:\n"),
                      F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(key_col, prompt.alias("prompt"))


def infer_with_model(docs: DataFrame, fn: ModelFn, text_col: str = "text", key_col: str = "doc_id",
                     store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, inferred_type, confidence, summary, error) and the fields found
    (key, name, type (H8), label, value). An empty name is null."""
    replies = answer(infer_prompts(docs, text_col, key_col), fn, store)
    types = replies.select(key_col, F.nullif(F.trim(vget("_v", "$.inferred_type")), F.lit("")).alias("inferred_type"),
                           vget("_v", "$.confidence", "double").alias("confidence"), vget("_v", "$.summary").alias("summary"), "error")
    return types, reply_fields(replies, key_col).withColumn("type", normalize_field_type("type"))


# ---------------------------------------------------------------- packing

def packed(rows: DataFrame, group: str, order: Sequence[str | Column], width: Column, budget: int) -> DataFrame:
    """``rows`` (checkpointed) with ``_start``, the widths before them in their
    group and order, and ``_total``, that of the group. ``order`` is total in a
    group. A slice of ``budget`` is at most one row wider than that."""
    runs = sorted_runs(rows.withColumn("_w", width.cast("bigint")), [group, *order])
    before = Window.partitionBy("_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    at = runs.withColumn("_in", F.coalesce(F.sum("_w").over(before), F.lit(0))).join(before_runs(runs, _before=F.col("_w")), "_run")
    at = at.withColumn("_start", F.col("_in") + F.col("_before")).drop("_run", "_at", "_in", "_before")
    ends = at.groupBy(group).agg(F.min("_start").alias("_first"), F.sum("_w").alias("_total"))
    return at.join(ends, group).withColumn("_start", F.col("_start") - F.col("_first")).drop("_first", "_w")


# ---------------------------------------------------------------- homologate

def _homologate_round(heads: DataFrame, fn: ModelFn, budget: int, store: str | None) -> tuple[DataFrame, bool]:
    """``_g, name, canonical`` for distinct (_g, name), and whether some group
    took more than one call."""
    at = cut_lineage(packed(heads.withColumn("_key", name_key("name")), "_g", ["_key", "name"], F.length("name") + 8, budget)
                     .withColumn("_id", F.monotonically_increasing_id()))
    shifted = F.when(F.col("_total") > budget, F.array(F.lit(0), F.lit(budget // 2))).otherwise(F.array(F.lit(0)))
    members = at.select("_g", "name", "_id", "_start", F.explode(shifted).alias("_shift")).withColumn(
        "_call", F.floor((F.col("_start") + F.col("_shift")) / budget)).drop("_start")
    call = ["_g", "_shift", "_call"]
    names = F.transform(F.array_sort(F.collect_list("name")), lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n))
    prompt = F.concat(F.lit("Group the names that mean the same type of document.\n\nNames:\n"), F.array_join(names, "\n"),
                      F.lit(f"\n\n{HOMOLOGATE_REPLY}"))
    replies = answer(members.groupBy(*call).agg(prompt.alias("prompt")), fn, store)
    groups = replies.select(*call, F.explode(vget("_v", "$.groups", "map<string,array<string>>")).alias("canonical", "_names"))
    listed = groups.select(*call, F.trim("canonical").alias("canonical"), F.explode("_names").alias("name")).filter("canonical <> ''")
    voted = cut_lineage(members.join(listed, [*call, "name"]).groupBy(*call, "name", "_id").agg(F.min("canonical").alias("canonical")))
    leaders = voted.groupBy(*call, "canonical").agg(F.min("_id").alias("b"))
    roots = connected(voted.join(leaders, [*call, "canonical"]).select(F.col("_id").alias("a"), "b"))
    held = at.select("_g", "name", "_id").join(roots, F.col("_id") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_id"))
    votes = held.select("_id", "_root").join(voted.select("_id", "canonical"), "_id").groupBy("_root", "canonical").agg(
        F.countDistinct("_id").alias("_n"))
    best = votes.groupBy("_root").agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.length("canonical").alias("len"),
                                                     F.col("canonical").alias("c"))).alias("_c"))
    out = held.join(best, "_root", "left").select("_g", "name", F.coalesce("_c.c", "name").alias("canonical"))
    return cut_lineage(out), bool(at.filter(F.col("_total") > budget).limit(1).count())


def homologate_with_model(names: DataFrame, fn: ModelFn, name_col: str = "name", group_cols: Sequence[str] = ("user_id",),
                          budget: int = 8000, rounds: int = 4, store: str | None = None) -> DataFrame:
    """J4 by a model: (group_cols..., variant, canonical), every name of a
    group of columns once (D8).

    Names are packed by their normalised key into calls of ``budget``
    characters. Groups that share a name over two calls are one; its canonical
    name is what most of its names got, then the shortest, then the first in the
    alphabet. The canonical names of a round are the names of the next one, until
    nothing merges, one call holds each list or ``rounds`` are done. A name that
    no reply lists, as after a failed call, stays a group of its own; null
    names are dropped, null group columns are a group."""
    gc = list(group_cols)
    asked = names.filter(F.col(name_col).isNotNull()).select(*gc, F.col(name_col).alias("variant")).distinct()
    g = F.to_json(F.struct(*gc)) if gc else F.lit("")
    mapping = cut_lineage(asked.withColumn("_g", g).withColumn("canonical", F.col("variant")))
    for _ in range(rounds):
        heads = mapping.select("_g", F.col("canonical").alias("name")).distinct()
        step, more = _homologate_round(heads, fn, budget, store)
        moved = step.filter("name <> canonical").limit(1).count()
        step = step.select("_g", F.col("name").alias("_was"), F.col("canonical").alias("_to"))
        mapping = cut_lineage(mapping.join(step, (mapping["_g"] == step["_g"]) & (F.col("canonical") == F.col("_was"))).select(
            *gc, "variant", mapping["_g"], F.col("_to").alias("canonical")))
        if not (moved and more):
            break
    return mapping.drop("_g")


# ---------------------------------------------------------------- consolidate

def consolidate_with_model(fields: DataFrame, fn: ModelFn, group_cols: Sequence[str] = ("user_id", "type_name"), doc_col: str = "doc_id",
                           budget: int = 8000, max_fields: int = MAX_SCHEMA_FIELDS, store: str | None = None) -> DataFrame:
    """One schema per type: (group_cols..., name, type, label, description,
    required, frequency, position).

    The fields of all the type's documents with their computed frequency (D7)
    are packed into calls; a reply chooses among the listed names and gives
    labels, descriptions and types (H8). Frequency and required stay computed. A
    name that a reply leaves out is left out; names of a failed call stay as
    computed. At most ``max_fields``, by frequency, then name."""
    gc = list(group_cols)
    stats = consolidate_schema(fields, gc, doc_col, max_fields=None)
    line = F.format_string("- %s (%s, %.0f%%)", "name", "type", F.col("frequency") * 100)
    at = cut_lineage(packed(stats.withColumn("_g", F.to_json(F.struct(*gc))).withColumn("_line", line), "_g", ["position"],
                            F.length("_line") + 1, budget).withColumn("_call", F.floor(F.col("_start") / budget)))
    prompt = F.concat(F.lit("Define one schema for the documents of this type.\n\nFields found, with their share of the documents:\n"),
                      _ordered_join("_line", "position", "\n"), F.lit(f"\n\n{CONSOLIDATE_REPLY}"))
    replies = answer(at.groupBy("_g", "_call").agg(prompt.alias("prompt")), fn, store)
    listed = replies.select("_g", "_call", F.explode(vget("_v", "$.consolidatedFields", "array<variant>")).alias("_f"))
    listed = listed.groupBy("_g", "_call", vget("_f", "$.name").alias("name")).agg(
        *[F.min(F.nullif(F.trim(vget("_f", f"$.{c}")), F.lit(""))).alias(f"_{c}") for c in ("type", "label", "description")])
    read = replies.select("_g", "_call", vget("_v", "$.consolidatedFields", "array<variant>").isNotNull().alias("_read"))
    kept = (at.join(read, ["_g", "_call"]).join(listed.withColumn("_listed", F.lit(True)), ["_g", "_call", "name"], "left")
            .filter(~F.col("_read") | F.col("_listed")))
    place = Window.partitionBy("_g").orderBy(F.col("frequency").desc(), "name")
    return kept.select(
        *gc, "name", F.when(F.col("_type").isNotNull(), normalize_field_type("_type")).otherwise(F.col("type")).alias("type"),
        F.coalesce("_label", "name").alias("label"), F.coalesce("_description", F.lit("")).alias("description"), "required", "frequency",
        F.row_number().over(place).alias("position")).filter(F.col("position") <= max_fields)
