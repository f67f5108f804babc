"""Joins: type lookup, matching, routing and catalogue joins.

Matching joins are equi-joins on (tenant, name) or, for partial names, on
(tenant, q-gram); the single best candidate per document is chosen with a
``min(struct(rank, id, ...))`` aggregate (partial aggregation, no window over
a tenant), so a hot tenant is split by its names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import containment_pairs, merged


def norm_name(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c))


def docs_with_type(docs: DataFrame, types: DataFrame, type_col: str = "document_type_id") -> DataFrame:
    """Left equi-join document → type; name null when unmatched."""
    t = types.select(F.col("id").alias("_tid"), F.col("name").alias("document_type_name"))
    return (docs.join(t, docs[type_col] == t["_tid"], "left").drop("_tid"))


def best_type_match(items: DataFrame, types: DataFrame, name_col: str = "classified_name",
                    key: str = "id", user_col: str = "user_id", partial: bool = True) -> DataFrame:
    """C2 + C3: per item the tenant's type whose ``lower(trim(name))`` equals
    the item's name; else (``partial``) the first type (lowest id) whose
    name contains the item's name or is contained in it.

    An empty name matches nothing. Partial matching compares the distinct names
    without an exact match with the types of a tenant that has few, and looks
    them up in a q-gram index of the type names of one that has many
    (``containment``). Catalogues are never broadcast: their size as planned is
    that of a file, not of the rows made from it. Returns ``items`` plus ``match_type_id``, ``match_type_name`` and
    ``match_kind`` ('exact' | 'partial' | null)."""
    t = types.select(F.col(user_col).alias("_tu"), F.col("id").alias("_tid"),
                     F.col("name").alias("_tname"), norm_name("name").alias("_tn"))
    t = t.filter(F.col("_tn") != "")
    names = items.select(F.col(user_col).alias("_u"), norm_name(name_col).alias("_cn")).filter(F.col("_cn") != "").distinct()
    first = F.min(F.struct(F.col("_tid").alias("tid"), F.col("_tname").alias("tname")))
    exact = t.groupBy(F.col("_tu").alias("_u"), F.col("_tn").alias("_cn")).agg(first.alias("_m"))
    best = names.join(merged(exact), ["_u", "_cn"]).withColumn("_kind", F.lit("exact"))
    if partial:
        rest = names.join(merged(exact), ["_u", "_cn"], "left_anti")
        named = exact.select("_u", F.col("_cn").alias("_tn"), F.col("_m").alias("_t"))
        near = (containment_pairs(rest, named, "_u", "_cn", "_tn").join(merged(named), ["_u", "_tn"])
                .groupBy("_u", "_cn").agg(F.min("_t").alias("_m")))
        best = best.unionByName(near.withColumn("_kind", F.lit("partial")))
    best = best.select(F.col("_u").alias("_best_u"), F.col("_cn").alias("_best_name"), F.col("_m.tid").alias("match_type_id"),
                       F.col("_m.tname").alias("match_type_name"), F.col("_kind").alias("match_kind"))
    return items.join(merged(best), (items[user_col] == best["_best_u"]) & (norm_name(items[name_col]) == best["_best_name"]),
                      "left").drop("_best_u", "_best_name")


def match_type_exact(items: DataFrame, types: DataFrame, name_col="classified_name", key="id") -> DataFrame:
    """C2."""
    return best_type_match(items, types, name_col, key, partial=False)


def match_type_partial(items: DataFrame, types: DataFrame, name_col="classified_name", key="id") -> DataFrame:
    """C3 (exact first, then partial, as the original falls through)."""
    return best_type_match(items, types, name_col, key, partial=True)


def resolve_type(items: DataFrame, types: DataFrame, name_col="classified_name",
                 others_col="is_others", key="id") -> DataFrame:
    """C4: flagged Others go straight to Others; else exact → partial → Others
    (the fallback sets ``is_others``). Adds resolved_type_id/name and route."""
    m = best_type_match(items, types, name_col, key)
    flagged = F.coalesce(F.col(others_col), F.lit(False))
    route = (F.when(flagged, "others").when(F.col("match_type_id").isNull(), "others_fallback")
             .otherwise(F.col("match_kind")))
    return (m.withColumn("route", route)
            .withColumn("resolved_type_id", F.when(~flagged, F.col("match_type_id")))
            .withColumn("resolved_type_name", F.when(~flagged, F.col("match_type_name")))
            .withColumn("resolved_is_others", flagged | F.col("match_type_id").isNull())
            .drop("match_type_id", "match_type_name", "match_kind"))


def split_matched(items: DataFrame, types: DataFrame, name_col="classified_name",
                  others_col="is_others", key="id") -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) batch items by existence of a matching type."""
    r = resolve_type(items, types, name_col, others_col, key)
    return (r.filter(~F.col("resolved_is_others")).select(*items.columns),
            r.filter("resolved_is_others").select(*items.columns))


def existing_or_new_types(names: DataFrame, types: DataFrame, name_col="inferred_type",
                          user_col="user_id") -> DataFrame:
    """Distinct inferred names per tenant with the existing type (exact,
    normalised) or ``is_new``."""
    n = names.select(user_col, F.col(name_col).alias("inferred_name")).distinct()
    t = (types.groupBy(F.col(user_col).alias("_u"), norm_name("name").alias("_n"))
         .agg(F.min("id").alias("type_id")))
    out = n.join(t, (n[user_col] == t["_u"]) & (norm_name(n["inferred_name"]) == t["_n"]), "left")
    return out.select(user_col, "inferred_name", "type_id", F.col("type_id").isNull().alias("is_new"))


def apply_canonical(items: DataFrame, mapping: DataFrame, name_col: str,
                    variant_col="variant", canonical_col="canonical", keys=()) -> DataFrame:
    """Variant → canonical; unmapped names map to themselves."""
    m = mapping.select(*[F.col(k).alias(f"_m_{k}") for k in keys],
                       F.col(variant_col).alias("_v"), F.col(canonical_col).alias("_c"))
    cond = items[name_col] == m["_v"]
    for k in keys:
        cond = cond & (items[k] == m[f"_m_{k}"])
    out = items.join(m, cond, "left")
    return out.withColumn("canonical_name", F.coalesce(F.col("_c"), F.col(name_col))).drop(
        "_v", "_c", *[f"_m_{k}" for k in keys])


def field_access(docs: DataFrame, field_name: str | None = None, json_col="extracted_data",
                 key="id") -> DataFrame:
    """Lateral unnest of the document's fields (fields, else key_fields),
    optionally picking one field by name."""
    from ..functions.fields import display_fields, parse_extracted
    f = docs.select(key, F.explode_outer(display_fields(parse_extracted(json_col))).alias("f"))
    f = f.select(key, F.col("f.name").alias("field_name"), F.col("f.type").alias("field_type"),
                 F.col("f.value").alias("field_value"))
    if field_name is not None:
        f = f.filter(F.col("field_name") == F.lit(field_name))
    return f


def attach_files(groups: DataFrame, files: DataFrame, classified: DataFrame, key="id") -> DataFrame:
    """Group membership ⨝ files ⨝ classifications on the document id
    (file names are not unique); a missing side drops the row."""
    return groups.join(files, key, "inner").join(classified, key, "inner")


def resolve_assignments(assign: DataFrame, docs: DataFrame, types: DataFrame) -> DataFrame:
    """Per (document, type_name, type_id?) of a tenant: unknown document
    → error; type by id when an id is given (no name fallback), else by
    exact name; no type → a new type named type_name (one per tenant+name)."""
    d = docs.select(F.col("id").alias("document_id"), "user_id").withColumn("_found", F.lit(True))
    a = assign.join(d, ["document_id", "user_id"], "left")
    by_id = types.select(F.col("id").alias("_iid"), F.col("user_id").alias("_iu"),
                         F.col("name").alias("_iname"))
    by_name = (types.groupBy(F.col("user_id").alias("_nu"), F.col("name").alias("_nname"))
               .agg(F.min("id").alias("_nid")))
    a = a.join(by_id, (a["type_id"] == by_id["_iid"]) & (a["user_id"] == by_id["_iu"]), "left")
    a = a.join(by_name, a["type_id"].isNull() & (a["user_id"] == by_name["_nu"])
               & (a["type_name"] == by_name["_nname"]), "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    rid = F.coalesce(F.col("_iid"), F.col("_nid"))
    status = F.when(~found, "error").otherwise("completed")
    resolution = (F.when(~found, "not_found").when(F.col("_iid").isNotNull(), "by_id")
                  .when(F.col("_nid").isNotNull(), "by_name").otherwise("new_type"))
    return a.select(
        "document_id", "user_id", status.alias("status"), resolution.alias("resolution"),
        F.when(found, rid).alias("resolved_type_id"),
        F.when(found, F.coalesce(F.col("_iname"), F.col("_nname"), F.col("type_name"))).alias("resolved_type_name"),
        F.when(~found, F.lit("Not found")).alias("message"))


def new_types_from_assignments(resolved: DataFrame) -> DataFrame:
    """The types to create, one per (tenant, name)."""
    return (resolved.filter(F.col("resolution") == "new_type")
            .select("user_id", F.col("resolved_type_name").alias("name")).distinct())


def plan_limits_join(subs: DataFrame, limits: DataFrame) -> DataFrame:
    """C11: subscription ⨝ plan limits (a literal table of a handful of rows,
    so broadcasting it is size-proven)."""
    return subs.join(F.broadcast(limits), "plan", "left")


def usage_in_period(subs: DataFrame, docs: DataFrame) -> DataFrame:
    """Per subscription the documents with start <= created_at < end
    (a null bound is open). Documents are first counted per (user,
    created_at) with a partial aggregate, so the range join sees one row per
    distinct instant instead of one per document, then summed back onto
    every subscription (0 when none)."""
    d = (docs.groupBy(F.col("user_id").alias("_du"), F.col("created_at").alias("_ca"))
         .agg(F.count(F.lit(1)).alias("_n")))
    s = subs.select(F.col("user_id").alias("_su"), F.col("period_start").alias("_ps"),
                    F.col("period_end").alias("_pe"))
    cond = ((s["_su"] == d["_du"]) & (s["_ps"].isNull() | (d["_ca"] >= s["_ps"]))
            & (s["_pe"].isNull() | (d["_ca"] < s["_pe"])))
    counts = s.join(d, cond, "inner").groupBy("_su").agg(F.sum("_n").alias("_cnt"))
    out = subs.join(counts, subs["user_id"] == counts["_su"], "left")
    return out.withColumn("docs_in_period", F.coalesce(F.col("_cnt"), F.lit(0)).cast("bigint")).drop("_su", "_cnt")


def types_with_counts(types: DataFrame, docs: DataFrame) -> DataFrame:
    """Every type with its document count (0 when none); documents
    without a type counted apart as a row with null id."""
    counts = docs.groupBy(F.col("document_type_id").alias("_tid"), F.col("user_id").alias("_u")).agg(
        F.count(F.lit(1)).alias("_n"))
    typed = (types.join(counts, (types["id"] == counts["_tid"]), "left")
             .select(types["user_id"], types["id"].alias("type_id"), types["name"].alias("type_name"),
                     F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("doc_count")))
    untyped = counts.filter(F.col("_tid").isNull()).select(
        F.col("_u").alias("user_id"), F.lit(None).cast("bigint").alias("type_id"),
        F.lit(None).cast("string").alias("type_name"), F.col("_n").alias("doc_count"))
    return typed.unionByName(untyped)
