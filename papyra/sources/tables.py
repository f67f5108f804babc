"""Document table reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import tenant_view


def scan_documents(docs: DataFrame, tenant) -> DataFrame:
    """A1: the tenant's documents, newest first."""
    return tenant_view(docs, tenant).orderBy(F.col("created_at").desc(), F.col("id").desc())


def upsert_documents(base: DataFrame, changes: DataFrame, key="id", version="updated_at") -> DataFrame:
    """A4: rows of ``changes`` replace rows of ``base`` (one per key) with the
    same key (latest version wins; on a tie the change wins); new keys are
    inserted; a change without a key is none. Only the changes are aggregated; the base meets them in one
    join, which stays in place where AQE finds them small."""
    cols = base.columns
    last = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max_by(F.struct(*cols), F.struct(version)).alias("_change"))
    joined = base.join(last, base[key] == F.col("_key"), "full_outer")
    wins = F.col("_key").isNotNull() & (base[key].isNull() | ~(base[version] > F.col(f"_change.{version}"))
                                        | base[version].isNull())
    return joined.select(*[F.when(wins, F.col(f"_change.{c}")).otherwise(base[c]).alias(c) for c in cols])


def delete_guard(types: DataFrame, docs: DataFrame, delete_ids: DataFrame) -> DataFrame:
    """A5 plain delete: a type that still has documents is refused."""
    d = types.join(delete_ids, "id", "left_semi")
    counts = docs.groupBy(F.col("document_type_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    return d.join(counts, "id", "inner").select("id", "user_id", "name", "documents")


def cascade_delete(types: DataFrame, docs: DataFrame, delete_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5 cascade: (remaining types, remaining documents) after removing the
    types and every document of theirs."""
    gone = delete_ids.select("id")
    remaining_types = types.join(gone, "id", "left_anti")
    remaining_docs = docs.join(gone.withColumnRenamed("id", "document_type_id"), "document_type_id", "left_anti")
    return remaining_types, remaining_docs


def export_fields(conformed: DataFrame, field_names, key_col="doc_id", type_col="type_name",
                  field_col="field", value_col="value") -> DataFrame:
    """One column per field (the schema's names, so the pivot needs no
    extra pass to discover values)."""
    return conformed.groupBy(key_col, type_col).pivot(field_col, list(field_names)).agg(F.first(value_col))


def write_export(wide: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A6 sink: CSV with header, or JSON lines."""
    w = wide.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)


def write_typed_export(conformed: DataFrame, path: str, type_cols=("user_id", "type_name"), key_col="doc_id", mode: str = "overwrite") -> None:
    """A6, a table per type: JSON lines in ``path/user_id=U/type_name=T``, each
    line the document's key and exactly its type's fields in schema order (nulls
    written), so every folder reads as a table with the type's own schema.

    ``conformed`` is the long form of J5; a document's fields (bounded by its
    schema) are one group. No list of columns or types is gathered: rows are
    rebalanced by type, which splits a hot type over many files and keeps small
    ones together. A field named like the key is written as ``key_col`` plus
    ``_field``. Types of a null name go to Hive's default folder."""
    entry = F.struct("position", F.when(F.col("field") == key_col, f"{key_col}_field").otherwise(F.col("field")).alias("key"), "value")
    rows = conformed.groupBy(key_col, *type_cols).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    pairs = F.transform("_entries", lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value")))
    key = F.array(F.struct(F.lit(key_col).alias("key"), F.col(key_col).cast("string").alias("value")))
    line = F.to_json(F.map_from_entries(F.concat(key, pairs)), {"ignoreNullFields": "false"})
    out = rows.select(*type_cols, line.alias("value")).hint("rebalance", *type_cols)
    out.write.mode(mode).partitionBy(*type_cols).text(path)
