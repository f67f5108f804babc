"""Change sets: what K1, K4 and K5 do to the stored tables.

One classified plan per call gives everything a change is made of: the types
to create (ids allocated in one distributed pass), the rows of documents after
the change, the ids to delete and a verdict per request. Nothing is written
here; ``apply_changes`` gives the tables after the change (A4), for a writer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import display_fields, field_defaults, normalize_field_type, parse_extracted
from ..functions.text import typed_key
from ..operators import matching as M
from ..operators import model as MD
from ..operators.ranks import allocate_ids
from ..session import cut_lineage
from ..sources.tables import upsert_documents

OTHERS_TYPE_NAME = "Otros Documentos"
UNNAMED_TYPE = "Tipo Sin Nombre"
# The schema of a tenant's catch-all type.
OTHERS_SCHEMA = ('{"fields":[{"name":"document_title","type":"string","label":"Título del Documento","required":false,"description":""},'
                 '{"name":"document_category","type":"string","label":"Categoría","required":false,"description":""},'
                 '{"name":"key_entities","type":"string","label":"Resumen/Entidades Clave","required":false,"description":""}]}')
OTHERS_DESCRIPTION = "Documentos que no son de ningún tipo conocido."

SCHEMA_TYPE = "fields array<struct<name string, type string, label string, required boolean, description string>>"
TYPE_COLUMNS = ["id", "user_id", "name", "description", "field_schema"]


@dataclass
class ChangeSet:
    """``created_types``: rows of the type table. ``changed_documents``: whole
    rows after the change. ``deleted_documents``: ids. ``results``: one row
    per request."""

    created_types: DataFrame
    changed_documents: DataFrame
    deleted_documents: DataFrame
    results: DataFrame


def apply_changes(documents: DataFrame, types: DataFrame, change: ChangeSet, key: str = "id",
                  version: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(documents, types) after the change: deletes by anti-join, rows by A4,
    new types appended."""
    left = documents.join(change.deleted_documents.select(F.col("id").alias(key)), key, "left_anti").select(*documents.columns)
    after = upsert_documents(left, change.changed_documents, key, version)
    return after, types.unionByName(change.created_types.select(*types.columns))


def schema_rows(types: DataFrame) -> DataFrame:
    """(type_id, position, name, type, label) of every field of every type."""
    fields = types.select(F.col("id").alias("type_id"), F.posexplode(F.from_json("field_schema", SCHEMA_TYPE)["fields"]).alias("at", "f"))
    return fields.select("type_id", (F.col("at") + 1).alias("position"), "f.name", "f.type", "f.label")


def schema_json(fields: Column) -> Column:
    """A type's ``field_schema`` from field structs."""
    return F.to_json(F.struct(field_defaults(fields).alias("fields")), {"ignoreNullFields": "false"})


def first_per_name(fields: Column) -> Column:
    """Fields without those whose name came before."""
    names = F.transform(fields, lambda f: f["name"])
    return F.filter(fields, lambda f, i: F.array_position(names, f["name"]) == i + 1)


def extracted_json(conformed: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, populated, fields): the conformed fields of a document as JSON in
    schema order. A document has at most the fields of its type."""
    entry = F.struct("position", F.struct(F.col("field").alias("name"), F.col("ftype").alias("type"), "value").alias("f"))
    per = conformed.groupBy(key_col).agg(F.count(F.nullif(F.col("value"), F.lit(""))).alias("populated"), F.sort_array(F.collect_list(entry)).alias("_f"))
    return per.select(key_col, "populated", F.to_json(F.transform("_f", lambda e: e["f"]), {"ignoreNullFields": "false"}).alias("fields"))


def stored_values(docs: DataFrame, key: str = "id") -> DataFrame:
    """(doc_id, name, value) of the fields a document was stored with: what
    is extracted again where no caller's extraction is given."""
    return M.field_access(docs, key=key).select(F.col(key).alias("doc_id"), F.col("field_name").alias("name"), F.col("field_value").alias("value"))


def _created(wanted: DataFrame, types: DataFrame, description: Column, fields: Column) -> DataFrame:
    """New type rows, one per (tenant, name): schema and description from the
    request with the lowest document id. ``wanted`` has user_id, name, doc_id
    and the document's ``extracted`` struct."""
    first = wanted.groupBy("user_id", "name").agg(F.min_by(F.col("extracted"), "doc_id").alias("extracted"))
    rows = first.select("user_id", "name", description.alias("description"), schema_json(first_per_name(fields)).alias("field_schema"))
    return allocate_ids(rows, types, ["user_id", "name"]).select(*TYPE_COLUMNS)


def _after_images(docs: DataFrame, decided: DataFrame, types_after: DataFrame, values: DataFrame | None) -> DataFrame:
    """Whole document rows after ``decided`` (doc_id, type_id): extracted again
    to the type's schema (J5), completed; with ``populated`` (D9)."""
    schema = schema_rows(types_after.join(decided.select(F.col("type_id").alias("id")).distinct(), "id", "left_semi"))
    held = docs.join(decided.select(F.col("doc_id").alias("id"), "type_id"), "id")
    values = stored_values(held) if values is None else values.join(decided.select("doc_id"), "doc_id", "left_semi")
    conformed = MD.conform_fields(decided.select("doc_id", "type_id"), schema, values, type_col="type_id")
    done = extracted_json(conformed).withColumnRenamed("doc_id", "id")
    summary = F.to_json(F.struct(parse_extracted("extracted_data")["summary"].alias("summary")), {"ignoreNullFields": "false"})
    data = F.concat(F.regexp_replace(summary, r"\}$", ""), F.lit(',"fields":'), F.coalesce("fields", F.lit("[]")), F.lit("}"))
    return (held.join(done, "id", "left").withColumns({
        "extracted_data": data, "document_type_id": F.col("type_id").cast(docs.schema["document_type_id"].dataType),
        "status": F.lit("completed"), "populated": F.coalesce("populated", F.lit(0))}).select(*docs.columns, "populated"))


def confirm_changes(requests: DataFrame, docs: DataFrame, types: DataFrame, values: DataFrame | None = None,
                    seq_col: str | None = None) -> ChangeSet:
    """K4: create_type / assign_type / cancel for pending documents of the
    requesting tenant (B12); anything else is refused.

    Of several requests for a document the first counts (``seq_col``; without
    one, cancel before assign before create by name) and the others find it no
    longer pending. create_type takes the tenant's type of that exact name or
    makes one from the document's inferred fields; the document is extracted
    again to its type's schema, from ``values`` (doc_id, name, value) or its
    stored fields, and ``low_confidence`` tells that nothing was found (D9)."""
    d = docs.select(F.col("id").alias("doc_id"), "user_id", "status", "filename", "inferred_type",
                    parse_extracted("extracted_data").alias("extracted"))
    by_id = types.select(F.col("id").alias("type_id"), "user_id", F.col("name").alias("_assigned"))
    j = requests.join(d, ["doc_id", "user_id"], "left").join(by_id, ["type_id", "user_id"], "left")
    found, act = F.col("status").isNotNull(), F.col("action")
    final = F.coalesce(F.nullif(F.col("type_name"), F.lit("")), F.nullif(F.col("inferred_type"), F.lit("")), F.lit(UNNAMED_TYPE))
    message = (F.when(~found, "Documento no encontrado")
               .when(F.col("status") != "pending_confirmation",
                     F.format_string("El documento no está pendiente de confirmación (status: %s)", F.col("status")))
               .when((act == "assign_type") & F.col("type_id").isNull(), "typeId es requerido para assign_type")
               .when((act == "assign_type") & F.col("_assigned").isNull(), "Tipo de documento no encontrado"))
    j = j.withColumn("message", message).withColumn("_final", F.when(act == "create_type", final).otherwise(F.col("_assigned")))
    rank = F.struct(*([seq_col] if seq_col else []), F.when(act == "cancel", 0).when(act == "assign_type", 1).otherwise(2).alias("_a"),
                    F.col("_final").alias("_f"), F.coalesce(F.col("type_id").cast("long"), F.lit(0)).alias("_t"))
    j = cut_lineage(j.withColumn("_rank", rank))
    firsts = j.filter("message IS NULL").groupBy("doc_id").agg(F.min("_rank").alias("_first"), F.min_by("action", "_rank").alias("_act"))
    j = j.join(firsts, "doc_id", "left")
    late = F.col("message").isNull() & (F.col("_rank") != F.col("_first"))
    j = j.withColumn("message", F.when(late & (F.col("_act") == "cancel"), "Documento no encontrado").when(
        late, "El documento no está pendiente de confirmación (status: completed)").otherwise(F.col("message")))
    ok = j.filter("message IS NULL").dropDuplicates(["doc_id"])  # requests that repeat each other act once
    by_name = types.groupBy("user_id", "name").agg(F.min("id").alias("_named"))
    making = ok.filter(act == "create_type").withColumn("name", F.col("_final")).join(by_name, ["user_id", "name"], "left")
    wanted = making.filter("_named IS NULL")
    described = F.coalesce(F.nullif(F.col("extracted.summary"), F.lit("")), F.format_string('Tipo "%s" creado desde batch', F.col("name")))
    inferred = F.transform(display_fields("extracted"), lambda f: f.withField("type", normalize_field_type(f["type"])))
    created = cut_lineage(_created(wanted.select("user_id", "name", "doc_id", "extracted"), types, described, inferred))
    new_ids = created.select("user_id", "name", F.col("id").alias("_new"))
    chosen = (making.join(new_ids, ["user_id", "name"], "left")
              .select("doc_id", F.coalesce("_named", "_new").alias("type_id"), F.col("_named").isNull().alias("new_type"))
              .unionByName(ok.filter(act == "assign_type").select("doc_id", F.col("type_id").cast("long"), F.lit(False).alias("new_type"))))
    types_after = types.select(*TYPE_COLUMNS).unionByName(created)
    images = cut_lineage(_after_images(docs, chosen, types_after, values))
    done = (chosen.join(images.select(F.col("id").alias("doc_id"), "populated"), "doc_id")
            .select("doc_id", F.col("type_id").alias("_type"), "new_type", (F.col("populated") == 0).alias("low_confidence")))
    acted = F.col("message").isNull()
    results = j.join(done, "doc_id", "left").select(
        "doc_id", "user_id", "action",
        F.when(~acted, "error").when(act == "cancel", "deleted").otherwise("completed").alias("result"),
        F.when(acted, F.col("_type")).alias("type_id"), F.when(acted & (act != "cancel"), F.col("_final")).alias("type_name"),
        F.coalesce(acted & F.col("new_type"), F.lit(False)).alias("new_type"),
        F.when(acted & (act == "assign_type"), F.col("low_confidence")).alias("low_confidence"),
        F.when(acted & (act != "cancel"), typed_key("user_id", "_final", "filename")).alias("typed_key"), "message")
    return ChangeSet(created, images.drop("populated"), ok.filter(act == "cancel").select(F.col("doc_id").alias("id")), results)


def resolve_changes(assignments: DataFrame, docs: DataFrame, types: DataFrame, values: DataFrame | None = None) -> ChangeSet:
    """K5: every assignment (document_id, user_id, type_name, type_id?) of a
    tenant's own document gives it the type (by id, else by exact name, else a
    new one from the document's fields) and extracts it again. Of several
    assignments for a document the last in (type_id, type_name) holds."""
    resolved = cut_lineage(M.resolve_assignments(assignments, docs, types))
    held = docs.select(F.col("id").alias("document_id"), parse_extracted("extracted_data").alias("extracted"))
    wanted = resolved.filter("resolution = 'new_type'").join(held, "document_id").select(
        "user_id", F.col("resolved_type_name").alias("name"), F.col("document_id").alias("doc_id"), "extracted")
    described = F.format_string('Tipo "%s" creado desde procesamiento batch', F.col("name"))
    created = cut_lineage(_created(wanted, types, described, display_fields("extracted")))
    new_ids = created.select("user_id", F.col("name").alias("resolved_type_name"), F.col("id").alias("_new"))
    results = (resolved.join(new_ids, ["user_id", "resolved_type_name"], "left")
               .withColumn("resolved_type_id", F.coalesce("resolved_type_id", F.when(F.col("resolution") == "new_type", F.col("_new"))))
               .select(*resolved.columns))
    chosen = (results.filter("status = 'completed'").groupBy(F.col("document_id").alias("doc_id"))
              .agg(F.max_by("resolved_type_id", F.struct("resolved_type_id", "resolved_type_name")).alias("type_id")))
    images = _after_images(docs, chosen, types.select(*TYPE_COLUMNS).unionByName(created), values).drop("populated")
    return ChangeSet(created, images, docs.select("id").limit(0), results)


def file_others(processed: DataFrame, types: DataFrame) -> ChangeSet:
    """K1's filing of unmatched documents: the tenant's catch-all type, made
    once per tenant that needs one and has none. ``processed`` are K1's rows;
    the changed documents are those that go to the catch-all type."""
    others = processed.filter((F.col("status") == "completed") & F.col("is_others"))
    mine = types.filter(F.col("name") == OTHERS_TYPE_NAME).groupBy("user_id").agg(F.min("id").alias("_have"))
    tenants = others.select("user_id").distinct().join(mine, "user_id", "left")
    rows = tenants.filter("_have IS NULL").select(
        "user_id", F.lit(OTHERS_TYPE_NAME).alias("name"), F.lit(OTHERS_DESCRIPTION).alias("description"), F.lit(OTHERS_SCHEMA).alias("field_schema"))
    created = cut_lineage(allocate_ids(rows, types, ["user_id"]).select(*TYPE_COLUMNS))
    ids = mine.unionByName(created.select("user_id", F.col("id").alias("_have")))
    kind = processed.schema["document_type_id"].dataType
    images = others.join(ids, "user_id").withColumn("document_type_id", F.col("_have").cast(kind)).select(*processed.columns)
    return ChangeSet(created, images, processed.select(F.col("doc_id").alias("id")).limit(0),
                     images.select("doc_id", "user_id", "document_type_id"))
