"""Projections, filters and predicates.

Filters are plain Column predicates so Catalyst pushes them into the scan;
per-batch checks use partial aggregation joined back (skew-safe), never a
collected list per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_repair import repair_python_dict


def tenant_value(tenant) -> int | None:
    """``NULLIF(setting, '')::int``: unset or '' means no tenant."""
    if tenant is None or (isinstance(tenant, str) and tenant.strip() == ""):
        return None
    return int(tenant)


def tenant_view(df: DataFrame, tenant, user_col: str = "user_id") -> DataFrame:
    """B1: rows of the session tenant; no tenant → zero rows."""
    t = tenant_value(tenant)
    if t is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(user_col) == F.lit(t))


# Upload gate.
MAX_FILE_BYTES = 10 * 1024 * 1024
SUPPORTED_MIME = ("application/pdf", "image/jpeg", "image/jpg", "image/png", "image/webp")
INFER_MIME = ("application/pdf", "image/png", "image/jpeg", "image/jpg")
MIN_INFER_FILES, MAX_INFER_FILES = 2, 10


def file_gate_error(size, mime, name) -> Column:
    """B2: size first, then format; null when the file passes."""
    size, mime, name = F.col(size), F.col(mime), F.col(name)
    mb = F.format_string("%.1f", size / (1024 * 1024))
    too_big = F.concat(F.lit('El archivo "'), name, F.lit('" pesa '), mb,
                       F.lit("MB. El tamaño máximo permitido es 10MB."))
    bad_fmt = F.concat(F.lit('Formato no soportado: "'), mime,
                       F.lit('". Solo se permiten archivos PDF e imágenes (JPEG, PNG, WebP).'))
    return F.when(size > MAX_FILE_BYTES, too_big).when(~mime.isin(*SUPPORTED_MIME), bad_fmt)


def file_gate(df: DataFrame, size="size_bytes", mime="mime", name="filename") -> DataFrame:
    return df.withColumn("gate_error", file_gate_error(size, mime, name))


def batch_gate(files: DataFrame, batch_col="user_id", size="size_bytes", mime="mime",
               name="filename") -> DataFrame:
    """Per file its own error (format before size), per batch the
    count check (2..10). A batch is rejected when the count is wrong or no
    valid file is left. Long form: one row per file with the batch verdict,
    built from a partial aggregate joined back, so a huge batch never sits
    in one task."""
    sz, mm, nm = F.col(size), F.col(mime), F.col(name)
    file_err = (F.when(~mm.isin(*INFER_MIME), F.format_string("Tipo no permitido: %s (%s)", nm, mm))
                .when(sz > MAX_FILE_BYTES, F.format_string("Archivo muy grande: %s", nm)))
    files = files.withColumn("file_error", file_err)
    per_batch = files.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("file_error").isNull()).alias("n_valid"))
    count_err = (F.when(F.col("n_files") < MIN_INFER_FILES,
                        F.lit("Se requieren al menos 2 documentos para inferir tipos"))
                 .when(F.col("n_files") > MAX_INFER_FILES,
                       F.lit(f"Maximo {MAX_INFER_FILES} archivos permitidos")))
    per_batch = per_batch.withColumn("batch_error", count_err).withColumn(
        "batch_accepted", F.col("batch_error").isNull() & (F.col("n_valid") > 0))
    return (files.join(per_batch, batch_col, "inner")
            .withColumn("file_kept", F.col("batch_accepted") & F.col("file_error").isNull()))


def contains_ci(c: Column, q: str) -> Column:
    """Literal, case-insensitive substring; null column → no match."""
    return F.coalesce(F.lower(c).contains(F.lit(q.lower())), F.lit(False))


def search_documents(df: DataFrame, q: str,
                     cols=("filename", "document_type_name", "summary")) -> DataFrame:
    """Q in filename OR type name OR summary (literal, case-insensitive)."""
    if not q:
        return df
    cond = F.lit(False)
    for c in cols:
        cond = cond | contains_ci(F.col(c), q)
    return df.filter(cond)


def filter_documents(df: DataFrame, status: str = "all", type_id="all", q: str = "") -> DataFrame:
    """Status AND type AND search, each skipped when 'all'/empty."""
    if status != "all":
        df = df.filter(F.col("status") == F.lit(status))
    if type_id != "all":
        df = df.filter(F.col("document_type_id").cast("string") == F.lit(str(type_id)))
    return search_documents(df, q)


def search_types(types: DataFrame, q: str) -> DataFrame:
    """Blank query → all; else name or description contains."""
    if not q.strip():
        return types
    return types.filter(contains_ci(F.col("name"), q) | contains_ci(F.col("description"), q))


def documents_by_request(docs: DataFrame, types: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows for (id, user_id) requests, each only when the requester
    owns the document, with type name and sanitised JSON (VARIANT)."""
    from .matching import docs_with_type
    owned = docs.join(requests.select("id", "user_id"), ["id", "user_id"], "left_semi")
    out = docs_with_type(owned, types)
    return out.withColumn("extracted", repair_python_dict("extracted_data", keywords=False))


def document_by_id(docs: DataFrame, types: DataFrame, doc_id: int, tenant) -> DataFrame:
    """B7 single lookup."""
    t = tenant_value(tenant)
    req = docs.sparkSession.createDataFrame([(int(doc_id), t)], "id bigint, user_id bigint")
    return documents_by_request(docs, types, req)


def usable_text(df: DataFrame, text="text", error="error") -> DataFrame:
    """No error and non-empty text."""
    cond = F.col(text).isNotNull() & (F.length(F.col(text)) > 0)
    if error in df.columns:
        cond = cond & F.col(error).isNull()
    return df.filter(cond)


# Internal columns never shown in an answer.
HIDDEN_COLUMNS = ("id", "user_id", "userId", "confidence_score", "confidenceScore",
                  "storage_path", "storagePath", "google_drive_link", "googleDriveLink",
                  "extracted_data", "extractedData", "raw_text", "rawText")


def visible_columns(df: DataFrame) -> DataFrame:
    """Drop internal columns; when every column is internal keep all."""
    keep = [c for c in df.columns if c not in HIDDEN_COLUMNS]
    return df.select(*(keep or df.columns))


def tag_errors(df: DataFrame, error="error") -> DataFrame:
    """Every row once, ``ok`` where it has no error; a bad row never
    fails the batch."""
    return df.withColumn("ok", F.col(error).isNull())


def split_errors(df: DataFrame, error="error") -> tuple[DataFrame, DataFrame]:
    """B11 as two frames: (ok rows, failed rows)."""
    return df.filter(F.col(error).isNull()), df.filter(F.col(error).isNotNull())


def tag_pending(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Every request once, ``accepted`` if its document belongs to the
    same tenant and is in pending_confirmation. One join."""
    pending = (docs.filter(F.col("status") == "pending_confirmation")
               .select(F.col("id").alias("doc_id"), "user_id").distinct().withColumn("_pending", F.lit(True)))
    return (requests.join(pending, ["doc_id", "user_id"], "left")
            .withColumn("accepted", F.col("_pending").isNotNull()).drop("_pending"))


def pending_only_guard(requests: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B12 as two frames: (accepted, rejected)."""
    tagged = tag_pending(requests, docs)
    return tagged.filter("accepted").drop("accepted"), tagged.filter("NOT accepted").drop("accepted")
