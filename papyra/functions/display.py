"""Presentation expressions (R1-R9) and failure classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_number_es(x) -> Column:
    """R1: '.' thousands and ',' decimals (at most 3) for magnitudes below 1e12."""
    v = _c(x)
    txt = F.translate(F.call_function("format_number", v.cast("double"), F.lit("#,##0.###")), ",.", ".,")
    return F.when(F.abs(v) < 1e12, txt).otherwise(v.cast("string"))


# Spanish month names (long, then short as rendered by es-ES).
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
             "septiembre", "octubre", "noviembre", "diciembre"]
MONTHS_ES_SHORT = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic"]


def _month_name(ts, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(_c(ts)))


def format_date_es(ts) -> Column:
    """R2: '5 de marzo de 2024'."""
    t = _c(ts)
    return F.concat(F.dayofmonth(t).cast("string"), F.lit(" de "), _month_name(t, MONTHS_ES),
                    F.lit(" de "), F.year(t).cast("string"))


def relative_time(ts, now) -> Column:
    """Minutes, hours, days ago, else 'dd mmm'."""
    t = _c(ts)
    diff_ms = (F.unix_micros(_c(now).cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / 1000
    mins, hours, days = F.floor(diff_ms / 60000), F.floor(diff_ms / 3600000), F.floor(diff_ms / 86400000)
    short = F.concat(F.lpad(F.dayofmonth(t).cast("string"), 2, "0"), F.lit(" "), _month_name(t, MONTHS_ES_SHORT))
    return (F.when(mins < 1, F.lit("Hace un momento"))
            .when(mins < 60, F.format_string("Hace %d min", mins.cast("bigint")))
            .when(hours < 24, F.format_string("Hace %dh", hours.cast("bigint")))
            .when(days < 7, F.format_string("Hace %dd", days.cast("bigint")))
            .otherwise(short))


# Byte units.
BYTE_UNITS = ["B", "KB", "MB", "GB"]


def format_bytes(b) -> Column:
    """R4: '0 B'; else 1024 powers with one decimal (half up), '.0' dropped."""
    v = _c(b).cast("double")
    i = F.floor(F.log(v) / F.log(F.lit(1024.0))).cast("int")
    r = F.floor(v / F.pow(F.lit(1024.0), i) * 10 + 0.5) / 10
    num = F.when(r == F.floor(r), F.floor(r).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", r))
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), i + 1)
    return F.when(v == 0, F.lit("0 B")).otherwise(F.concat(num, F.lit(" "), unit))


def render_value(v) -> Column:
    """R5 over a VARIANT value: null → 'Sin valor'; boolean → Sí/No; array →
    items joined by ', '; else its text."""
    x = _c(v)
    kind = F.schema_of_variant(x)
    as_arr = F.try_variant_get(x, "$", "array<string>")
    return (F.when(x.isNull() | F.is_variant_null(x), F.lit("Sin valor"))
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), "Sí").otherwise("No"))
            .when(kind.startswith("ARRAY"), F.array_join(as_arr, ", "))
            .otherwise(F.try_variant_get(x, "$", "string")))


# File type labels by extension.
FILE_TYPE_LABELS = {"pdf": "PDF", "png": "Imagen PNG", "jpg": "Imagen JPG", "jpeg": "Imagen JPEG",
                    "webp": "Imagen WebP", "gif": "GIF", "xlsx": "Excel", "xls": "Excel", "csv": "CSV",
                    "doc": "Word", "docx": "Word", "txt": "Texto"}


def _lookup(mapping: dict, key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.element_at(m, key)


def file_type_label(filename) -> Column:
    """Label by extension, else upper extension, else 'Archivo'."""
    e = extension(filename)
    return F.coalesce(_lookup(FILE_TYPE_LABELS, e), F.nullif(F.upper(e), F.lit("")), F.lit("Archivo"))


def column_label(c) -> Column:
    """R7: '_' → space, split camelCase, lower."""
    s = F.regexp_replace(_c(c), "_", " ")
    return F.lower(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"))


# Status labels of the documents page and of the storage page.
STATUS_LABELS_DOCUMENTS = {"completed": "Completo", "processing": "En proceso", "pending_confirmation": "Pendiente",
                           "queued": "En cola", "error": "Error"}
STATUS_LABELS_STORAGE = {"completed": "Procesado", "processing": "Pendiente", "error": "Error"}


def status_label(status, page: str = "documents") -> Column:
    """Status → Spanish label, unknown → raw."""
    m = STATUS_LABELS_DOCUMENTS if page == "documents" else STATUS_LABELS_STORAGE
    return F.coalesce(_lookup(m, _c(status)), _c(status))


# Message fragments of the failure classes and retryable errors.
OCR_FAILURE_WORDS = ("No se pudo extraer texto", "Mistral", "OCR")
MODEL_FAILURE_WORDS = ("Gemini", "Failed to parse", "generateContent")
RETRYABLE_STATUS = (429, 500, 502, 503)
RETRYABLE_PHRASES = ("econnreset", "econnrefused", "etimedout", "socket hang up", "resource exhausted",
                     "rate limit", "quota")


def _any_contains(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(c.contains(F.lit(w)), F.lit(False))
    return out


def failure_category(message) -> Column:
    """H33: 'ocr', 'model' or 'other' from the error message."""
    m = _c(message)
    return (F.when(_any_contains(m, OCR_FAILURE_WORDS), "ocr")
            .when(_any_contains(m, MODEL_FAILURE_WORDS), "model").otherwise("other"))


def is_retryable(status, message) -> Column:
    """Retryable HTTP status, or a network / quota phrase (case-insensitive)."""
    return (F.coalesce(_c(status).isin(*RETRYABLE_STATUS), F.lit(False))
            | _any_contains(F.lower(F.coalesce(_c(message), F.lit(""))), RETRYABLE_PHRASES))
