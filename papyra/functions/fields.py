"""Field, threshold, cost and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Accepted spellings of each field type.
NUMBER_TYPES = ("number", "integer", "float", "currency")
DATE_TYPES = ("date", "datetime", "timestamp")
BOOLEAN_TYPES = ("boolean", "bool")
ARRAY_TYPES = ("array", "list")


def normalize_field_type(c) -> Column:
    """H8: lower+trim then map synonyms; anything else is 'string'."""
    t = F.lower(F.trim(_c(c)))
    return (F.when(t.isin(*NUMBER_TYPES), "number").when(t.isin(*DATE_TYPES), "date")
            .when(t.isin(*BOOLEAN_TYPES), "boolean").when(t.isin(*ARRAY_TYPES), "array")
            .otherwise("string"))


DEFAULT_THRESHOLD = 0.7


def effective_threshold(threshold) -> float:
    """0 or unset behaves as the default (the original uses ``||``)."""
    return threshold or DEFAULT_THRESHOLD


def is_others(flag, confidence, threshold: float | None = None) -> Column:
    """Flagged, or confidence strictly below the threshold. A missing
    confidence does not count as low (comparison with undefined is false)."""
    thr = effective_threshold(threshold)
    return F.coalesce(_c(flag), F.lit(False)) | F.coalesce(_c(confidence) < F.lit(thr), F.lit(False))


# Unit costs in USD.
CHARS_PER_TOKEN = 4
MODEL_INPUT_COST_PER_M = 0.075
MODEL_OUTPUT_COST_PER_M = 0.30
OCR_COST_PER_PAGE = 0.001
VISION_COST_PER_IMAGE = 0.002


def token_estimate(chars) -> Column:
    """ceil(chars/4); 0 when missing or 0."""
    ch = _c(chars)
    return F.when(ch.isNull() | (ch == 0), F.lit(0)).otherwise(F.ceil(ch / CHARS_PER_TOKEN)).cast("bigint")


def stage_cost(provider, pages, is_vision, input_chars, output_chars,
               ocr_provider: str = "ocr", vision_provider: str = "vision") -> Column:
    """OCR provider with pages → per page; vision → per image; else token cost."""
    pg = _c(pages)
    tin, tout = token_estimate(input_chars), token_estimate(output_chars)
    return (F.when((_c(provider) == ocr_provider) & pg.isNotNull() & (pg != 0), pg * OCR_COST_PER_PAGE)
            .when((_c(provider) == vision_provider) | F.coalesce(_c(is_vision), F.lit(False)),
                  F.lit(VISION_COST_PER_IMAGE))
            .otherwise(tin / 1_000_000 * MODEL_INPUT_COST_PER_M + tout / 1_000_000 * MODEL_OUTPUT_COST_PER_M)
            ).cast("double")


def js_round(x) -> Column:
    """``Math.round``: floor(x + 0.5)."""
    return F.floor(_c(x) + F.lit(0.5))


def usage_percent(used, limit) -> Column:
    """Unlimited (-1) or non-positive limit → 0, else round(used/limit*100)."""
    lim = _c(limit)
    return F.when(lim.isNull() | (lim <= 0), F.lit(0)).otherwise(
        js_round(_c(used).cast("double") / lim * 100)).cast("bigint")


def progress_percent(done, total) -> Column:
    t = _c(total)
    return F.when(t > 0, js_round(_c(done).cast("double") / t * 100)).otherwise(F.lit(0)).cast("bigint")


FIELD_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("required", T.BooleanType()),
    T.StructField("description", T.StringType()), T.StructField("value", T.StringType()),
])
EXTRACTED_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("fields", T.ArrayType(FIELD_SCHEMA)),
    T.StructField("key_fields", T.ArrayType(FIELD_SCHEMA)),
])


def parse_extracted(json_text) -> Column:
    """extracted_data text → struct<summary, fields, key_fields>; scalar and
    array values come back as their JSON text."""
    return F.from_json(_c(json_text), EXTRACTED_SCHEMA)


def display_fields(extracted) -> Column:
    """``fields`` if present (an empty array is kept), else ``key_fields``, else []."""
    e = _c(extracted)
    return F.coalesce(e.getField("fields"), e.getField("key_fields"),
                      F.array().cast(T.ArrayType(FIELD_SCHEMA)))


def field_defaults(fields) -> Column:
    """H30 over an array of field structs: label=label||name, type=type||'string',
    required=required??false, description=description||''."""
    def fix(f):
        return F.struct(
            f.getField("name").alias("name"),
            F.coalesce(F.nullif(f.getField("type"), F.lit("")), F.lit("string")).alias("type"),
            F.coalesce(F.nullif(f.getField("label"), F.lit("")), f.getField("name")).alias("label"),
            F.coalesce(f.getField("required"), F.lit(False)).alias("required"),
            F.coalesce(f.getField("description"), F.lit("")).alias("description"),
        )
    return F.transform(_c(fields), fix)


def utc_timestamp(text) -> Column:
    """Text without 'Z' or an offset is UTC; parse to a timestamp. A text
    that is none gives null."""
    t = _c(text)
    zoned = t.endswith("Z") | t.contains("+") | t.rlike(r":\d{2}(?:[.]\d+)?-\d{2}:?\d{2}$")
    return F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))))


def add_month(ts) -> Column:
    """+ 1 calendar month (clamped to the month's last day)."""
    return _c(ts) + F.expr("INTERVAL 1 MONTH")


def round_confidence(x) -> Column:
    """Stored as decimal(5,2), half-up."""
    return _c(x).cast("decimal(5,2)")


def confidence_percent_text(x) -> Column:
    """H36 display: one decimal percent."""
    v = _c(x)
    return F.when(v.isNotNull(), F.format_string("%.1f%%", v.cast("double") * 100))
