"""Repair and parse the JSON that model replies and stored rows carry (H1, H2, H4).

All native Column expressions: regex clean-up chains plus ``try_parse_json``
(VARIANT), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the reply clean-up (in the order they are applied).
FENCE_OPEN = r"(?m)^```(?:json)?\s*\n?"
FENCE_CLOSE = r"(?m)\n?```\s*$"
OBJECT_SPAN = r"\{[\s\S]*\}"
TRAILING_COMMA = r",(\s*[}\]])"
LINE_COMMENT = r"(?m)//.*$"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_parse_json(text) -> Column:
    """VARIANT of ``text`` only when the whole text is one JSON value.
    ``try_parse_json`` alone stops after the first value and ignores what
    follows; wrapped as ``[text,0]`` any trailing content makes it fail."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), _c(text), F.lit(",0]")))
    return F.try_variant_get(wrapped, "$[0]", "variant")


def clean_model_json(text, mode: str = "safe") -> Column:
    """H1 text stage: strip code fences, keep the greedy ``{...}`` span, drop
    commas before ``}``/``]``, then strip comments. Null when no object.

    ``mode='reference'`` strips ``//...`` like the original (which damages
    URLs inside values); ``mode='safe'`` leaves line comments alone.
    """
    t = _c(text)
    t = F.regexp_replace(t, FENCE_OPEN, "")
    t = F.regexp_replace(t, FENCE_CLOSE, "")
    span = F.regexp_extract(t, OBJECT_SPAN, 0)
    span = F.when(span == "", F.lit(None)).otherwise(span)
    span = F.regexp_replace(span, TRAILING_COMMA, "$1")
    if mode == "reference":
        span = F.regexp_replace(span, LINE_COMMENT, "")
    span = F.regexp_replace(span, BLOCK_COMMENT, "")
    return span


def parse_model_json(text, mode: str = "safe") -> Column:
    """H1: VARIANT of the repaired reply, null when it cannot be parsed.
    ``safe`` (default) tries a plain parse first and keeps ``//`` inside
    values; ``reference`` runs the original clean-up chain only."""
    cleaned = strict_parse_json(clean_model_json(text, mode))
    if mode == "safe":
        return F.coalesce(strict_parse_json(_c(text)), cleaned)
    return cleaned


def repair_python_dict(text, keywords: bool = True) -> Column:
    """H2: valid JSON parses as is; otherwise single quotes become double
    quotes (and, with ``keywords``, True/False/None become JSON literals);
    anything still invalid is null."""
    t = _c(text)
    fixed = F.regexp_replace(t, "'", '"')
    if keywords:
        fixed = F.regexp_replace(fixed, r"\bTrue\b", "true")
        fixed = F.regexp_replace(fixed, r"\bFalse\b", "false")
        fixed = F.regexp_replace(fixed, r"\bNone\b", "null")
    return F.coalesce(strict_parse_json(t), strict_parse_json(fixed))


def json_summary(json_text) -> Column:
    """H4: ``extracted_data->>'summary'``."""
    return F.get_json_object(_c(json_text), "$.summary")


def vget(variant, path: str, type_: str = "string") -> Column:
    return F.try_variant_get(_c(variant), path, type_)
