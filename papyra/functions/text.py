"""Text, key and file expressions.

Native Column expressions only; the accent table is generated from a rule
(Unicode canonical decomposition) rather than typed out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: every lower-case Latin letter in
    Latin-1, Extended-A/B and Extended Additional whose canonical
    decomposition is a plain ASCII letter plus combining marks maps to that
    letter. Spark has no NFD function, so this is the exact equivalent of
    ``normalize('NFD')`` followed by removing U+0300-U+036F for these blocks.
    """
    src, dst = [], []
    ranges = [(0x00C0, 0x0250), (0x1E00, 0x1F00)]
    for lo, hi in ranges:
        for cp in range(lo, hi):
            ch = chr(cp)
            if ch != ch.lower():
                continue  # input is lower-cased first
            d = unicodedata.normalize("NFD", ch)
            base = "".join(x for x in d if not (0x300 <= ord(x) <= 0x36F))
            if len(d) > 1 and len(base) == 1 and base.isascii():
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c) -> Column:
    src, dst = accent_table()
    # combining marks already present in the text are removed as NFD would
    return F.regexp_replace(F.translate(_c(c), src, dst), r"[\u0300-\u036f]", "")


def slugify(c) -> Column:
    """H5: lower, strip accents, runs of non ``[a-z0-9]`` become '-', trim '-'."""
    s = strip_accents(F.lower(_c(c)))
    s = F.regexp_replace(s, "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def storage_key(user_id, folder, filename) -> Column:
    """H6: ``{user}/{folder}/{filename}``."""
    return F.concat_ws("/", _c(user_id).cast("string"), _c(folder), _c(filename))


def inbox_key(user_id, epoch_ms, filename) -> Column:
    """H6 inbox form: ``{user}/inbox/{epochms}-{filename}``."""
    return F.concat_ws("/", _c(user_id).cast("string"), F.lit("inbox"),
                       F.concat(_c(epoch_ms).cast("string"), F.lit("-"), _c(filename)))


def typed_key(user_id, type_name, filename) -> Column:
    """H7: ``{user}/tipos/{slug(type)}/{filename}``."""
    return F.concat_ws("/", _c(user_id).cast("string"), F.lit("tipos"), slugify(type_name), _c(filename))


def truncate_marked(c, n: int, marker: str) -> Column:
    """First ``n`` characters plus ``marker`` when the text is longer."""
    t = _c(c)
    return F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, F.lit(marker)).otherwise(F.lit("")))


# Page separator and OCR failure text.
PAGE_SEPARATOR = "\n\n--- PÁGINA ---\n\n"
NO_TEXT_ERROR = ("Mistral OCR: No se pudo extraer texto del documento. El archivo puede estar "
                 "vacío, corrupto o protegido con contraseña.")


def page_text(markdown, text) -> Column:
    """H12 per page: markdown, else text, else '' (empty strings fall through)."""
    m, t = _c(markdown), _c(text)
    return F.coalesce(F.when(m != "", m), F.when(t != "", t), F.lit(""))


# Fixed value: a line "has values" when it matches this pattern.
VALUE_LINE = r"\d{2,}|@|\$\s*\d+|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"


def value_line_ratio(c) -> Column:
    lines = F.split(_c(c), "\n", -1)
    hits = F.size(F.filter(lines, lambda l: l.rlike(VALUE_LINE)))
    return hits / F.size(lines)


def text_quality(c) -> Column:
    """Shorter than 100 chars fails; otherwise at least 20 % of the
    lines must carry a value (digits, @, amounts or dates)."""
    t = _c(c)
    return F.when(t.isNull(), F.lit(None)).when(F.length(t) < 100, F.lit(False)) \
        .otherwise(value_line_ratio(t) >= 0.2)


def content_hash(c) -> Column:
    """Hex SHA-256 of the content (string or binary)."""
    return F.sha2(_c(c), 256)


def extension(filename) -> Column:
    """Lower-cased text after the last '.'; the whole name when there is no dot."""
    return F.lower(F.element_at(F.split(_c(filename), r"\.", -1), -1))


def estimate_size(filename) -> Column:
    """Estimated bytes by extension."""
    e = extension(filename)
    return (F.when(e == "pdf", F.lit(1.2 * 1024 * 1024))
            .when(e.isin("png", "jpg", "jpeg", "webp"), F.lit(800.0 * 1024))
            .when(e.isin("xlsx", "csv"), F.lit(200.0 * 1024))
            .otherwise(F.lit(500.0 * 1024)))


def mime_from_name(filename) -> Column:
    """H24: '.pdf' (case-insensitive) is a PDF, anything else is treated as JPEG."""
    return F.when(F.lower(_c(filename)).endswith(".pdf"), F.lit("application/pdf")).otherwise(F.lit("image/jpeg"))


# MIME type per file extension as an upload would report it.
MIME_BY_EXTENSION = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "webp": "image/webp", "csv": "text/csv", "txt": "text/plain",
}


def mime_from_extension(filename) -> Column:
    m = F.create_map(*[F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.element_at(m, extension(filename)), F.lit("application/octet-stream"))
