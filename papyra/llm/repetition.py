"""Quality rules on repetition inside a text.

A suffix array over the words of each text and the longest common prefixes of
its neighbours give the intervals of maximal repeated substrings. The deepest
interval that holds a suffix is the longest repeat starting there; the union
of those spans is the part of the text covered by repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_text

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
# Words handled together in one array; a longer text is handled alone, whole.
GROUP_WORDS = 400_000


def suffix_order(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of several texts at once, by prefix doubling: positions in
    the order of (text, suffix within the text), and for each k the bucket
    (its first place in that order) of every position's next 2**k words.
    ``text`` numbers the text of each position, ascending."""
    n = len(codes)
    key = text * (int(codes.max()) + 1) + codes if n else codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    bucket = np.empty(n, np.int64)
    bucket[order] = start
    levels, width = [bucket], 1
    tied = ~(first & np.r_[first[1:], True]) if n else first
    active = order[tied]
    while len(active):
        later = active + width
        inside = later < n
        inside[inside] = text[later[inside]] == text[active[inside]]
        second = np.zeros(len(active), np.int64)
        second[inside] = bucket[later[inside]] + 1
        old = bucket[active]
        key = old * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key, old = active[by], key[by], old[by]
        place = np.arange(len(active))
        new_first = np.r_[True, key[1:] != key[:-1]]
        old_first = np.r_[True, old[1:] != old[:-1]]
        new_start = np.maximum.accumulate(np.where(new_first, place, 0))
        old_start = np.maximum.accumulate(np.where(old_first, place, 0))
        order[old + place - old_start] = active
        bucket = bucket.copy()
        bucket[active] = old + new_start - old_start
        levels.append(bucket)
        width *= 2
        active = active[~(new_first & np.r_[new_first[1:], True])]
    return order, levels


def longest_repeats(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position the words of the longest substring that starts there
    and occurs again in its text: the deepest common-prefix interval of its
    suffix."""
    n = len(codes)
    reach = np.zeros(n, np.int64)
    if n < 2:
        return reach
    order, levels = suffix_order(codes, text)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    one, two = order[pairs], order[pairs + 1]
    same = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = one + same, two + same
        ok = (x < n) & (y < n)
        ok[ok] = (text[x[ok]] == text[one[ok]]) & (text[y[ok]] == text[two[ok]]) & (levels[k][x[ok]] == levels[k][y[ok]])
        same[ok] += 1 << k
    lcp = np.zeros(n + 1, np.int64)
    lcp[pairs + 1] = same
    reach[order] = np.maximum(lcp[:-1], lcp[1:])
    return reach


def _covered(starts: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1))[:n] > 0


def repeat_figures(words: list[list[bytes]], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words covered by repeats of ``min_words`` or more, words of
    the longest repeat, and words inside 3-word windows that occur twice."""
    sizes = np.array([len(w) for w in words], np.int64)
    n, texts = int(sizes.sum()), len(words)
    text = np.repeat(np.arange(texts), sizes)
    codes = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64)
    reach = longest_repeats(codes, text)
    long_at, three_at = np.flatnonzero(reach >= min_words), np.flatnonzero(reach >= 3)
    covered = np.bincount(text, weights=_covered(long_at, reach[long_at], n), minlength=texts)
    three = np.bincount(text, weights=_covered(three_at, np.full(len(three_at), 3), n), minlength=texts)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text, reach)
    return covered.astype(np.int64), longest, three.astype(np.int64)


def _groups(texts: list[str]) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    some, words, n = [], [], 0
    for t in texts:
        w = t.encode().split()
        if some and n + len(w) > GROUP_WORDS:
            yield some, words
            some, words, n = [], [], 0
        some.append(t)
        words.append(w)
        n += len(w)
    if some:
        yield some, words


def measure(docs: DataFrame, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition figures of every whole text: ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat``.

    One narrow ``mapInArrow``: no shuffle; texts are grouped to about
    GROUP_WORDS words for one array pass, a longer text makes its own group.
    Null or empty text: all figures 0. Null and repeated ids pass through; an
    empty table gives no rows; extra columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts, words in _groups([t or "" for t in batch.column(1).to_pylist()]):
                covered, longest, three = repeat_figures(words, min_words)
                filled = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
                figures = {
                    "n_words": [len(w) for w in words],
                    "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
                    "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
                    "n_dup_lines": [len(x) - len(set(x)) for x in filled],
                    "n_repeat_words": three, "covered_words": covered, "longest_repeat": longest}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *[pa.array(v, pa.int64()) for v in figures.values()]],
                    ["doc_id", *figures])
                at += len(texts)

    base = id_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(rows, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, covered_words long, longest_repeat long")


def quality_rules(docs: DataFrame, min_words: int = 6, max_covered: float = 0.3, max_longest: int = 30,
                  **columns) -> DataFrame:
    """``measure`` plus ``base_failed`` (fewer than 50 words, or over half of
    them in repeated 3-word windows) and ``kept``: not failed, at most
    ``max_covered`` of the words covered by repeats of ``min_words`` or more,
    and no repeat of more than ``max_longest`` words."""
    m = measure(docs, min_words, **columns)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
