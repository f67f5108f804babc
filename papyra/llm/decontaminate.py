"""Benchmark decontamination by spaced seeds.

A window of ``span`` words is hashed under fixed masks that each ignore some
positions: positions fall into residue classes and a mask ignores ``errors``
of them, so whichever ``errors`` words of a window are substituted, one mask
ignores them all. Training and test hashes are joined, and the windows behind
each hit are compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO_KEY, Memo, _slices
from .common import free_name, kept_alone, stored

WORD = re.compile(r"\w+")
# Residue classes of the positions, bits of the test-hash bitmap.
CLASSES = 4
BITMAP_BITS = 25
_ODD = np.array([2 * i + 0x9E3779B97F4A7C15 for i in range(64)], np.uint64) * np.uint64(0xD1342543DE82EF95)


def masks(errors: int) -> list[tuple[int, ...]]:
    """The residue classes that each mask keeps."""
    return list(combinations(range(CLASSES), CLASSES - errors))


@kept_alone
def _word_hash() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode()), longest=MEMO_KEY)


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(_word_hash().__getitem__, words), np.uint64, len(words))


def allowed(size: int, span: int, errors: int) -> int:
    """Substitutions in a window of ``size`` words: in proportion to ``span``,
    rounded down, so very short items are met exactly."""
    return errors * size // span


def seeds(h: np.ndarray, span: int, errors: int) -> np.ndarray:
    """Hash of every window under every mask: masks x windows."""
    n = len(h) - span + 1
    if n <= 0:
        return np.empty((len(masks(errors)), 0), np.uint64)
    part = [np.zeros(n, np.uint64) for _ in range(CLASSES)]
    for p in range(span):
        part[p % CLASSES] += h[p:p + n] * _ODD[p]
    out = []
    for k, kept in enumerate(masks(errors)):
        x = sum((part[c] for c in kept), np.full(n, k + 1, np.uint64))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x ^ (x >> np.uint64(29)))
    return np.stack(out)


def _windows(ids: pa.Array, extra: pa.Array, hits: list[tuple[int, np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Rows (id, extra, seed, window) of (row, seeds, windows) triples."""
    row = np.repeat([r for r, _, _ in hits], [len(s) for _, s, _ in hits]) if hits else np.empty(0, np.int64)
    flat = np.concatenate([w.reshape(-1) for _, _, w in hits]) if hits else np.empty(0, np.uint64)
    width = hits[0][2].shape[1] if hits else 1
    ends = pa.array(np.arange(len(row) + 1, dtype=np.int32) * width)
    seed = np.concatenate([s for _, s, _ in hits]) if hits else np.empty(0, np.uint64)
    take = pa.array(row.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [ids.take(take), extra.take(take), pa.array(seed.view(np.int64)),
         pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))], names)


def test_seeds(benchmark: DataFrame, span: int, errors: int, id_col: str, text_col: str) -> DataFrame:
    """``item_id, seed, item_window`` of every window of every item; an item
    of fewer than ``span`` words is one window of its whole length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: dict[int, list] = {}
            for r, text in enumerate(batch.column(1).to_pylist()):
                h = word_hashes(text or "")
                size = min(len(h), span)
                if size:
                    s = seeds(h, size, allowed(size, span, errors))
                    w = np.lib.stride_tricks.sliding_window_view(h, size)
                    hits.setdefault(size, []).append((r, s.reshape(-1), np.tile(w, (len(s), 1))))
            for found in hits.values():
                yield _windows(batch.column(0), batch.column(0), found, ["item_id", "item", "seed", "item_window"])

    base = benchmark.select(benchmark[id_col].alias("item_id"), benchmark[text_col].alias("text"))
    kind = base.schema["item_id"].dataType.simpleString()
    return (base.mapInArrow(rows, f"item_id {kind}, item {kind}, seed long, item_window array<long>")
            .select("item_id", "seed", "item_window").distinct())


def _bitmap(tests: DataFrame) -> np.ndarray:
    """Bits of all test seeds, two each, in a bitmap of fixed size (4 MB): it
    tells most training seeds apart before the join, whatever the size of the
    benchmark; a false hit costs a row, never a result."""
    low = (1 << BITMAP_BITS) - 1
    slot = F.explode(F.array(F.col("seed").bitwiseAND(low),
                             F.shiftrightunsigned("seed", BITMAP_BITS).bitwiseAND(low)))
    pages = (tests.select(slot.alias("slot"))
             .groupBy(F.expr("slot div 32768").alias("page"))
             .agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")).collect())
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for p in pages:
        out[p.page * 4096:(p.page + 1) * 4096] = np.frombuffer(bytes(p.bits), np.uint8)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, span: int = 12, errors: int = 2, id_col: str = "doc_id",
               text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_item_words: int = 1) -> DataFrame:
    """``doc_id, text_hash, item_id, n_windows, same_words`` for each text and
    item that share a window of ``span`` words (letters and digits, lower
    case) with at most ``errors`` substitutions: how many windows of the item,
    and the most equal words in one. An item of fewer words is one window of
    its whole length, with ``errors`` scaled down (by 12 and 2: one from 6
    words on, none below); texts are scanned for the lengths that occur.

    Test seeds are stored once. Training texts are scanned in place; only
    seeds that the bitmap of test seeds cannot rule out leave the scan, with
    their window, and meet the test seeds in an equi-join, whose hot seeds AQE
    splits. Windows are compared natively.

    Items of fewer than ``min_item_words`` words (up to the span) are left out.
    Texts and items without a word, and texts shorter than the item's windows,
    share none. Null and repeated ids take part; rows that repeat id and
    text give one result. An empty table gives no rows.
    """
    # an item of fewer words than the span has windows of its own length
    tests = stored(test_seeds(benchmark, span, errors, item_id, item_text).filter(F.size("item_window") >= min(min_item_words, span)), "test-seeds")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(tests))
    low = np.uint64((1 << BITMAP_BITS) - 1)
    sizes = sorted(r[0] for r in tests.select(F.size("item_window")).distinct().collect())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        names = ["doc_id", "text_hash", "seed", "window"]

        def may_hit(x: np.ndarray, shift: int) -> np.ndarray:
            slot = (x >> np.uint64(shift)) & low
            return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for batch in batches:
            for part in _slices(batch):
                hits: dict[int, list] = {}
                for r, text in enumerate(part.column(1).to_pylist()):
                    h = word_hashes(text or "")
                    for size in sizes:
                        s = seeds(h, size, allowed(size, span, errors))
                        mask, at = np.nonzero(may_hit(s, 0))
                        if len(at):
                            ok = may_hit(s[mask, at], BITMAP_BITS)
                            mask, at = mask[ok], at[ok]
                        if len(at) and len(s) == 1:  # an exact window again is the same row again
                            at = at[np.unique(s[0, at], return_index=True)[1]]
                            mask = np.zeros_like(at)
                        if len(at):
                            hits.setdefault(size, []).append(
                                (r, s[mask, at], np.lib.stride_tricks.sliding_window_view(h, size)[at]))
                for found in hits.values():
                    yield _windows(part.column(0), part.column(2), found, names)

    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
                       F.xxhash64(docs[text_col]).alias("text_hash"))
    kind = base.schema["doc_id"].dataType.simpleString()
    found = base.mapInArrow(rows, f"doc_id {kind}, text_hash long, seed long, window array<long>")
    same = F.aggregate(F.zip_with("window", "item_window", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    size = F.size("item_window")
    return (found.join(tests, "seed").filter(F.size("window") == size).withColumn("same", same)
            .filter(F.col("same") >= size - F.floor(size * errors / span))
            .groupBy("doc_id", "text_hash", "item_id")
            .agg(F.count_distinct("item_window").alias("n_windows"), F.max("same").alias("same_words")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_item_words: int = 5, **params) -> DataFrame:
    """Pipeline form: rows that share a window with a benchmark item go, the
    others keep all columns. Items of fewer than ``min_item_words`` words drop
    no document, since such words stand in clean texts too; ``find_leaks``
    with its default tells what they meet. Nulls, repeats and empty texts as in
    ``find_leaks``; an empty table stays empty; extra columns may have any
    name."""
    row_id, row_hash = free_name(docs, "_leaky_id"), free_name(docs, "_leaky_hash")
    leaks = find_leaks(docs, benchmark, min_item_words=min_item_words, **params).select(
        F.col("doc_id").alias(row_id), F.col("text_hash").alias(row_hash)).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks[row_id]) & (F.xxhash64(docs["text"]) == leaks[row_hash]), "left_anti")
