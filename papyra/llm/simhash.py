"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are the leaves of a binary trie. Pairs of nodes of the
same depth are traversed together from the root, the bits in which they
differ are added up, and a pair is dropped as soon as they exceed the budget.

To spread the work the 64 bits are cut into blocks, one more than the budget:
two fingerprints within it agree on some block, so each is sent once per
block to the trie of that block's value, rotated so that the block comes
first. The leaves of a large trie are dealt again in the same way by the bits
that follow: the whole budget falls on those, so two leaves within it agree on
one of their blocks too. A fingerprint thus goes to at most (budget + 1)^2
tries, however many fingerprints there are. What is crowded even then (a dense
ball of fingerprints) is cut into chunks of which every two meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, free_name, id_text, stored
from .components import components, join_labels

# A trie of more leaves is dealt again, then cut; two chunks meet in one group.
CHUNK = 1024
# Leaf pairs whose tries are traversed together in one array pass.
WAVE = 1 << 22


def fingerprint(text: str, shingle_words: int = 4) -> int:
    """64-bit SimHash of the word shingles (repeats included) of a text."""
    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42)
                  for a, b in zip(begins[:1 - shingle_words].tolist(), ends[shingle_words - 1:].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` of every whole text (fp: the 64 bits as a
    signed long). Null or empty text: 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or "", shingle_words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    base = id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return base.mapInArrow(rows, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def trie_links(leaves: np.ndarray, group: np.ndarray, budget: int) -> np.ndarray:
    """Component label (a place) of each leaf. ``leaves`` are 64-bit values
    sorted inside their ``group`` (ascending numbers), distinct there; links
    are between leaves of a group that differ in ``budget`` bits at most."""
    n = len(leaves)
    label = np.arange(n)
    lo = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    hi = np.r_[lo[1:], n] if n else lo
    a0, a1, b0, b1 = lo, hi, lo, hi
    diff = np.zeros(len(lo), np.int8)
    for depth in range(65):  # at 64 every node is a leaf
        # leaf against leaf: compare at once; a leaf against itself ends
        ends = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[ends], b0[ends]
        near = (x != y) & (np.bitwise_count(leaves[x] ^ leaves[y]) <= budget)
        label = join_labels(n, x[near], y[near], label)
        a0, a1, b0, b1, diff = (v[~ends] for v in (a0, a1, b0, b1, diff))
        if not len(a0):
            break
        ones = np.r_[0, np.cumsum((leaves >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        twin = a0 == b0
        kids = [(a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None),
                (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, ~twin)]
        parts = []
        for p0, p1, q0, q1, d, also in kids:
            ok = (p1 > p0) & (q1 > q0) & (d <= budget)
            if also is not None:
                ok &= also
            parts.append((p0[ok], p1[ok], q0[ok], q1[ok], d[ok]))
        a0, a1, b0, b1, diff = (np.concatenate(v) for v in zip(*parts, strict=True))
    return label


def _forest(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, value, sub, part, rotated, fp), whole groups one after another,
    to the edges of a forest that joins the linked fingerprints of a group."""

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, leaves, fp = rows
        by = np.lexsort((leaves, key))
        key, leaves, fp = key[by], leaves[by], fp[by]
        label = trie_links(leaves, key, budget)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["a", "b"])

    kept, last, pairs = [], -1, 0
    seen = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        ids = np.stack(cols[:4], axis=1)
        new = np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]
        new[0] = seen is None or (ids[0] != seen).any()
        seen = ids[-1]
        key = last + np.cumsum(new)
        last = int(key[-1])
        # cut before a group whenever the waves' leaf pairs are enough
        begins = np.flatnonzero(new)
        at = 0
        for g, begin in enumerate(begins.tolist()):
            size = (begins[g + 1] if g + 1 < len(begins) else len(key)) - begin
            if pairs > WAVE:
                kept.append((key[at:begin], cols[4][at:begin].view(np.uint64), cols[5][at:begin]))
                yield solve([np.concatenate(v) for v in zip(*kept, strict=True)])
                kept, pairs, at = [], 0, begin
            pairs += size * size
        kept.append((key[at:], cols[4][at:].view(np.uint64), cols[5][at:]))
    if kept:
        yield solve([np.concatenate(v) for v in zip(*kept, strict=True)])


def links(fps: DataFrame, budget: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a, b`` between the distinct fingerprints of ``fps`` (column fp)
    that join exactly those that a chain of steps of ``budget`` differing bits
    at most connects. A group never gives all its pairs: only a forest of its
    linked fingerprints leaves a task."""
    return dealt(fps, budget, chunk).mapInArrow(lambda b: _forest(b, budget), "a long, b long")


def dealt(fps: DataFrame, budget: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``block, value, sub, part, rotated, fp``: the tries (by the first four)
    that each fingerprint goes to, a trie whole in one task."""
    n_blocks = budget + 1
    cuts = [64 * k // n_blocks for k in range(n_blocks + 1)]

    def part(k: int):
        width = cuts[k + 1] - cuts[k]
        left = F.shiftleft("fp", cuts[k])
        rotated = left.bitwiseOR(F.shiftrightunsigned("fp", 64 - cuts[k])) if cuts[k] else F.col("fp")
        return F.struct(F.lit(k).cast("long").alias("block"),
                        F.shiftrightunsigned(rotated, 64 - width).alias("value"), rotated.alias("rotated"))

    def second(width: int):
        """The blocks of the bits after the first block, as hashes of place and value."""
        rest = 64 - width
        ends = [rest * k // n_blocks for k in range(n_blocks + 1)]
        bits = lambda k: F.shiftrightunsigned(F.shiftleft("rotated", width + ends[k]), 64 - (ends[k + 1] - ends[k]))
        return F.array(*[F.xxhash64(F.lit(k), bits(k)) for k in range(n_blocks)])

    def crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > chunk)

    spread = fps.select("fp", F.explode(F.array(*[part(k) for k in range(n_blocks)])).alias("p")).select("fp", "p.*")
    large = stored(crowded(spread, ["block", "value"]).select("block", "value", F.lit(True).alias("large")), "large-tries")
    none = F.lit(-1).cast("long")
    if large.limit(1).count():
        widths = {k: cuts[k + 1] - cuts[k] for k in range(n_blocks)}
        again = F.coalesce(*[F.when(F.col("block") == k, second(w)) for k, w in widths.items()])
        spread = (spread.join(large, ["block", "value"], "left")
                  .withColumn("sub", F.explode(F.when(F.col("large"), again).otherwise(F.array(none)))).drop("large"))
        dense = crowded(spread.filter(F.col("sub") != -1), ["block", "value", "sub"]).select(
            "block", "value", "sub", F.ceil(F.col("n") / chunk).cast("long").alias("chunks"))
        spread = spread.join(stored(dense, "dense-tries"), ["block", "value", "sub"], "left")
    else:
        spread = spread.withColumns({"sub": none, "chunks": F.lit(None).cast("long")})
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    # chunk c meets every other chunk j in the part numbered by the two
    parts = F.when(F.col("chunks").isNull(), F.array(none)).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != F.col("mine")),
        lambda j: F.least(j, F.col("mine")) * F.col("chunks") + F.greatest(j, F.col("mine"))))
    key = ["block", "value", "sub", "part"]
    return (spread.withColumn("mine", mine).select("block", "value", "sub", F.explode(parts).alias("part"), "rotated", "fp")
            .repartition(*key).sortWithinPartitions(*key))


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` per input row: rows have
    one ``root`` exactly if a chain of links of ``max_bits`` differing
    fingerprint bits at most joins them; ``component_id`` is the smallest id
    there.

    Fingerprints are computed once and stored; only distinct ones are joined,
    so a group of copies of any size is one leaf, and it comes back by an
    equi-join on the fingerprint, whose hot values AQE splits.

    Null or empty text and texts without words: fingerprint 0, linked like any
    other. Null ids take part but name a component only if it has no other
    (null). Repeated rows each get their row. An empty table gives no rows.
    """
    base = stored(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    distinct = stored(base.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(distinct, max_bits))
    grouped = (distinct.join(found, distinct["fp"] == found["node"], "left")
               .select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    grouped = stored(grouped, "grouped")
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(grouped.join(smallest, "root").select("fp", "root", "component_id"), "named")
    return base.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_fingerprint(col: str = "fp"):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """Pipeline form: of each group of near-duplicates the row with the
    smallest id (null ids last; of rows with one id, the smallest text hash)
    stays, with all its columns; a row repeated with id and text stays once.
    Nulls, empty texts and ties as in ``near_duplicates``; an empty table stays
    empty; extra columns may have any name."""
    found = near_duplicates(docs, **params)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    row_id, row_hash = free_name(docs, "_kept_id"), free_name(docs, "_kept_hash")
    keepers = found.groupBy("root").agg(F.min(rank).alias("r")).select(
        F.col("r.doc_id").alias(row_id), F.col("r.text_hash").alias(row_hash))
    keepers = stored(keepers, "keepers")
    rows = docs.join(keepers, docs["doc_id"].eqNullSafe(keepers[row_id]) & (F.xxhash64(docs["text"]) == keepers[row_hash]), "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.limit(1).count():
        return rows
    marked = rows.withColumn(row_hash, F.xxhash64(rows["text"]))
    return marked.dropDuplicates(["doc_id", row_hash]).drop(row_hash)
