"""Ranked lexical search by presence masks.

Every item (query) has a set of terms, every document the items' terms that it
holds. Inside a task a block of documents is turned into one posting list a
term; an item's lists are laid over each other as bitmaps, which gives each
document the mask of the terms it matches. Documents are grouped by mask, the
distinct masks are taken by descending highest possible score, and the item is
finished as soon as that falls below its k-th best score so far. Only the
task's k best documents an item leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _slices
from .common import free_name, stored

# Bytes up to 0x7F that are no digit or letter separate terms;
# A-Z count as a-z; the parameters of the score.
_FOLD = bytes(c if c > 0x7F or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isalpha() else 32 for c in range(256))
SCALE, TF, FLOOR, SLOPE, SATURATION = 1_000_000_000, 1000, 10, 90, 8

# Documents, and postings, that are searched together in a task.
BLOCK, BLOCK_POSTINGS = 8192, 4 << 20
# Distinct terms of the items that are searched in one pass over the postings.
TERMS_PER_PASS = 1_000_000


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, with repeats."""
    return (text or "").encode().translate(_FOLD).split()


def item_terms(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``item_id, row, term``: the distinct terms of each row of the items
    (``row`` tells rows apart that repeat an id)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = [sorted(set(terms(t))) for t in part.column(2).to_pylist()]
                take = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take),
                                                  pa.array([t for f in found for t in f], pa.binary())], ["item_id", "row", "term"])

    base = stored(items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
                  .withColumn("row", F.monotonically_increasing_id()).select("item_id", "row", "text"), "items")
    kind = base.schema["item_id"].dataType.simpleString()
    return stored(base.mapInArrow(rows, f"item_id {kind}, row long, term binary"), "item-terms")


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every whole text with a term: its terms
    with repeats (n), the vocabulary's terms among them and how often."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.get
        for batch in batches:
            for part in _slices(batch):
                sizes, at, which, tfs = [], [0], [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    sizes.append(len(words))
                    hits = np.fromiter((k for k in map(place, words) if k is not None), np.int32)
                    found, tf = np.unique(hits, return_counts=True)
                    which.append(found)
                    tfs.append(tf)
                    at.append(at[-1] + len(found))
                n, ends = np.array(sizes, np.int64), pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(np.int32))) for c in (which, tfs)]
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([c.take(some) for c in (part.column(0), pa.array(n), *lists)],
                                                 ["doc_id", "n", "terms", "tfs"])

    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(rows, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best of an item so far: highest score, then smallest id (rows
    without an id last)."""

    __slots__ = ("k", "scores", "ids", "no_id")

    def __init__(self, k: int):
        self.k, self.scores = k, np.empty(0, np.int64)
        self.ids, self.no_id = np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        some = scores > 0
        both = [np.r_[a, b[some]] for a, b in ((self.scores, scores), (self.ids, ids), (self.no_id, no_id))]
        by = np.lexsort((both[1], both[2], -both[0]))[:self.k]
        self.scores, self.ids, self.no_id = (v[by] for v in both)

    @property
    def least(self) -> int:
        """What a document must reach to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1


class Block:
    """Postings of a block of documents by term: places of the documents and
    what one occurrence list contributes per unit of weight."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        m = FLOOR + (SLOPE * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        by = np.argsort(term, kind="stable")
        self.doc, term = doc[by], term[by]
        tf = tf[by].astype(np.int64)
        self.part = (SCALE * tf) // (TF * tf + SATURATION * m[self.doc])
        self.size, self.at, self.most = len(n), {}, {}
        if len(term):
            begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            ends = np.r_[begins[1:], len(term)]
            self.at = {int(t): (int(a), int(b)) for t, a, b in zip(term[begins], begins, ends, strict=True)}
            self.most = dict(zip(self.at, np.maximum.reduceat(self.part, begins).tolist(), strict=True))

    def search(self, wanted: list[int], weights: np.ndarray, ids: np.ndarray, no_id: np.ndarray, best: Best) -> int:
        """Adds the block's documents for one item; returns the masks evaluated."""
        found = [(t, int(w)) for t, w in zip(wanted, weights, strict=True) if t in self.at and w > 0]
        if sum(w * self.most[t] for t, w in found) < best.least:
            return 0
        # the mask of every document: one bitmap of 64 terms after another
        words = (len(found) + 63) // 64
        masks = np.zeros((words, self.size), np.uint64)
        for k, (t, _) in enumerate(found):
            a, b = self.at[t]
            masks[k // 64, self.doc[a:b]] |= np.uint64(1 << (k % 64))
        some = np.flatnonzero(masks.any(axis=0))
        own = masks[:, some]
        by = np.lexsort(own)
        own, some = own[:, by], some[by]
        new = np.flatnonzero(np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0)]) if len(some) else np.empty(0, np.int64)
        distinct, ends = own[:, new], np.r_[new[1:], len(some)]
        bound = np.zeros(len(new), np.int64)
        for k, (t, w) in enumerate(found):
            bound += ((distinct[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64) * (w * self.most[t])
        done = 0
        order = np.argsort(-bound, kind="stable")
        while done < len(order) and bound[order[done]] >= best.least:
            # the next few masks together: those that the last of them still lets through
            step = order[done:done + 64]
            step = step[bound[step] >= best.least]
            docs = np.sort(np.concatenate([some[new[g]:ends[g]] for g in step.tolist()]))
            scores = np.zeros(len(docs), np.int64)
            for t, w in found:
                a, b = self.at[t]
                held = self.doc[a:b]
                place = np.searchsorted(held, docs)
                hit = held[np.minimum(place, len(held) - 1)] == docs
                scores[hit] += w * self.part[a:b][place[hit]]
            best.add(scores, ids[docs], no_id[docs])
            done += len(step)
        return done


def _search(posted: DataFrame, wanted: dict[int, tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``row, doc_id, score``: the k best documents of each item in each task."""
    items = posted.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {row: Best(k) for row in items.value}
        kept: list[pa.RecordBatch] = []

        def solve() -> None:
            t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            lists = t.column("terms")
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]
            block = Block(t.column("n").to_numpy(), ends, lists.flatten().to_numpy(zero_copy_only=False),
                          t.column("tfs").flatten().to_numpy(zero_copy_only=False), n_docs, n_terms)
            no_id = t.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = t.column("doc_id").fill_null(0).to_numpy()
            for row, (which, weights) in items.value.items():
                block.search(which, weights, ids, no_id, best[row])

        n, size = 0, 0
        for batch in batches:
            for part in _slices(batch):
                kept.append(part)
                n, size = n + part.num_rows, size + len(part.column("terms").flatten())
                if n >= BLOCK or size >= BLOCK_POSTINGS:
                    solve()
                    kept, n, size = [], 0, 0
        if n:
            solve()
        for row, b in best.items():
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), row)), pa.array(b.ids, mask=b.no_id), pa.array(b.scores)],
                                                 ["row", "doc_id", "score"])

    return posted.mapInArrow(rows, "row long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with
    a score above 0, by falling score and rising id.

    Whole texts are tokenised once; of each document only the items' terms it
    holds are stored, with their counts. Document frequencies, the number of
    documents and of terms are counted over all of them. The items are the
    query set: their terms are broadcast in passes of ``terms_per_pass`` terms
    (plus one item), so the broadcast has a fixed bound whatever their number.
    Of each task at most ``k`` documents an item are shuffled.

    Null and empty texts, and texts without a term, match nothing and are not
    counted. Items without a term, or of which no document holds a term, have
    no rows. Items and documents that repeat an id are ranked on their own;
    documents without an id come after those of the same score that have one.
    Ids of documents are integers; those of items may have any type.
    An empty table on either side: no rows.
    """
    spark = docs.sparkSession
    pairs = item_terms(items, item_id, item_text)
    n_pairs = pairs.count()
    passes = max(1, math.ceil(n_pairs / terms_per_pass))
    typed = docs.withColumn(own := free_name(docs, "search_id"), docs[id_col].cast("long"))
    done = []
    for p in range(passes):
        asked = pairs if passes == 1 else pairs.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == p)
        held = asked.select("row", "term").collect()  # about terms_per_pass
        vocabulary = sorted({bytes(r.term) for r in held})
        place = {t: i for i, t in enumerate(vocabulary)}
        posted = stored(postings(typed, vocabulary, own, text_col), "postings")
        n_docs, n_terms = posted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not held:
            continue
        df = dict.fromkeys(range(len(vocabulary)), 0)
        df |= {r.term: r.n for r in posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        by_row: dict[int, list[int]] = {}
        for r in held:
            by_row.setdefault(r.row, []).append(place[bytes(r.term)])
        wanted = {row: (which, np.array([weight(n_docs, df[t]) for t in which], np.int64)) for row, which in by_row.items()}
        done.append(_search(posted, wanted, n_docs, n_terms, k))
    names = pairs.select("item_id", "row").distinct()
    if not done:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).limit(0)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(names, "row").select("item_id", "rank", "doc_id", "score")
