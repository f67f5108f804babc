"""Audit of how filters interact: what each removes in every order.

Five filters fail a text; the last one, "identical to an earlier text", needs
all texts together. Texts are range-partitioned by adaptive prefixes (as long
as it takes for no prefix to hold too many bytes), whole texts are inserted
into compressed tries whose terminals hold the smallest id, and a traversal
back to each row's terminal tells whether the row is a duplicate. Each row is
then one 5-bit mask; masks are counted per part and every order's figures are
sums over at most 32 masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices
from .common import UPPER, stored, utf8

# Fixed values of the rules: words, distinct words %, capitals %, symbols.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")

# First prefix length in bytes, and by what it grows where a prefix is crowded.
PREFIX, GROWTH = 16, 4
# Bytes of text that one prefix may hold, and that one trie (in a task) is filled with.
CROWDED, TRIE_BYTES = 1 << 20, 32 << 20
MAX_RANGES = 20_000


def text_mask(text: str, raw: bytes) -> int:
    """Filters A-D that a text fails, as bits."""
    words = raw.split()
    fails = (len(words) < MIN_WORDS,
             100 * len(set(words)) < MIN_DISTINCT * len(words),
             100 * (len(raw) - len(raw.translate(None, UPPER.encode()))) > MAX_CAPITALS * len(text),
             len(raw.translate(None, SYMBOLS)) < len(raw))
    return sum(1 << i for i, f in enumerate(fails) if f)


class Node:
    """A node of a compressed trie: the bytes on the edge to it, its children
    by their first byte, the smallest id of the text that ends here."""

    __slots__ = ("edge", "kids", "low")

    def __init__(self, edge: bytes = b"", low: int | None = None):
        self.edge, self.kids, self.low = edge, {}, low


def _shared(edge: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of an edge and the text from ``at`` on."""
    n = min(len(edge), len(text) - at)
    apart = np.flatnonzero(np.frombuffer(edge, np.uint8, n) != np.frombuffer(text, np.uint8, n, at))
    return int(apart[0]) if len(apart) else n


def insert(root: Node, text: bytes, row_id: int) -> Node:
    """Puts a whole text into the trie; returns its terminal."""
    node, at = root, 0
    while at < len(text):
        kid = node.kids.get(text[at])
        if kid is None:
            kid = node.kids[text[at]] = Node(text[at:])
            node, at = kid, len(text)
        elif text.startswith(kid.edge, at):
            node, at = kid, at + len(kid.edge)
        else:
            k = _shared(kid.edge, text, at)
            fork = node.kids[text[at]] = Node(kid.edge[:k])
            kid.edge = kid.edge[k:]
            fork.kids[kid.edge[0]] = kid
            node, at = fork, at + k
    if node.low is None or row_id < node.low:
        node.low = row_id
    return node


def smallest_ids(texts: list[bytes], ids: list[int]) -> list[int]:
    """For each row the smallest id among the rows with its text."""
    root = Node()
    ends = [insert(root, t, i) for t, i in zip(texts, ids, strict=True)]
    return [e.low for e in ends]


def crowded_prefixes(docs: DataFrame, limit: int = CROWDED) -> dict[int, np.ndarray]:
    """Hashes of the prefixes, by length, that hold more than ``limit`` bytes
    of text, or a 2^20th of all bytes if that is more: at most 2^20 hashes a
    length, whatever the table. Lengths grow until none is crowded or the
    texts end. The texts are read twice at most: for the first length, and
    once for all longer prefixes of those under a crowded one."""
    raw = utf8(F.col("text"))
    sizes = docs.select(F.octet_length(raw).cast("long").alias("size"), raw.alias("raw"))
    head = lambda length: F.xxhash64(F.substring("raw", 1, length))
    weighed = (F.sum("size").alias("size"), F.max("size").alias("longest"))
    counts = stored(sizes.groupBy(head(PREFIX).alias("h")).agg(*weighed), "prefixes")
    total, longest = counts.agg(F.sum("size"), F.max("longest")).first()
    limit = max(limit, (total or 0) >> 20)
    found: dict[int, np.ndarray] = {}
    length, rest = PREFIX, None
    while True:
        heavy = stored(counts.filter(F.col("size") > limit).select(F.col("h").alias("was")), "crowded")
        found[length] = np.sort(np.array([r.was for r in heavy.collect()], np.int64).view(np.uint64))
        if not len(found[length]):
            return found
        if rest is None:
            longer = [PREFIX * GROWTH ** k for k in range(1, 32) if PREFIX * GROWTH ** (k - 1) < longest]
            under = sizes.filter(F.col("size") > PREFIX).withColumn("was", head(PREFIX)).join(heavy, "was")
            rest = stored(under.select("size", F.col("was").alias(f"h{PREFIX}"), *[
                F.when(F.col("size") > n // GROWTH, head(n)).alias(f"h{n}") for n in longer]), "longer-prefixes")
        was, length = length, length * GROWTH
        if f"h{length}" not in rest.columns:
            found[length] = np.empty(0, np.uint64)
            return found
        counts = (rest.select("size", F.col(f"h{was}").alias("was"), F.col(f"h{length}").alias("h")).filter("h IS NOT NULL")
                  .join(heavy, "was").groupBy("h").agg(*weighed))


def adaptive_prefix(text: bytes, crowded: dict[int, np.ndarray]) -> bytes:
    """The text's shortest prefix, of the tried lengths, that is not crowded."""
    length = PREFIX
    while length < len(text) and len(hashes := crowded.get(length, ())):
        h = np.uint64(xxhash.xxh64_intdigest(text[:length], 42))
        if hashes[min(np.searchsorted(hashes, h), len(hashes) - 1)] != h:
            break
        length *= GROWTH
    return text[:length]


_OUT = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()),
                  ("prefix", pa.binary()), ("text", pa.binary())])


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def _settle(open_: dict[tuple, list], crowded) -> Iterator[pa.RecordBatch]:
    """Rows of some texts: a row that is larger than another of its text here
    is a duplicate whatever other tasks hold; the rest go on with their text,
    rows that repeat id, text and part as one."""
    keys = list(open_)
    lows = smallest_ids([k[0] for k in keys], [k[1] for k in keys])
    out, size = [], 0
    for (text, row_id, part), low in zip(keys, lows, strict=True):
        mask, n = open_[text, row_id, part]
        if row_id > low:
            out.append((row_id, part, mask | DUPLICATE, n, None, None))
        else:
            out.append((row_id, part, mask, n, adaptive_prefix(text, crowded), text))
            size += len(text)
        if size > 4 << 20 or len(out) == 20_000:
            yield _record(out)
            out, size = [], 0
    if out:
        yield _record(out)


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                 crowded_bytes: int = CROWDED) -> DataFrame:
    """``doc_id, part, mask, n`` of every whole text: the filters it fails as
    bits (A is 1, E is 16) and how many rows repeat id, part and mask.

    Tasks first settle copies among their own rows (32 MB of texts at a time),
    so of a hot text each task passes on one row. The others are stored, dealt
    by ranges of their adaptive prefix and put into tries, one for at most
    32 MB of texts or for one prefix; a task that is lost reads its range
    again.

    Null or empty text: an empty text (filter A). Null part: the empty string.
    A row without an id is never a duplicate and makes none. Rows that repeat
    id and text are no duplicates of each other. An empty table: no rows.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"),
                       F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    crowded = crowded_prefixes(base, crowded_bytes)
    heavy = base.sparkSession.sparkContext.broadcast(crowded)  # at most 2^20 hashes a length

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, list] = {}
        loose, size = [], 0
        for batch in batches:
            for rows in _slices(batch):
                for row_id, text, part in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                    raw = (text or "").encode()
                    if row_id is None:
                        loose.append((None, part, text_mask(text or "", raw), 1, None, None))
                        continue
                    seen = open_.get((raw, row_id, part))
                    if seen is None:
                        open_[raw, row_id, part] = [text_mask(text or "", raw), 1]
                        size += len(raw) + 200
                    else:
                        seen[1] += 1
                if loose:
                    yield _record(loose)
                    loose = []
                if size > TRIE_BYTES:
                    yield from _settle(open_, heavy.value)
                    open_, size = {}, 0
        yield from _settle(open_, heavy.value)

    judged = stored(base.mapInArrow(judge, "doc_id long, part string, mask int, n long, prefix binary, text binary"), "judged")
    waiting = judged.filter("text IS NOT NULL")
    total = waiting.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, total // TRIE_BYTES + 1)  # larger ranges only hold more tries, one after another

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept)
            ids, masks = (t.column(c).to_numpy() for c in ("doc_id", "mask"))
            lows = np.array(smallest_ids(t.column("text").to_pylist(), ids.tolist()), np.int64)
            t = t.set_column(2, "mask", pa.array(np.where(ids > lows, masks | DUPLICATE, masks), pa.int32()))
            return t.select(["doc_id", "part", "mask", "n"]).combine_chunks().to_batches()[0]

        size, last = 0, None
        for batch in batches:
            prefixes = batch.column("prefix").to_pylist()
            sizes = np.diff(np.r_[0, np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy())])
            at = 0
            for i, prefix in enumerate(prefixes):
                if prefix != last and size > TRIE_BYTES:
                    kept.append(batch.slice(at, i - at))
                    yield solve()
                    kept, size, at = [], 0, i
                size, last = size + int(sizes[i]) + 200, prefix
            kept.append(batch.slice(at))
        if sum(b.num_rows for b in kept):
            yield solve()

    flagged = (waiting.repartitionByRange(ranges, "prefix").sortWithinPartitions("prefix")
               .mapInArrow(flag, "doc_id long, part string, mask int, n long"))
    return flagged.unionByName(judged.filter("text IS NULL").select("doc_id", "part", "mask", "n"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and mask, and those
    labelled as of quality and as toxic (a document with several labels counts
    if any says so; labels without an id count for none)."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    found = masks.join(marks, "doc_id", "left")
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def order_figures(counts: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, from the counts
    of masks: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. What a step does depends only on the set of filters before it, so
    80 pairs of set and filter are computed and dealt to the 600 steps."""
    orders = []
    for order in permutations(range(len(FILTERS))):
        prior = 0
        for step, f in enumerate(order):
            orders.append(("".join(FILTERS[i] for i in order), step + 1, prior, 1 << f))
            prior |= 1 << f
    pairs = sorted({o[2:] for o in orders})
    steps = counts.sparkSession.createDataFrame(orders, "filter_order string, step int, prior int, bit int")
    each = F.struct("mask", "n", "good", "toxic")
    per = counts.groupBy("part").agg(F.collect_list(each).alias("masks"))  # 32 at most
    per = per.withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("prior"), F.lit(b).alias("bit")) for a, b in pairs])))
    per = per.select("part", "masks", "p.prior", "p.bit")

    def total(field: str, test) -> F.Column:
        some = F.filter("masks", lambda m: test(m["mask"]))
        return F.aggregate(some, F.lit(0).cast("long"), lambda a, m: a + m[field])

    bit, prior = F.col("bit"), F.col("prior")
    fails = lambda m: m.bitwiseAND(bit) != 0
    clean = lambda m: m.bitwiseAND(prior) == 0
    here = lambda m: fails(m) & clean(m)
    share = F.aggregate(F.filter("masks", lambda m: fails(m["mask"])), F.lit(0).cast("long"),
                        lambda a, m: a + m["n"] * F.floor(F.lit(120) / F.bit_count(m["mask"])))
    figures = per.select(
        "part", "prior", "bit",
        total("n", lambda m: m.bitwiseAND(prior.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & ~clean(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # of the 120 orders, a mask's filter comes first among its k filters in 120 / k
        share.cast("long").alias("shapley"))
    return figures.join(F.broadcast(steps), ["prior", "bit"]).select(  # 600 rows, whatever the input
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Figures of every order and step per part (see ``order_figures``) over
    the whole table; rows, nulls and repeats as in ``filter_masks``. An empty
    table has no part and gives no rows; with empty labels nothing is lost."""
    return order_figures(mask_counts(filter_masks(docs, **params), labels))
