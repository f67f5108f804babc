"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine ``t`` or more are at most R = sqrt(2 - 2 t) apart. They
are rotated by one random rotation and split into blocks of few dimensions; of
two vectors within R, at least one block is within its share of the squared
distance (in proportion to its dimensions). Each block is range-joined: rows
go to the grid cells that a ball of half the block's radius reaches, so the
cell of a pair's midpoint holds both. The union of the candidates is verified
where it arises.

What is shuffled per block is the rotated vector rounded to a byte a dimension
with its rounding error. Distances between rounded vectors are exact in double
precision, so all tasks agree on the one place where a pair counts: its first
block within the share, the cell of its midpoint there. The error bound
decides nearly every pair; the others are verified on the original vectors.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components, join_labels

BLOCK_DIMS = 8
# Rows of a label that are compared without a grid, and rows of one chunk of a
# crowded cell; width of a cell in radii of the block.
CELL_ROWS, CELL_WIDTH = 16_384, 1.75
# Rows and columns of one array of distances; numbers in one array of pairs.
TILE, PAIRS = 1024, 1 << 21
SLACK = 1e-9


@functools.lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(64).standard_normal((dim, dim)))[0]


def cuts(dim: int) -> np.ndarray:
    """Begins of the blocks, and the end."""
    n = max(1, round(dim / BLOCK_DIMS))
    return np.array([dim * k // n for k in range(n + 1)])


def radii(dim: int, reach: float) -> np.ndarray:
    """Each block's share of a distance: squares in proportion to dimensions."""
    return reach * np.sqrt(np.diff(cuts(dim)) / dim) * (1 + SLACK)


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors as bytes q and shifts s (coordinate: q / 2^s), with
    a bound of the distance that rounding moved them."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    x = units @ rotation(vectors.shape[1])
    shift = np.floor(np.log2(127 / np.abs(x).max(axis=1))).astype(np.int8)
    q = np.rint(np.ldexp(x, shift[:, None])).astype(np.int8)
    error = np.linalg.norm(x - np.ldexp(q.astype(np.float64), -shift[:, None]), axis=1) + SLACK
    return q, shift, error


def depth(rows: int, dims: int, cell_rows: int) -> int:
    """Dimensions of a block that its grid uses: a cell spans about a third of
    a dimension's spread."""
    return min(dims, 8, max(0, math.ceil(math.log(max(1, rows / cell_rows), 3))))


def cell_of(x: np.ndarray, width: float) -> np.ndarray:
    """Place of a coordinate on a grid, as one byte."""
    return np.clip(np.floor(x / width), -128, 127).astype(np.int64) + 128


def cells(x: np.ndarray, radius: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for all cells that the balls of half the radius around the
    rows reach, on a grid over the first ``dims`` dimensions."""
    row, key, width = np.arange(len(x)), np.zeros(len(x), np.int64), radius * CELL_WIDTH
    for d in range(dims):
        low, high = cell_of(x[row, d] - radius / 2, width), cell_of(x[row, d] + radius / 2, width)
        more = high > low
        row, key = np.r_[row, row[more]], np.r_[key << 8 | low, key[more] << 8 | high[more]]
    return row, key


def _matrix(col: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(col), -1)


def _described(vectors: DataFrame, with_vector: bool) -> DataFrame:
    """``vec_id, label, key`` (and ``vec``): key is a 128-bit digest of the
    vector, null where it cannot link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for label, vec in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                key = None
                if label is not None and vec.is_valid and vec.values is not None and not vec.values.null_count:
                    v = vec.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 is 0.0
                    if len(v) and np.isfinite(v).all() and (size := np.linalg.norm(v)) > 0 and np.isfinite(size):
                        key = hashlib.md5(v.tobytes(), usedforsecurity=False).digest()
                keys.append(key)
            cols = [batch.column(0), batch.column(1), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(2)] * with_vector, ["vec_id", "label", "key", "vec"][:3 + with_vector])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema[:2]) + ", key binary"
    return vectors.mapInArrow(rows, schema + f", vec {vectors.schema['vec'].dataType.simpleString()}" * with_vector)


def _spread(classes: DataFrame, reach: float, cell_rows: int, payload: bool) -> DataFrame:
    """A row per class, block and cell it reaches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "block", "cell", "node", "copies", "shift", "error", "q"]
        for batch in batches:
            dims, sizes = batch.column("dim").to_numpy(), batch.column("rows").to_numpy()
            for dim, n in sorted(set(zip(dims.tolist(), sizes.tolist(), strict=True))):
                part = batch.take(pa.array(np.flatnonzero((dims == dim) & (sizes == n))))
                q, shift, error = rounded(_matrix(part.column("vec")))
                at, radius = cuts(dim), radii(dim, reach)
                x = np.ldexp(q.astype(np.float64), -shift[:, None])
                for b in range(len(radius)):
                    row, key = cells(x[:, at[b]:at[b + 1]], radius[b], depth(n, at[b + 1] - at[b], cell_rows))
                    take = pa.array(row)
                    cols = [part.column("label").take(take), part.column("dim").take(take), pa.array(np.full(len(row), b, np.int32)), pa.array(key)]
                    if payload:
                        whole = pa.array([v.tobytes() for v in q], pa.binary())
                        cols += [part.column("node").take(take), part.column("copies").take(take), pa.array(shift[row]),
                                 pa.array(error[row]), whole.take(take)]
                    yield pa.RecordBatch.from_arrays(cols, names[:len(cols)])

    schema = f"label {classes.schema['label'].dataType.simpleString()}, dim int, block int, cell long"
    return classes.mapInArrow(rows, schema + ", node long, copies long, shift tinyint, error double, q binary" * payload)


def compare(dim: int, block: int, cell: int, grid_dims: int, q: np.ndarray, shift: np.ndarray, error: np.ndarray, copies: np.ndarray,
            side: np.ndarray | None, far: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of one cell against each other, or, with ``side``, those of
    one side against the other's: copies linked to each row, a label for each
    row (rows with one label are joined by links), and pairs of rows that the
    rounded vectors cannot decide. Only pairs whose place this is count."""
    at, radius = cuts(dim), radii(dim, reach)
    spans = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
    x = lambda rows, span=slice(None): np.ldexp(q[rows, span].astype(np.float64), -shift[rows, None])
    width, r = radius[block] * CELL_WIDTH, radius[block]
    by = x(slice(None), spans[block])[:, min(grid_dims, at[block + 1] - at[block] - 1)]
    one = np.argsort(by, kind="stable") if side is None else (o := np.argsort(by, kind="stable"))[side[o]]
    two = one if side is None else o[~side[o]]
    weight, label, open_ = np.zeros(len(q), np.int64), np.arange(len(q)), [np.empty((2, 0), np.int64)]

    def near(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        u, v = x(a, spans[k]), x(b, spans[k])
        return (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T) <= radius[k] ** 2

    def judge(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        square = (x(a) - x(b)) ** 2
        shares = np.add.reduceat(square, at[:-1], axis=1)
        ok = (shares <= radius ** 2).argmax(axis=1) == block
        if grid_dims:
            key = np.zeros(len(a), np.int64)
            for d in range(at[block], at[block] + grid_dims):
                key = key << 8 | cell_of((x(a, slice(d, d + 1)) + x(b, slice(d, d + 1)))[:, 0] / 2, width)
            ok &= key == cell
        a, b, distance = a[ok], b[ok], np.sqrt(shares[ok].sum(axis=1))
        doubt = error[a] + error[b] + SLACK
        sure = distance <= far - doubt
        np.add.at(weight, a[sure], copies[b[sure]])
        np.add.at(weight, b[sure], copies[a[sure]])
        label = join_labels(len(q), a[sure], b[sure], label)
        unsure = ~sure & (distance <= far + doubt)
        open_.append(np.stack([a[unsure], b[unsure]]))

    sorted_two = by[two]
    for begin in range(0, len(one), TILE):
        a = one[begin:begin + TILE]
        first = begin if side is None else np.searchsorted(sorted_two, by[a[0]] - r)
        last = np.searchsorted(sorted_two, by[a[-1]] + r, side="right")
        for start in range(first, last, 4 * TILE):
            b = two[start:min(last, start + 4 * TILE)]
            hits = near(a, b, block)
            if side is None:
                hits &= np.arange(start, start + len(b))[None, :] > np.arange(begin, begin + len(a))[:, None]
            for k in range(block):  # many candidates are rather an earlier block's
                if hits.mean() < 0.02:
                    break
                hits &= ~near(a, b, k)
            i, j = np.nonzero(hits)
            step = max(1, PAIRS // dim)
            for p in range(0, len(i), step):
                judge(a[i[p:p + step]], b[j[p:p + step]])
    return weight, label, np.concatenate(open_, axis=1)


def _compared(dealt: DataFrame, far: float, reach: float, cell_rows: int) -> DataFrame:
    """``a, b, n``: n copies linked to class a (b null), an edge of a forest
    of links (n 0), or a pair to verify (n -1)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        key = None

        def solve() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks()
            col = lambda c: t.column(c).to_numpy()
            dim, block, cell = key[1:4]
            n, lo, hi = (int(t.column(c)[0].as_py()) for c in ("rows", "lo", "hi"))
            node = col("node")
            q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(len(node), dim)
            at = cuts(dim)
            weight, label, doubt = compare(dim, block, cell, depth(n, at[block + 1] - at[block], cell_rows), q, col("shift"), col("error"),
                                           col("copies"), None if lo == hi else col("mine") == lo, far, reach)
            some, joined = np.flatnonzero(weight), np.flatnonzero(label != np.arange(len(label)))
            a = np.r_[node[some], node[joined], node[doubt[0]]]
            b = np.r_[np.zeros(len(some), np.int64), node[label[joined]], node[doubt[1]]]
            kind = np.r_[weight[some], np.zeros(len(joined), np.int64), np.full(doubt.shape[1], -1)]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(some)), pa.array(kind)], ["a", "b", "n"])

        names = ["label", "dim", "block", "cell", "lo", "hi"]
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            new = np.flatnonzero(np.r_[False, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            for a, b in zip(np.r_[0, new].tolist(), np.r_[new, batch.num_rows].tolist(), strict=True):
                here = tuple(c[a].item() if hasattr(c[a], "item") else c[a] for c in cols)
                if kept and here != key:
                    if sum(x.num_rows for x in kept) > 1:
                        yield solve()
                    kept = []
                key = here
                kept.append(batch.slice(a, b - a))
        if sum(x.num_rows for x in kept) > 1:
            yield solve()

    return dealt.mapInArrow(rows, "a long, b long, n long")


def _deal(classes: DataFrame, reach: float, cell_rows: int) -> DataFrame:
    """Cells dealt out, each whole in one task; a cell of more than
    ``cell_rows`` rows is cut into chunks of which every two meet."""
    sizes = classes.select("label", "dim", "rows").distinct()
    spread = _spread(classes, reach, cell_rows, True).join(sizes, ["label", "dim"])
    counts = (_spread(classes.filter(F.col("rows") > cell_rows), reach, cell_rows, False)
              .groupBy("label", "dim", "block", "cell").agg(F.count("*").alias("held")).filter(F.col("held") > cell_rows))
    crowded = stored(counts.withColumn("chunks", F.ceil(F.col("held") / cell_rows).cast("long")).drop("held"), "crowded")
    zero = F.lit(0).cast("long")
    if crowded.limit(1).count():
        spread = (spread.join(crowded, ["label", "dim", "block", "cell"], "left")
                  .withColumn("mine", F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), zero))
                  .withColumn("other", F.explode(F.sequence(zero, F.coalesce(F.col("chunks") - 1, zero)))))
    else:
        spread = spread.withColumns({"mine": zero, "other": zero})
    key = ["label", "dim", "block", "cell", "lo", "hi"]
    spread = spread.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    return spread.drop("other", "chunks").repartition(*key).sortWithinPartitions(*key)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per input row: the other rows
    of its label with a cosine of ``threshold`` or more, the smallest id that
    a chain of such links reaches, and whether that is its own.

    Equal vectors of a label are one class, whatever their number, and come
    back by an equi-join whose hot keys AQE splits. Of the classes' pairs none
    leaves a task but those the rounded vectors cannot decide (a few in a
    thousand around the threshold); tasks give counts per class and a forest
    of links. A cell that too many rows reach is compared in chunks by many
    tasks: exact, at a cost that is quadratic in the cell.

    Vectors that are null, empty or zero, or hold null or non-finite numbers,
    and rows without a label link with nothing: no links, their own component.
    Vectors of different lengths have no cosine and do not link. Rows that
    repeat an id count each other like any others; rows without an id take
    part but name a component only if it has no other id (null). An empty
    table gives no rows.
    """
    far = math.sqrt(max(0.0, 2 - 2 * threshold))
    base = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vec_col].alias("vec"))
    members = stored(_described(base, False), "members")
    classes = (_described(base, True).filter("key IS NOT NULL").groupBy("label", "key")
               .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "classes")
    sized = classes.join(classes.groupBy("label", "dim").agg(F.count("*").alias("rows")), ["label", "dim"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vec = batch.column(0).to_numpy(), batch.column(1)
            for dim in np.unique(dims):
                most = rounded(_matrix(vec.take(pa.array(np.flatnonzero(dims == dim)))))[2].max()
                yield pa.RecordBatch.from_arrays([pa.array([most])], ["error"])

    moved = classes.select("dim", "vec").mapInArrow(errors, "error double").agg(F.max("error")).first()[0] or 0.0
    reach = far + 2 * moved + SLACK
    found = stored(_compared(_deal(sized.select("label", "dim", "rows", "node", "copies", "vec"), reach, cell_rows), far, reach, cell_rows), "compared")

    doubt = found.filter("n = -1").select("a", "b")
    if doubt.limit(1).count():
        one = classes.select(F.col("node").alias("a"), F.col("vec").cast("array<double>").alias("u"), F.col("copies").alias("a_copies"))
        two = classes.select(F.col("node").alias("b"), F.col("vec").cast("array<double>").alias("v"), F.col("copies").alias("b_copies"))
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        # scaled by the largest number first, so no square overflows or vanishes
        scale = lambda v: F.transform(v, lambda s: s / F.array_max(F.transform(v, F.abs)))
        pairs = doubt.join(one, "a").join(two, "b").withColumns({"u": scale("u"), "v": scale("v")})
        sure = stored(pairs.filter(dot("u", "v") / F.sqrt(dot("u", "u") * dot("v", "v")) >= threshold)
                      .select("a", "b", "a_copies", "b_copies"), "verified")
        edges = found.filter("n = 0").select("a", "b").unionByName(sure.select("a", "b"))
        counts = (found.filter("n > 0").select("a", "n").unionByName(sure.select("a", F.col("b_copies").alias("n")))
                  .unionByName(sure.select(F.col("b").alias("a"), F.col("a_copies").alias("n"))))
    else:
        edges, counts = found.filter("n = 0").select("a", "b"), found.filter("n > 0").select("a", "n")

    roots = components(edges).select(F.col("node"), "root")
    linked = counts.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    grouped = stored(classes.select("node", "label", "key", "first_id", "copies").join(roots, "node", "left").join(linked, "node", "left")
                     .select("label", "key", "first_id", F.coalesce("root", "node").alias("root"),
                             (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(smallest, "root").select("label", "key", "n_links", "component_id", F.lit(True).alias("links"))
    component = F.when(F.col("links"), F.col("component_id")).otherwise(F.col("vec_id"))
    return members.join(named, ["label", "key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"))
