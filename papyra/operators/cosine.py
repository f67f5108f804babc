"""Groups of equivalent names by the cosine of their embeddings.

Vectors get one code per band, the signs of their projections on random
directions. Rows of a group that share a band's code meet in a bucket; there
every row is compared with the bucket's leader (its smallest id), those that
match go to it, the others choose a leader again. A round is one aggregate and
one equi-join, so no bucket gives all its pairs and a crowded one is split by
AQE. Pairs are first judged on vectors of one byte a dimension with their
rounding error, which rules out nearly all without a doubt; only the others
fetch the whole vectors. What was matched is a forest of verified edges; its components, by
alternating large and small stars, are a first grouping.

That first pass is a head start and leaves links out: a pair may share no
bucket, a matched row leaves its bucket, and a crowded bucket has more leaders
than rounds. So every pair of a group whose rows are still apart is then
compared (``rest_edges``): the rows of a group, in chunks of which every two
meet, by matrix products; rows of one component meet in no product of their own
and give no rows. The components of both passes together are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .containment import merged

SEED = 20
# Rows of a chunk at least and at most, its numbers at most; pairs of chunks that the largest group is cut into before chunks grow.
CHUNK_ROWS, CHUNK_NUMBERS, CHUNK_PAIRS = (1024, 32_768), 1 << 23, 100
# Rows of one product of vectors; numbers in one array of pairs.
TILE, PAIR_NUMBERS = 1024, 1 << 20


def bands_needed(threshold: float, bits: int, recall: float) -> int:
    """Bands of ``bits`` signs with which two vectors at the threshold share a
    code with probability ``recall``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def cosine(u: Column, v: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))


def byte_vectors(rows: DataFrame) -> DataFrame:
    """``_id, _q`` for rows (_id, _v) whose vector has a direction: one byte a
    dimension (``q``), its step ``s`` and its error ``e``; the unit vector is
    within ``e`` of ``s * q``. Vectors so long or short that their squares may
    leave the range of doubles have an infinite error."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).astype(int):
                at = pa.array(np.flatnonzero(sizes == dim))
                x = batch.column(1).take(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                most = np.abs(x).max(axis=1, keepdims=True)
                q = np.rint(x / most * 127).astype(np.int8)
                with np.errstate(all="ignore"):
                    squares = (x * x).sum(axis=1, keepdims=True)
                    plain = (squares > 1e-120) & (squares < 1e120)
                    norm = np.sqrt(squares)
                    step = np.where(plain, most / 127 / norm, 0.0)
                    error = np.where(plain, np.sqrt(((x / norm - q * step) ** 2).sum(axis=1, keepdims=True)), np.inf)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.ListArray.from_arrays(ends, pa.array(q.reshape(-1))),
                                                  pa.array(step[:, 0]), pa.array(error[:, 0])], ["_id", "q", "s", "e"])

    return (rows.select("_id", "_v").mapInArrow(short, "_id long, q array<tinyint>, s double, e double")
            .select("_id", F.struct("q", "s", "e").alias("_q")))


def may_reach(u: Column, v: Column, threshold: float) -> Column:
    """Whether two vectors of ``byte_vectors`` can have a cosine of ``threshold``.
    Never false for a pair that has; false for different dimensions."""
    dot = F.aggregate(F.zip_with(u["q"], v["q"], lambda x, y: x.cast("bigint") * y), F.lit(0).cast("bigint"), lambda t, x: t + x)
    error = u["e"] + v["e"] + u["e"] * v["e"] + 1e-9
    return F.coalesce(dot * u["s"] * v["s"] + error >= threshold, F.lit(False))


def band_codes(rows: DataFrame, bits: int, bands: int) -> DataFrame:
    """``_id, _g, bucket`` (band and code) for rows (_id, _g, _v) whose vector
    has a direction."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).astype(int):
                at = pa.array(np.flatnonzero(sizes == dim))
                x = batch.column(2).take(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED).standard_normal((dim, bands * bits))
                signs = (x @ planes[dim] > 0).reshape(len(x), bands, bits)
                ids, groups = (np.repeat(batch.column(k).take(at).to_numpy(), bands) for k in (0, 1))
                bucket = (signs @ weights).reshape(-1) + (np.tile(np.arange(bands, dtype=np.int64), len(x)) << bits)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(groups), pa.array(bucket)], ["_id", "_g", "bucket"])

    return rows.select("_id", F.col("_g").cast("bigint"), "_v").mapInArrow(code, "_id long, _g long, bucket long")


def star_edges(rows: DataFrame, threshold: float, bits: int, bands: int, rounds: int) -> DataFrame:
    """Verified edges ``a, b`` (b < a) between rows (_id, _g, _v): in each
    bucket, rows to their leader, ``rounds`` times. Not all links: ``rest_edges``
    has the others, and those of vectors whose squares leave the doubles."""
    left = band_codes(rows, bits, bands)
    vec = rows.select("_id", "_v")
    short = byte_vectors(rows).filter(F.col("_q.e") < float("inf"))
    key, edges = ["_g", "bucket"], None

    def to_leader(side: DataFrame, of: str) -> DataFrame:
        return side.select(F.col("_id").alias("b"), F.col(of).alias("_w"))

    for _ in range(rounds):
        leaders = left.groupBy(*key).agg(F.min("_id").alias("b"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        met = cut_lineage(left.join(merged(leaders), key).filter("_id <> b"))
        pairs = met.select("_id", "b").distinct()
        close = (pairs.join(short, "_id").join(to_leader(short, "_q"), "b")
                 .filter(may_reach(F.col("_q"), F.col("_w"), threshold)).select("_id", "b"))
        found = cut_lineage(close.join(vec, "_id").join(to_leader(vec, "_v"), "b")
                            .filter(cosine(F.col("_v"), F.col("_w")) >= threshold).select("_id", "b"))
        edges = found if edges is None else edges.unionByName(found)
        left = met.join(found, ["_id", "b"], "left_anti").select("_id", *key)
        if not met.limit(1).count():
            break
    return edges.select(F.col("_id").alias("a"), "b").distinct()


def units(x: np.ndarray) -> np.ndarray:
    """The vectors' directions in single precision."""
    out = np.empty(x.shape, np.float32)
    for at in range(0, len(x), TILE):
        u = x[at:at + TILE].astype(float)
        u /= np.abs(u).max(axis=1, keepdims=True)
        out[at:at + TILE] = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    return out


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``cosine`` of the rows of two matrices, summed in the same order. They
    are scaled by powers of two first: no square leaves the range of doubles,
    and where none did, no bit changes."""
    u, v = (np.ldexp(w.astype(float), -np.frexp(np.abs(w).max(axis=1, keepdims=True))[1]) for w in (u, v))
    uv, uu, vv = np.zeros((3, len(u)))
    for k in range(u.shape[1]):
        uv += u[:, k] * v[:, k]
        uu += u[:, k] * u[:, k]
        vv += v[:, k] * v[:, k]
    return uv / np.sqrt(uu * vv)


def united(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``top`` (each label's smallest joined label) after joining a with b."""
    while True:
        a, b = top[a], top[b]
        apart = a != b
        if not apart.any():
            return top
        a, b = a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]


def joined(x: np.ndarray, label: np.ndarray, split: int, threshold: float) -> np.ndarray:
    """The smallest label that each label is joined with by links of rows of
    unlike labels: rows before ``split`` against those from it on, or all
    against all if it is 0. Rows with one label best stand together."""
    top = np.arange(label.max() + 1, dtype=np.int32)
    unit, band = units(x), (x.shape[1] + 8) * 2.0 ** -23  # more than single precision can be off
    for i in range(0, split or len(x), TILE):
        one = slice(i, min(i + TILE, split or len(x)))
        for j in range(split or i, len(x), TILE):
            two = slice(j, j + TILE)
            a, b = top[label[one]], top[label[two]]
            if a[0] == b[0] and (a == a[0]).all() and (b == a[0]).all():
                continue
            product = unit[one] @ unit[two].T
            near = product >= threshold - band
            if not near.any():
                continue
            near &= a[:, None] != b[None, :]
            hits = np.flatnonzero(near)
            row, col = np.divmod(hits, near.shape[1])
            sure = product.reshape(-1)[hits] >= threshold + band
            top = united(top, a[row[sure]], b[col[sure]])
            row, col = row[~sure], col[~sure]
            step = max(1, PAIR_NUMBERS // x.shape[1])
            for k in range(0, len(row), step):
                r, c = row[k:k + step], col[k:k + step]
                apart = top[a[r]] != top[b[c]]
                r, c = r[apart], c[apart]
                link = cosines(x[one][r], x[two][c]) >= threshold
                top = united(top, a[r[link]], b[c[link]])
    return top


def chunk_pairs(rows: DataFrame, counts: DataFrame, most: Column) -> DataFrame:
    """Rows (_id, _g, dim, root, _v) once for each pair of chunks (lo, hi) of
    their group that they take part in; ``low``: on the side of lo. ``counts``
    has the number n of rows by (_g, dim, root). A group of up to ``most`` rows is one chunk. A root with more than half of that in a
    larger group has chunks of its own, which do not meet one another; the
    others are dealt by their root. The table of chunks has a row for a large
    group and for half a chunk of rows at most, so it is broadcast."""
    group = ["_g", "dim"]
    large = counts.groupBy(*group).agg(F.sum("n").alias("rows")).withColumn("most", most).filter("rows > most")
    own = (counts.join(large, group).filter(F.col("n") * 2 > F.col("most"))
           .select(*group, "root", "n", F.ceil(F.col("n") / F.col("most")).alias("parts")))
    held = own.groupBy(*group).agg(F.sum("n").alias("own_rows"), F.collect_list(F.struct("root", "parts")).alias("owners"))
    chunk = F.struct(F.col("x.root").alias("own"), F.col("part").alias("part"))
    mixed = F.ceil((F.col("rows") - F.coalesce("own_rows", F.lit(0))) / F.col("most"))
    plan = large.join(held, group, "left").withColumn("mixed", mixed)
    none = F.struct(F.lit(-1).cast("bigint").alias("root"), F.col("mixed").alias("parts"))
    listed = (plan.withColumn("x", F.explode(F.concat(F.coalesce("owners", F.array().cast("array<struct<root:bigint,parts:bigint>>")), F.array(none))))
              .filter("x.parts > 0").withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("x.parts")))))
    chunks = cut_lineage(listed.groupBy(*group, "mixed").agg(F.sort_array(F.collect_list(chunk)).alias("chunks")))
    own = cut_lineage(own.select(*group, "root", "parts"))

    dealt = rows.join(F.broadcast(own), [*group, "root"], "left").join(F.broadcast(chunks), group, "left")
    mine = (F.when(F.col("parts").isNotNull(), F.struct(F.col("root").alias("own"), (F.pmod(F.xxhash64("_id"), "parts") + 1).alias("part")))
            .otherwise(F.struct(F.lit(-1).cast("bigint").alias("own"), (F.pmod(F.xxhash64("root"), F.greatest("mixed", F.lit(1).cast("bigint"))) + 1).alias("part"))))
    meets = F.filter(F.col("chunks"), lambda c: (c["own"] == -1) | (c["own"] != F.col("mine.own")))
    whole = F.array(F.struct(F.lit(-1).cast("bigint").alias("own"), F.lit(1).cast("bigint").alias("part")))
    dealt = (dealt.withColumn("mine", F.when(F.col("chunks").isNull(), whole[0]).otherwise(mine))
             .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), whole).otherwise(meets))))
    return dealt.select(*group, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                        (F.col("mine") <= F.col("other")).alias("low"), "root", "_v")


def rest_edges(rows: DataFrame, roots: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """Edges ``a, b`` (b < a) between the components ``roots`` (node, root) of
    rows (_id, _g, _v), a row of no component being its own: a forest from each
    comparison, which with the components joins all rows of a group that links
    join. Every pair of unlike components is compared, however they lie.

    ``most`` rows a chunk; if None, as many as leave the largest group in a
    hundred pairs of chunks, within fixed bounds."""
    rows = (rows.join(roots.withColumnRenamed("node", "_id"), "_id", "left")
            .select("_id", "_g", F.size("_v").alias("dim"), F.coalesce("root", "_id").alias("root"), "_v"))
    counts = cut_lineage(rows.groupBy("_g", "dim", "root").agg(F.count(F.lit(1)).alias("n")))
    pairs = counts.groupBy("_g", "dim").agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0.0
    least, limit = CHUNK_ROWS
    few = min(limit, max(least, math.ceil(math.sqrt(pairs / CHUNK_PAIRS)))) if most is None else most
    at_most = F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(few).cast("bigint"), F.floor(F.lit(CHUNK_NUMBERS) / F.col("dim"))))
    key = ["_g", "dim", "lo", "hi"]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, math.ceil(pairs / limit ** 2)))
    dealt = chunk_pairs(rows, counts, at_most).repartition(tasks, *key).sortWithinPartitions(*key, F.desc("low"), "root")
    dealt = dealt.select("_g", "dim", "lo.own", "lo.part", F.col("hi.own").alias("own2"), F.col("hi.part").alias("part2"), "low", "root", "_v")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def solve() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(kept)
            names, label = np.unique(table.column("root").to_numpy(), return_inverse=True)
            if len(names) > 1:
                x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("_v").chunks]).reshape(len(label), -1)
                own = all(table.column(c)[0] == table.column(f"{c}2")[0] for c in ("own", "part"))
                split = 0 if own else int(table.column("low").to_numpy().sum())
                if own or 0 < split < len(x):
                    top = joined(x, label, split, threshold)
                    moved = np.flatnonzero(top != np.arange(len(top)))
                    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[top[moved]])], ["a", "b"])

        keyed = ["_g", "dim", "own", "part", "own2", "part2"]
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keyed]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, b in zip(np.r_[0, new].tolist(), np.r_[new, batch.num_rows].tolist(), strict=True):
                here = tuple(c[a].item() for c in cols)
                if kept and here != last:
                    yield from solve()
                    kept = []
                last = here
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from solve()

    return dealt.mapInArrow(edges, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (a, b): root is the smallest
    node that a path reaches. Large stars (every larger neighbour to the
    smallest) and small stars (every smaller one) alternate until nothing
    moves; both are one partial minimum and one equi-join."""
    rest = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = print_of(rest)
    while was[0]:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        rest = cut_lineage(small)
        now = print_of(rest)
        if now == was:
            break
        was = now
    roots = rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def homologate_by_embedding(names: DataFrame, threshold: float = 0.9, name_col: str = "name", vec_col: str = "embedding",
                            count_col: str = "n", group_cols: Sequence[str] = ("user_id",), recall: float = 0.9999,
                            rounds: int = 3) -> DataFrame:
    """J4, cosine form: (group_cols..., variant, canonical, n) with every name
    once. Names of a group whose vectors have a cosine of ``threshold`` or
    more, directly or through others, have one canonical: the most frequent
    spelling, then the shortest, then the first in the alphabet.

    ``names`` has one row per name of a group with its count. All links count:
    a first pass finds most of those of close vectors (a pair at the threshold
    shares a bucket with probability ``recall``, from which the number of bands
    follows; that of the signs follows from the largest group), a second one
    compares all pairs that it left apart. A vector that is null, empty, zero or
    not finite leaves its name a group of its own."""
    gc = list(group_cols)
    kind = names.select(vec_col).schema[0].dataType.simpleString()
    rows = cut_lineage(names.select(*gc, F.col(name_col).alias("variant"), F.col(count_col).alias("n"),
                                    F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("_v"))
                       .withColumn("_id", F.monotonically_increasing_id()).withColumn("_g", F.xxhash64(*gc) if gc else F.lit(0).cast("bigint")))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.filter(F.coalesce(finite & F.exists("_v", lambda x: x != 0), F.lit(False))).select("_id", "_g", "_v")
    largest = some.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    bits = min(24, max(4, math.ceil(math.log2(largest))))  # about a row a bucket, copies aside
    vectors = some.withColumn("_v", F.col("_v").cast("array<double>"))
    first = connected(star_edges(vectors, threshold, bits, bands_needed(threshold, bits, recall), rounds))
    rest = connected(rest_edges(some, first, threshold)).select(F.col("node").alias("_mid"), F.col("root").alias("_low"))
    held = (rows.select(*gc, "variant", "n", "_id").join(first, F.col("_id") == F.col("node"), "left").withColumn("_mid", F.coalesce("root", "_id"))
            .join(rest, "_mid", "left").withColumn("_root", F.coalesce("_low", "_mid")))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.length("variant").alias("len"), F.col("variant").alias("v"))).alias("_c")
    canon = held.groupBy("_root").agg(best)
    return held.join(canon, "_root").select(*gc, "variant", F.col("_c.v").alias("canonical"), "n")
