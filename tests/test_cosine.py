"""J4 by cosine: components, recall against all pairs, canonical names, rows
that a crowded bucket gives."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from papyra.operators import cosine as CO

SCHEMA = "user_id long, name string, n long, embedding array<float>"


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _groups(rows, threshold):
    x = np.array([v for *_, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    user = np.array([u for u, *_ in rows])
    links = np.argwhere(np.triu((x @ x.T >= threshold) & (user[:, None] == user[None, :]), 1))
    return _components(len(rows), links.tolist()), len(links)


def test_connected_path_star_and_random(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(70)] + [(500, 500 + k) for k in range(60)] + [(9, 9)] \
        + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(120)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    want = _components(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    got = {r.node: r.root for r in CO.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: nodes[want[i]] for x, i in at.items()}
    assert CO.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_on_the_embeddings(spark):
    """Pairs of one group found, of all such pairs: 0.9 at least; no group
    that all pairs would not give."""
    rows = [(r.label, f"t{r.vec_id}", 1, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    for label, name, _, v in rows[::10]:  # near copies, around the threshold
        rows += [(label, f"{name}-{k}", 1, (np.array(v) + rng.normal(0, .03 + .01 * k, len(v))).tolist()) for k in range(4)]
    want, n_links = _groups(rows, 0.9)
    assert n_links > 300
    got = {r.variant: r.canonical for r in CO.homologate_by_embedding(spark.createDataFrame(rows, SCHEMA), 0.9).collect()}
    same = [(i, j) for g in set(want) if len(own := [k for k in range(len(rows)) if want[k] == g]) > 1 for a, i in enumerate(own) for j in own[a + 1:]]
    found = sum(got[rows[i][1]] == got[rows[j][1]] for i, j in same)
    assert len(same) >= n_links and found / len(same) >= 0.9
    root = {rows[i][1]: want[i] for i in range(len(rows))}
    assert all(root[v] == root[c] for v, c in got.items())


def test_hot_group_and_canonical(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(24)
    rows = [(1, f"hot{k:04d}", 1 + (k == 77), (centre + .03 * rng.standard_normal(24)).tolist()) for k in range(900)]
    rows += [(k % 3, f"far{k}", 1, rng.standard_normal(24).tolist()) for k in range(300)]
    rows += [(2, "bb", 5, [1.0] + [0.0] * 23), (2, "aaa", 5, [2.0] + [0.0] * 23), (2, "ab", 5, [3.0] + [0.0] * 23), (3, "bb", 1, [1.0] + [0.0] * 23)]
    odd = [(1, "null", 1, None), (1, "zero", 1, [0.0] * 24), (1, "nan", 1, [math.nan] * 24), (1, "short", 1, [1.0]), (1, "empty", 1, []), (None, "none", 1, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    want, _ = _groups(rows, 0.9)
    got = {(r.user_id, r.variant): r.canonical for r in CO.homologate_by_embedding(df, 0.9).collect()}
    assert len(got) == len(rows) + len(odd) and all(got[u, v] == v for u, v, *_ in odd)
    best = {}
    for (_, v, n, _), g in zip(rows, want, strict=True):
        best[g] = min(best.get(g, (0, 0, "")) if g in best else (-n, len(v), v), (-n, len(v), v))
    assert {(u, v): best[g][2] for (u, v, *_), g in zip(rows, want, strict=True)} == {k: c for k, c in got.items() if k in {(u, v) for u, v, *_ in rows}}
    # a bucket of n rows gives n - 1 comparisons a round, not all its pairs
    plain = df.filter("user_id = 1 AND name LIKE 'hot%'").withColumn("_id", F.monotonically_increasing_id())
    edges = CO.star_edges(plain.select("_id", F.lit(0).alias("_g"), F.col("embedding").cast("array<double>").alias("_v")), 0.9, 4, 3, 6)
    assert edges.count() < 3 * 6 * 900


def test_bytes_rule_out_no_pair_that_reaches(spark):
    """Pairs around the threshold, unlike sizes and extreme lengths: what the
    bytes rule out is below it, and far pairs are ruled out."""
    rng = np.random.default_rng(11)
    pairs = []
    for k in range(400):
        u = rng.standard_normal(24)
        v = u * rng.uniform(.1, 10) + rng.normal(0, .02 * (k % 60), 24)
        pairs.append((u.tolist(), (v * 10.0 ** rng.integers(-30, 30)).tolist()))
    pairs += [([1.0, 2.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([1e150, 1e150], [1e150, 1.1e150]), ([1e-140, 0.0], [1.0, 0.0]), ([0.0, 3.0], [0.0, 5.0])]
    sides = [spark.createDataFrame([(k, p[side]) for k, p in enumerate(pairs)], "_id long, _v array<double>") for side in (0, 1)]
    u, v = (df.join(CO.byte_vectors(df), "_id").select("_id", F.col("_v").alias(c), F.col("_q").alias(f"q{c}")) for df, c in zip(sides, "uv", strict=True))
    got = u.join(v, "_id").select(CO.may_reach(F.col("qu"), F.col("qv"), 0.9).alias("may"), "u", "v").collect()
    assert len(got) == len(pairs)
    far = 0
    for r in got:
        if len(r.u) != len(r.v):
            assert not r.may
            continue
        u, v = (np.array(x) / max(map(abs, x)) for x in (r.u, r.v))
        cos = u @ v / math.sqrt((u @ u) * (v @ v))
        assert r.may or cos < 0.9
        far += not r.may
        assert cos > 0.85 or not r.may
    assert far > 30


def test_a_row_ships_its_whole_vector_only_to_close_rows(spark):
    """Pairs are judged on bytes before whole vectors are joined, what is stored
    holds ids alone, and the exploded codes are not broadcast."""
    rng = np.random.default_rng(4)
    rows = [(k, 0, rng.standard_normal(256).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "_id long, _g long, _v array<double>").repartition(4).localCheckpoint()
    edges = CO.star_edges(df, 0.9, 6, 12, 1)
    assert edges.count() == 0
    plans = []
    cut = CO.cut_lineage

    def keep(frame):
        plans.append(frame)
        return cut(frame)

    CO.cut_lineage = keep
    try:
        CO.star_edges(df, 0.9, 6, 12, 1)
    finally:
        CO.cut_lineage = cut
    met, found = plans
    assert "_v" not in met.columns and set(found.columns) == {"_id", "b"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_bands_follow_the_threshold():
    assert CO.bands_needed(1.0, 20, 0.99) == 1 < CO.bands_needed(0.95, 8, 0.99) < CO.bands_needed(0.8, 8, 0.99)


def _turned(rng, u, cos):
    """A vector with this cosine to u."""
    n = rng.standard_normal(len(u))
    n -= (n @ u) / (u @ u) * u
    return cos * u / np.linalg.norm(u) + math.sqrt(1 - cos * cos) * n / np.linalg.norm(n)


def _joined(n, *edges):
    return _components(n, [e for some in edges for e in some])


def test_links_of_crowded_buckets_are_all_found(spark):
    """Rows that share their buckets with more unlike ones than there are rounds."""
    rng = np.random.default_rng(5)
    centre = np.eye(128)[0]
    rows = [(1, f"other{k:03d}", 1, _turned(rng, centre, .8 ** .5).tolist()) for k in range(120)]
    for k in range(40):
        u = _turned(rng, centre, .8 ** .5)
        rows += [(1, f"twin{k:02d}a", 1, u.tolist()), (1, f"twin{k:02d}b", 1, _turned(rng, u, .93).tolist())]
    want, n_links = _groups(rows, 0.9)
    assert n_links == 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    got = {r.variant: r.canonical for r in CO.homologate_by_embedding(df, 0.9).collect()}
    assert got == {v: rows[want[k]][1] for k, (_, v, *_) in enumerate(rows)}


def test_rest_edges_join_what_links_join(spark):
    """Groups of one chunk and of several, components that are given, one that
    fills chunks of its own, unlike dimensions."""
    rng = np.random.default_rng(8)
    rows = []
    for g, dim, size in ((0, 12, 300), (1, 12, 40), (0, 5, 90), (2, 3, 1)):
        centres = rng.standard_normal((size // 4 + 1, dim))
        rows += [(g, dim, centres[rng.integers(len(centres))] + .3 * rng.standard_normal(dim)) for _ in range(size)]
    big = rng.standard_normal(12)
    rows += [(0, 12, big + .05 * rng.standard_normal(12)) for _ in range(150)]
    big_at = list(range(len(rows) - 150, len(rows)))
    links = []
    for a, (g, dim, u) in enumerate(rows):
        links += [(a, b) for b in range(a) if rows[b][:2] == (g, dim) and u @ rows[b][2] >= .9 * np.linalg.norm(u) * np.linalg.norm(rows[b][2])]
    given = [e for e in links if set(e) <= set(big_at)] + links[::9]
    roots = _joined(len(rows), given)
    in_one = [(k, r) for k, r in enumerate(roots) if roots.count(r) > 1]
    df = spark.createDataFrame([(k, g, v.tolist()) for k, (g, _, v) in enumerate(rows)], "_id long, _g long, _v array<double>").repartition(3)
    for some in (in_one, []):
        known = spark.createDataFrame(some, "node long, root long")
        for most in (None, 25):
            got = [(r.a, r.b) for r in CO.rest_edges(df, known, 0.9, most).collect()]
            assert _joined(len(rows), links) == _joined(len(rows), some, got)
            assert len(got) < 10 * len(rows) and all(b < a for a, b in got)
    held = df.withColumnRenamed("_id", "node").join(spark.createDataFrame(in_one, "node long, root long"), "node", "left")
    held = held.select(F.col("node").alias("_id"), "_g", F.size("_v").alias("dim"), F.coalesce("root", "node").alias("root"), "_v")
    counts = held.groupBy("_g", "dim", "root").agg(F.count("*").alias("n"))
    dealt = CO.chunk_pairs(held, counts, F.lit(25).cast("bigint")).withColumn("own", F.coalesce(F.col("lo.own") == F.col("hi.own"), F.lit(False)))
    # chunks of one component do not meet, other chunks of a group all do
    assert dealt.filter("lo.own >= 0 AND own").count() == 0
    assert dealt.filter("_g = 1").count() > 40 == df.filter("_g = 1").count()


def test_cosines_are_those_of_the_columns(spark):
    rng = np.random.default_rng(9)
    u, v = rng.standard_normal((2, 200, 16)).astype(np.float32)
    v[:100] = u[:100] * 3 + rng.normal(0, .1, (100, 16))
    df = spark.createDataFrame([(k, a.astype(float).tolist(), b.astype(float).tolist()) for k, (a, b) in enumerate(zip(u, v, strict=True))], "k long, u array<double>, v array<double>")
    want = [r[0] for r in df.orderBy("k").select(CO.cosine(F.col("u"), F.col("v"))).collect()]
    assert CO.cosines(u, v).tolist() == want


def test_pairs_at_the_threshold_and_vectors_of_extreme_length(spark):
    rows = [(1, "at", 1, [3.0, 4.0]), (1, "threshold", 1, [1.0, 0.0]), (1, "other", 1, [4.0, -3.0]),
            (2, "long", 1, [1e200, 1e200, 0.0]), (2, "longer", 1, [3e200, 3.1e200, 0.0]), (2, "square", 1, [0.0, 0.0, 1e200]), (2, "unit", 1, [1.0, 1.0, 0.0]),
            (3, "short", 1, [1e-200, 0.0]), (3, "shorter", 1, [1e-210, 1e-212]), (3, "across", 1, [0.0, 1e-200])]
    df = spark.createDataFrame(rows, "user_id long, name string, n long, embedding array<double>")
    got = {r.variant: r.canonical for r in CO.homologate_by_embedding(df, 0.6).collect()}
    assert got == {"at": "at", "threshold": "at", "other": "at", "long": "long", "longer": "long", "unit": "long", "square": "square",
                   "short": "short", "shorter": "short", "across": "across"}
