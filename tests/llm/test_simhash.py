"""SimHash fingerprints, trie self-join and components against brute force."""

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import queries, simhash
from papyra.llm.components import components, join_labels

from ..conftest import SF_SMALL
from . import edges

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _labels(fps, budget=4):
    f = np.array(fps, np.uint64)
    one, two = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= budget)
    return join_labels(len(f), one, two)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.lists(st.integers(0, 63), max_size=6)), min_size=1, max_size=60))
def test_trie_self_join(spec):
    centres = np.random.default_rng(9).integers(0, 1 << 64, 4, dtype=np.uint64)
    leaves = set()
    for group, c, flips in spec:
        v = int(centres[c])
        for b in flips:
            v ^= 1 << b
        leaves.add((group, v))
    leaves = sorted(leaves)
    group, value = np.array([g for g, _ in leaves]), np.array([v for _, v in leaves], np.uint64)
    one, two = np.nonzero((np.bitwise_count(value[:, None] ^ value[None, :]) <= 4) & (group[:, None] == group[None, :]))
    assert (simhash.trie_links(value, group, 4) == join_labels(len(value), one, two)).all()


def test_links_with_crowded_buckets(spark):
    """A cluster larger than a chunk: every chunk meets every other."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    for _ in range(300):
        v = base
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            v ^= 1 << int(b)
        fps.add(v)
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in signed], "fp long")
    edges_ = simhash.links(df, 4, chunk=20).collect()
    at = {int(v): i for i, v in enumerate(signed)}
    got = join_labels(len(signed), np.array([at[r.a] for r in edges_], int), np.array([at[r.b] for r in edges_], int))
    expected = _labels(signed.view(np.uint64))
    assert {tuple(np.flatnonzero(got == k)) for k in set(got)} == {tuple(np.flatnonzero(expected == k)) for k in set(expected)}
    assert len(edges_) < 5 * 64 * len(signed)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 40)] + [(7000, 7000)]
    df = spark.createDataFrame([(a, b) if a % 2 else (b, a) for a, b in path + star], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1040), 1000)}
    assert components(df.limit(0)).count() == 0


def _expected(rows):
    fps = [_fingerprint(t) for _, t in rows]
    label = _labels(fps)
    out = []
    for (i, _), f, k in zip(rows, fps, label, strict=True):
        ids = [rows[j][0] for j in np.flatnonzero(label == k) if rows[j][0] is not None]
        out.append((i, format(f, "016x"), min(ids, default=None)))
    return edges.bag(out)


def test_edge_rows(spark):
    got = simhash.near_duplicates(edges.frame(spark)).select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
    assert edges.bag(tuple(r) for r in got) == _expected(edges.ROWS)
    assert simhash.near_duplicates(edges.frame(spark, [])).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op3_simhash"](spark, SF_SMALL).collect()
    assert edges.bag((r.doc_id, r.fingerprint, r.component_id) for r in got) == _expected(docs)


def test_one_of_each(spark):
    docs = edges.frame(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    found = simhash.near_duplicates(docs).collect()
    assert len(rows) == len({r.root for r in found})
    fps = [_fingerprint(t) for _, t in rows]
    assert len(set(fps)) == len(fps)
    assert simhash.one_of_each(edges.frame(spark, [])).count() == 0


def test_replication_stays_constant(spark):
    """Rows sent to tries per fingerprint, from few to very many."""
    sent = []
    for n in (4_000, 64_000):
        fps = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)).view(np.int64)
        df = spark.createDataFrame([(int(v),) for v in fps], "fp long")
        groups = simhash.dealt(df, 4, chunk=8)
        sent.append(groups.count() / len(fps))
    assert sent[1] <= 25 and sent[1] <= sent[0] * 5
