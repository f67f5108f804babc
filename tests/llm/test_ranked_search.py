"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import queries
from papyra.llm import ranked_search as rs

from ..conftest import SF_SMALL
from . import edges

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _expected(docs, items, k=10):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return edges.bag(out)


def _rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return edges.bag(tuple(r) for r in df.collect())


def test_terms():
    for t in ["A-b_c9 É中文x\x00y\x7fz", "", None, "@[`{/:", "a\x1cb c\x85d"]:
        assert [w.decode() for w in rs.terms(t)] == _terms(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 140), max_size=90), min_size=1, max_size=40),
       st.lists(st.integers(0, 140), max_size=100, unique=True), st.integers(1, 6))
def test_block_by_masks(texts, item, k):
    """More than 64 terms too: masks of several words."""
    texts = [t for t in texts if t]
    if not texts:
        return
    n = np.array([len(t) for t in texts])
    each = [np.unique(t, return_counts=True) for t in texts]
    ends = np.r_[0, np.cumsum([len(v) for v, _ in each])]
    weights = np.array([(t * 37) % 900 for t in item], np.int64)
    block = rs.Block(n, ends, np.concatenate([v for v, _ in each]), np.concatenate([c for _, c in each]), len(n), int(n.sum()))
    ids = np.arange(len(n))[::-1].astype(np.int64)
    best = rs.Best(k)
    block.search(item, weights, ids, np.zeros(len(n), bool), best)
    scores = []
    for d, t in enumerate(texts):
        m, tf = 10 + 90 * len(t) * len(n) // int(n.sum()), Counter(t)
        scores.append((-sum(int(w) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x, w in zip(item, weights, strict=True) if x in tf), int(ids[d])))
    assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == sorted(s for s in scores if s[0] < 0)[:k]


def test_masks_end_early():
    """Masks that cannot reach the best ten are not evaluated."""
    rng = np.random.default_rng(1)
    held = [np.sort(rng.choice(20, rng.integers(1, 5), replace=False)) for _ in range(3000)]
    held[7] = np.arange(20)
    n = np.full(3000, 20)
    ends = np.r_[0, np.cumsum([len(h) for h in held])]
    block = rs.Block(n, ends, np.concatenate(held), np.ones(ends[-1], int), len(n), int(n.sum()))
    best = rs.Best(1)
    done = block.search(list(range(20)), np.full(20, 500), np.arange(3000), np.zeros(3000, bool), best)
    assert best.ids.tolist() == [7] and done <= 64 < len({tuple(h) for h in held})


ITEMS = [(1, "tie one two three four five"), (2, None), (3, ""), (4, "nowhere zzz"), (1, "Row TWICE, text"), (None, "common line"),
         (5, edges.LONG), (6, "w1x1 repeat é end"), (7, "no id same negative big")]


def test_edge_rows(spark, monkeypatch):
    docs = edges.frame(spark)
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, rank string")
    expected = _expected(edges.ROWS, ITEMS)
    assert _rows(rs.ranked_search(docs, items)) == expected
    monkeypatch.setattr(rs, "BLOCK", 4)
    assert _rows(rs.ranked_search(docs, items, terms_per_pass=10_000)) == expected
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id IN (0, 1, 2)"), items)):
        assert _rows(rs.ranked_search(a, b)) == []


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert _rows(queries.QUERIES["op13_ranked_search"](spark, SF_SMALL)) == _expected(docs, items)
