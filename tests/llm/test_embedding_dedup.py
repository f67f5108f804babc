"""Subspace pigeonhole join against all pairs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import embedding_dedup as ed
from papyra.llm import queries
from papyra.llm.components import join_labels

from ..conftest import SF_SMALL
from . import edges

SCHEMA = "vec_id long, embedding array<double>, label int, node long, key string, n_links int, copies int"


def _usable(vec, label):
    return label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec) and any(vec)


def _expected(rows, threshold=0.98):
    """rows: (id, vector, label)."""
    n = len(rows)
    links = np.zeros((n, n), bool)
    groups = {}
    for i, (_, v, g) in enumerate(rows):
        if _usable(v, g):
            groups.setdefault((g, len(v)), []).append(i)
    for at in groups.values():
        x = np.array([rows[i][1] for i in at], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(links, False)
    label = join_labels(n, *np.nonzero(links))
    out = []
    for i, (vec_id, v, g) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None]
        component = min(ids, default=None) if _usable(v, g) else vec_id
        out.append((vec_id, int(links[i].sum()), component, component == vec_id))
    return edges.bag(out)


def _got(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return edges.bag(tuple(r) for r in df.collect())


def _clusters(rng, dim, sizes, spread):
    """Groups of unit vectors around random ones, and single vectors."""
    out = []
    for n, s in zip(sizes, spread, strict=True):
        centre = rng.standard_normal(dim)
        out += list(centre / np.linalg.norm(centre) + s * rng.standard_normal((n, dim)) / math.sqrt(dim))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 3, 8, 20, 64]), st.integers(1, 40))
def test_every_near_pair_meets_once(seed, dim, cell_rows):
    """Cells, blocks and midpoints by hand: each pair within reach is judged
    in one cell of one block."""
    rng = np.random.default_rng(seed)
    v = np.array(_clusters(rng, dim, [10, 10, 10, 10], [.02, .1, .15, 2.0]))
    q, shift, error = ed.rounded(v)
    far = math.sqrt(2 - 2 * .98)
    reach = far + 2 * error.max() + ed.SLACK
    at, radius = ed.cuts(dim), ed.radii(dim, reach)
    x = np.ldexp(q.astype(float), -shift[:, None])
    weight, open_ = np.zeros(len(v), int), []
    for b in range(len(radius)):
        k = ed.depth(len(v), at[b + 1] - at[b], cell_rows)
        row, key = ed.cells(x[:, at[b]:at[b + 1]], radius[b], k)
        for cell in np.unique(key):
            own = row[key == cell]
            assert len(set(own)) == len(own)
            side = rng.random(len(own)) < .5
            parts = [(own, None)] if rng.random() < .5 else [(own[side], None), (own[~side], None), (own, side)]
            for rows, s in parts:
                w, _, doubt = ed.compare(dim, b, int(cell), k, q[rows], shift[rows], error[rows], np.ones(len(rows), int), s, far, reach)
                weight[rows] += w
                open_ += [tuple(sorted(rows[p])) for p in doubt.T]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert len(set(open_)) == len(open_)
    for a, b in open_:
        if u[a] @ u[b] >= .98:
            weight[[a, b]] += 1
    assert (weight == (u @ u.T >= .98).sum(1) - 1).all()


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(6)
    near = [(one + .02 * rng.standard_normal(6)).tolist() for _ in range(3)]
    one = one.tolist()
    rows = [(1, one, 1), (2, near[0], 1), (3, near[1], 2), (4, near[2], None), (5, None, 1), (6, [], 1), (7, [0.0] * 6, 1),
            (8, [None, *one[1:]], 1), (9, [math.nan, *one[1:]], 1), (10, [math.inf, *one[1:]], 1), (11, one, 1), (11, one, 1),
            (12, one[:4], 1), (12, near[1], 1), (None, near[2], 1), (None, one, 3), (None, None, 1), (13, [7 * x for x in one], 1),
            (14, [-x for x in one], 1), (15, [-0.0, 1.0], 1), (16, [0.0, 1.0], 1), (-1, [1e-200 * x for x in one], 1),
            (17, [1e300, 1e300], 1), (18, [2.0], 4), (19, [3.0], 4), (20, [-3.0], 4)]
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(3)
    # a vector whose length overflows or vanishes in double precision has no cosine
    plain = [(i, None if i in (-1, 17) else v, g) for i, v, g in rows]
    got = _got(ed.near_duplicates(df.filter("vec_id IS NULL OR vec_id NOT IN (-1, 17)")))
    assert got == edges.bag(r for r in _expected(plain) if r[0] not in (-1, 17))
    assert ed.near_duplicates(df).count() == len(rows)
    assert _got(ed.near_duplicates(df.limit(0))) == []


@pytest.mark.parametrize("cell_rows", [12, 100_000])
def test_hot_label_and_crowded_cells(spark, cell_rows):
    """A label with most rows, a cluster of near copies that fills more than
    a cell, exact copies, pairs around the threshold; with a grid and chunks,
    and without."""
    rng = np.random.default_rng(5)
    v = _clusters(rng, 16, [60, 40, 8, 8, 90], [.08, .14, .15, .2, 2.0])
    v += v[:20] * 2
    rows = [(int(i), x.tolist(), 0 if k % 5 else 1) for k, (i, x) in enumerate(zip(rng.permutation(len(v)), v, strict=True))]
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(5)
    expected = _expected(rows)
    assert sum(r[1] for r in expected) > 1000
    assert _got(ed.near_duplicates(df, cell_rows=cell_rows)) == expected


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert _got(queries.QUERIES["op11_embeddings"](spark, SF_SMALL)) == _expected(rows)
