"""Filter interaction audit: tries, adaptive prefixes and every order's
figures against brute force."""

import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import filter_audit as fa
from papyra.llm import queries

from ..conftest import SF_SMALL
from . import edges

LABELS = "doc_id long, quality int, toxic int"


def _mask(row_id, text, lows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words),
             100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
             row_id is not None and row_id > lows[text])
    return {c for c, f in zip("ABCDE", fails, strict=True) if f}


def _expected(rows, labels):
    """rows: (id, text, part). Every order applied filter by filter."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    lows = {}
    for i, t, _ in rows:
        if i is not None:
            lows[t] = min(i, lows.get(t, i))
    marks = {}
    for i, q, x in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or x == 1)
    fails = [(_mask(i, t, lows), p, marks.get(i, (False, False)) if i is not None else (False, False)) for i, t, p in rows]
    out, shares = {}, {}
    for part in {p for _, p, _ in fails}:
        own = [(m, mark) for m, p, mark in fails if p == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[0]]
                redundant = sum(f in m for m, _ in gone)
                left, gone = [x for x in left if f not in x[0]], gone + removed
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(m == {f} for m, _ in own),
                                                   sum(g for _, (g, _) in removed), sum(x for _, (_, x) in removed)]
                shares[part, f] = shares.get((part, f), 0) + len(removed)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _got(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in rows}
    assert len(got) == len(rows)
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), st.integers(-5, 5)), max_size=40))
def test_trie_terminals(rows):
    low = {}
    for t, i in rows:
        low[t] = min(i, low.get(t, i))
    assert fa.smallest_ids([t for t, _ in rows], [i for _, i in rows]) == [low[t] for t, _ in rows]


def test_adaptive_prefixes(spark):
    """A prefix longer than the first length is crowded; equal texts keep one prefix."""
    head = "h" * 300
    texts = [head + str(i) * 40 for i in range(40)] + ["short", "", None, head]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    crowded = fa.crowded_prefixes(docs, 2000)
    assert [len(crowded[k]) for k in sorted(crowded)] == [1, 1, 1, 0]
    got = {fa.adaptive_prefix((t or "").encode(), crowded) for t in texts}
    assert max(map(len, got)) == 380 and {b"short", b"", head.encode()} <= got
    assert fa.crowded_prefixes(docs.limit(0))[fa.PREFIX].tolist() == []


def test_edge_rows(spark):
    docs = edges.frame(spark).withColumnRenamed("key", "source")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [(1, 1, 0), (1, 0, 1), (13, 1, 1), (19, 0, 1), (None, 1, 1), (18, 1, None)]
    marks = spark.createDataFrame(labels, LABELS)
    for crowded in (fa.CROWDED, 64):
        assert _got(fa.audit(docs, marks, crowded_bytes=crowded)) == _expected(rows, labels)
    assert fa.audit(docs.limit(0), marks).count() == 0
    assert _got(fa.audit(docs, marks.limit(0))) == _expected(rows, [])


def test_copies_across_tasks_and_tries(spark, monkeypatch):
    """Tries cut after every prefix, tasks that settle few rows, a hot text."""
    monkeypatch.setattr(fa, "TRIE_BYTES", 600)
    rng = np.random.default_rng(3)
    pool = ["HOT copy of one text " * 3, *("text %d " % k * 7 for k in range(12)), "#", ""]
    rows = [(int(i), pool[int(rng.integers(0, 30)) % len(pool) if rng.random() < .6 else 0], f"s{i % 2}")
            for i in rng.permutation(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    assert _got(fa.audit(docs, spark.createDataFrame([], LABELS), crowded_bytes=500)) == _expected(rows, [])


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
    expected = _expected([(r.doc_id, r.text, r.source) for r in docs], [(r.doc_id, r.quality, r.toxic) for r in labels])
    assert _got(queries.QUERIES["op12_filter_audit"](spark, SF_SMALL)) == expected
