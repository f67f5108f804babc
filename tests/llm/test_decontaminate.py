"""Spaced seeds and leaks against brute force over all pairs of windows."""

import random
import re

import numpy as np

from papyra.llm import decontaminate, queries

from ..conftest import SF_SMALL
from . import edges


def _words(text):
    return re.findall(r"\w+", (text or "").lower())


def _expected(docs, items, span=12, errors=2):
    out = {}
    for i, t in docs:
        w = np.array(_words(t), object)
        for j, x in items:
            v = np.array(_words(x), object)
            if len(w) < span or len(v) < span:
                continue
            same = (w[:, None] == v[None, :]).astype(int)
            n, m = len(w) - span + 1, len(v) - span + 1
            total = sum(same[k:k + n, k:k + m] for k in range(span))
            hit = total >= span - errors
            if hit.any():
                windows = {tuple(v[c:c + span]) for c in np.flatnonzero(hit.any(axis=0))}
                out[i, j] = (len(windows), int(total.max()))
    return out


def test_any_two_substitutions_leave_a_seed():
    h = np.arange(100, 112, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    plain = decontaminate.seeds(h, 12, 2)[:, 0]
    for a in range(12):
        for b in range(12):
            other = h.copy()
            other[[a, b]] = 7
            assert (decontaminate.seeds(other, 12, 2)[:, 0] == plain).any()


def test_substituted_passages(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(10, 40)))) for k in range(12)] + [(50, None), (51, ""), (12, None)]
    docs = []
    for k in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 60))
        if k % 3 == 0:
            passage = items[k % 12][1].upper().split()
            for _ in range(rnd.randint(0, 6)):
                passage[rnd.randrange(len(passage))] = "sub"
            words += passage + rnd.choices(vocabulary, k=5)
        docs.append((k, ", ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.same_words)
           for r in decontaminate.find_leaks(edges.frame(spark, docs), bench).collect()}
    assert got == _expected(docs, items) and len(got) > 10


def test_edge_rows(spark):
    words = " ".join(f"w{i % 977}x{i}" for i in range(500, 520))
    bench = spark.createDataFrame([(1, words, "x"), (2, None, None), (1, words, "x"), (None, "repeat " * 12, "y")],
                                  "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(edges.frame(spark), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 1), (17, None)}
    kept = decontaminate.drop_leaks(edges.frame(spark), bench)
    assert kept.columns == edges.frame(spark).columns
    assert edges.bag((r.doc_id, r.text) for r in kept.collect()) == edges.bag(r for r in edges.ROWS if r[0] not in (4, 17))
    assert decontaminate.find_leaks(edges.frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(edges.frame(spark), bench.limit(0)).count() == 0


def test_short_items(spark):
    bench = spark.createDataFrame(
        [(1, "Capital of France?"), (2, "one two three four five six seven"), (3, "solo"), (4, " ".join(f"v{i}" for i in range(11)))],
        "item_id long, text string")
    eleven = [f"v{i}" for i in range(11)]
    docs = [(1, "what is the CAPITAL of France today, capital of france"), (2, "capital of spain"),
            (3, "a one two THREE x five six seven b"), (4, "one two three x y six seven"), (5, "solo solo solo"),
            (6, " ".join(eleven)), (7, " ".join(["z", *eleven[:4], "x", *eleven[5:]])), (8, " ".join(["x", "x", *eleven[2:]])),
            (9, "of"), (10, "")]
    got = decontaminate.find_leaks(edges.frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.same_words) for r in got} == {
        (1, 1): (1, 3), (3, 2): (1, 6), (5, 3): (1, 1), (6, 4): (1, 11), (7, 4): (1, 10)}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = queries.QUERIES["op4_decontaminate"](spark, SF_SMALL).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.same_words) for r in got} == _expected(docs, items)
