"""Segments against brute force, training, and held-out accuracy."""

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import queries, toxicity

from ..conftest import SF_SMALL
from . import edges


def _maximal(s, a, b):
    """By definition: the best segment (shortest on ties), then both sides."""
    best = None
    for i in range(a, b):
        total = 0
        for j in range(i, b):
            total += s[j]
            if total > 0 and (best is None or total > best[2] or (total == best[2] and j - i < best[1] - best[0])):
                best = (i, j, total)
    return [] if best is None else [*_maximal(s, a, best[0]), best, *_maximal(s, best[1] + 1, b)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.just(-1), st.integers(-3, 4)), max_size=14))
def test_segments(scores):
    got = toxicity.segments([(i, float(v)) for i, v in enumerate(scores) if v != -1], 1.0)
    expected = _maximal(scores, 0, len(scores))
    assert [t for *_, t in got] == [t for *_, t in expected]
    assert all(sum(scores[a:z + 1]) == t for a, z, t in got)


def _corpus(n=900, seed=3):
    rnd = random.Random(seed)
    plain = [f"plain{i}" for i in range(300)]
    bad = ["vile", "rotten", "nastify", "nastical", "nastoid"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = rnd.choices(plain, k=rnd.randint(20, 200))
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_passages(spark):
    rows, labels = _corpus()
    docs = edges.frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_documents(docs, model).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    text = dict(rows)
    for r in got:
        for p in r.passages:
            words = text[r.doc_id].split()[p.first_word:p.last_word + 1]
            assert any(not w.startswith("plain") for w in words)
    # a word that was never seen is known by how it begins
    assert toxicity.Scorer(model).score("plain1 plain2 nastiness plain3 nastish vile")[0] > 0.7


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = _corpus(400)
    docs = edges.frame(spark, rows)
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    one = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = toxicity.train(docs, spark.createDataFrame(other, "doc_id long, toxic int"))
    assert one == two


def test_edge_rows(spark):
    rows, labels = _corpus(300)
    model = toxicity.train(edges.frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, toxic int"))
    df = edges.frame(spark)
    got = toxicity.score_documents(df, model).collect()
    assert edges.bag(r.doc_id for r in got) == edges.bag(i for i, _ in edges.ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empty = [r.score for r in got if r.doc_id == 1]
    assert empty == [min(r.score for r in got)]
    kept = toxicity.reject_toxic(df, model)
    assert kept.columns == df.columns
    assert edges.bag((r.doc_id, r.text) for r in kept.collect()) == edges.bag(edges.ROWS)
    assert toxicity.score_documents(edges.frame(spark, []), model).count() == 0


def test_without_labels_every_text_is_neutral(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    same = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    for labels in (none, same):
        model = toxicity.train(edges.frame(spark), labels)
        assert {r.score for r in toxicity.score_documents(edges.frame(spark), model).collect()} == {0.5}


def test_sample_is_bounded(spark):
    rows, labels = _corpus(600)
    model = toxicity.train(edges.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), sample_rows=200)
    assert model.scores


def test_repeated_passages_are_all_found_and_count_once():
    model = toxicity.ToxicityModel({"vile": 2.0, "rotten": 2.0, "nasty": 2.0}, 1.0, 0.0, 0.5, 0.01, (-3.0, 0.0, 2.0))
    gap = " plain" * 20
    score = toxicity.Scorer(model).score
    copies, twice = score("vile rotten nasty" + gap + " vile rotten nasty" + gap)
    assert [(a, z) for a, z, _ in twice] == [(0, 2), (23, 25)]
    alone, once = score("vile rotten nasty" + gap + " plain plain plain" + gap)
    assert copies == alone and len(once) == 1
    # words met before, far apart, do not hide a dense passage
    _, late = score("vile" + gap + " rotten" + gap + " nasty" + gap + " nasty vile rotten")
    assert [(a, z) for a, z, _ in late] == [(63, 65)]


def test_every_counted_word_keeps_its_log_odds():
    scores = toxicity.word_scores({"mild": (20, 60), "pure": (0, 400), "vile": (90, 0)}, 100, 900, 16.0, 1.0)
    assert -0.5 < scores["mild"] < 0 and scores["pure"] < -3 and scores["vile"] > 2
    scorer = toxicity.Scorer(toxicity.ToxicityModel(scores, 1.0, 0.0, 0.5, 0.01, (0.0, 1.0, 1.0)))
    mild = " ".join(["vile", *["mild"] * 12, "vile"])
    assert [(a, z) for a, z, *_ in scorer.passages(mild)[1]] == [(0, 13)]
    assert [(a, z) for a, z, *_ in scorer.passages("vile pure vile")[1]] == [(0, 0), (2, 2)]


def test_query_leaves_clean_documents_alone(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    got = queries.QUERIES["op9_toxicity"](spark, SF_SMALL).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert not [r.doc_id for r in got if truth.get(r.doc_id) == 0 and r.predicted]


def test_rejection_over_many_arrow_batches(spark):
    """Each text is judged for itself in slices and batches of any size."""
    model = toxicity.ToxicityModel({"vile": 2.0, "rotten": 2.0, "nasty": 2.0}, 1.0, 0.0, 0.5, 0.01, (-3.0, 0.0, 2.0))
    texts = [None, "", "plain words", "vile rotten nasty vile"]
    rows = [(k, texts[k % 4]) for k in range(2 * toxicity.SLICE + 90)]
    df = edges.frame(spark, rows, partitions=2)
    bad = toxicity.Scorer(model).score(texts[3])[0] >= 0.7
    assert bad
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            kept = toxicity.reject_toxic(df, model)
            assert {r.doc_id for r in kept.collect()} == {k for k, t in rows if t != texts[3]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
