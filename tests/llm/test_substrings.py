"""Repeated-substring removal against brute force over all windows."""

import hashlib
import random
from collections import Counter

from papyra.llm import queries, substrings

from ..conftest import SF_SMALL
from . import edges


def _expected(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[j:j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j:j + length]] > 1:
                gone[j:j + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        n_spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return edges.bag(out)


def _bag(df):
    return edges.bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_runs_hold_every_window_once():
    rnd = random.Random(2)
    for _ in range(40):
        text = ("".join(rnd.choices("ab", k=rnd.randint(0, 800))) + "A" * rnd.randint(0, 600)).encode()
        starts = [s + k for s, n, *_ in substrings.text_runs(text, 200) for k in range(n)]
        assert starts == list(range(max(0, len(text) - 199)))


def test_equal_windows_have_one_bucket():
    rnd = random.Random(6)
    passage = "".join(rnd.choices("abcdefgh ", k=420))
    texts = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(0, 500))) + passage + "tail" * k for k in range(4)]
    bucket = {}
    for t in texts:
        b = t.encode()
        for s, n, v, _, _ in substrings.text_runs(b, 200):
            for k in range(s, s + n):
                assert bucket.setdefault(b[k:k + 200], v) == v


def test_pointers_are_equal_exactly_for_equal_strings():
    rnd = random.Random(3)
    for _ in range(30):
        base = "".join(rnd.choices("abc", k=700)) + "z" * 400
        slices = [base[i:i + rnd.randint(200, 327)].encode() for i in (rnd.randint(0, 800) for _ in range(7))]
        slices = [s for s in slices if len(s) >= 200]
        counts = [min(len(s) - 199, 128) for s in slices]
        seen = Counter(s[j:j + 200] for s, n in zip(slices, counts, strict=True) for j in range(n))
        for s, n, got in zip(slices, counts, substrings.repeated_starts(slices, counts, 200), strict=True):
            assert got.tolist() == [seen[s[j:j + 200]] > 1 for j in range(n)]


def _awkward():
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]
    line = " ".join(rnd.choices(words, k=30))
    passage = " ".join(rnd.choices(words, k=80))
    rows = [*edges.ROWS, (40, passage), (41, "lead " + passage + " tail"), (42, passage[:250]), (43, passage[150:] + line),
            (44, "A" * 201), (45, "xyz" * 300), (46, line + " " + line), (47, "é" * 150 + "ß" * 150), (48, "q" + "é" * 150)]
    return rows + [(100 + k, " ".join(rnd.choices(words, k=20)) + " " + line + " " + " ".join(rnd.choices(words, k=20)))
                   for k in range(40)]


def test_edge_rows(spark):
    rows = _awkward()
    got = substrings.remove_repeats(edges.frame(spark, rows))
    assert _bag(got) == _expected(rows)
    text = dict((r[0], (r[1] or "").encode()) for r in rows if r[0] not in (None, 18, 19))
    for r in got.filter("doc_id >= 20").collect():
        gone = {x for s in r.spans for x in range(s.first, s.first + s.bytes)}
        assert bytes(r.kept) == bytes(c for k, c in enumerate(text[r.doc_id]) if k not in gone)
    assert substrings.remove_repeats(edges.frame(spark, [])).count() == 0


def test_crowded_buckets_give_the_same(spark):
    rows = _awkward()
    base = substrings._base(edges.frame(spark, rows), "doc_id", "text")

    def starts(cap):
        got = substrings.repeated_spans(base, 200, cap).distinct().collect()
        return {(r.key, r.start + k) for r in got for k in range(r.n)}

    assert starts(1024) == starts(2)


def test_only_tables_read_twice_are_stored(spark, monkeypatch):
    written = []
    monkeypatch.setattr(substrings, "stored", lambda df, kind, store=substrings.stored: (written.append(kind), store(df, kind))[1])
    rows = _awkward()
    assert _bag(substrings.remove_repeats(edges.frame(spark, rows))) == _expected(rows)
    assert written == ["runs", "contents", "pieces", "windows"]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert _bag(queries.QUERIES["op10_substrings"](spark, SF_SMALL)) == _expected(docs)
