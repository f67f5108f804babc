"""Repetition figures against quadratic brute force."""

import random
import re

from papyra.llm import queries, repetition

from ..conftest import SF_SMALL
from . import edges


def _reach(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def _cover(reach, least, size=None):
    return len({x for i, k in enumerate(reach) if k >= least for x in range(i, i + (size or k))})


def test_repeats_against_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        texts = [[rnd.choice([b"a", b"b", b"c"][:rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 16))]
                 for _ in range(rnd.randint(1, 4))]
        covered, longest, three = repetition.repeat_figures(texts, 4)
        for words, c, most, t in zip(texts, covered, longest, three, strict=True):
            reach = _reach(words)
            assert (c, most, t) == (_cover(reach, 4), max(reach, default=0), _cover(reach, 3, 3))


def _figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    repeat = len({x for i, g in enumerate(grams) if seen[g] > 1 for x in range(i, i + 3)})
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), repeat)


def _check(rows, texts):
    got = edges.bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == edges.bag((i, *_figures(t)) for i, t in texts)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_edge_rows(spark):
    _check(repetition.quality_rules(edges.frame(spark)).collect(), edges.ROWS)
    assert repetition.quality_rules(edges.frame(spark, [])).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    _check(queries.QUERIES["op2_repetition_quality"](spark, SF_SMALL).collect(), docs)


def test_long_repeats_fail_and_natural_text_passes(spark):
    words = [f"word{i}" for i in range(300)]
    passage = words[:40]
    rows = [(1, " ".join(words)), (2, " ".join(words + passage)), (3, " ".join(words + words[:10] + ["z"] + words[50:60]))]
    kept = {r.doc_id: r.kept for r in repetition.quality_rules(edges.frame(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: True}
