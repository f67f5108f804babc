"""The pipeline's stages: columns, decisions, edge rows, registration."""

import base64
import gc
import weakref

import corpus_pipeline
import __spark_entry__ as E
from papyra.llm import bpe, decontaminate, lines, queries, simhash
from papyra.llm.common import drop_kept, stored

from ..conftest import SF_SMALL
from . import edges


def test_registered():
    names = E.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert len(corpus_pipeline.STAGES) == 5 and set(queries.ORACLES) <= set(names)


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF_SMALL), name)
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["line_dedup"]
    assert after.count() == before.count()
    expected = {r.doc_id: r.kept_text for r in lines.dedup_lines(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    before, after = seen["simhash_near_dedup"]
    groups = simhash.near_duplicates(before)
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups.collect()}
    before, after = seen["decontamination"]
    assert after.count() < before.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in tokens} == {r.doc_id for r in docs.collect()}
    assert all(len(r.ids) == r.n_tokens for r in tokens)
    whole = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.ids_sha256) for r in whole} == {(r.doc_id, r.ids_sha256) for r in tokens}


def test_edge_rows_pass_every_stage(spark):
    for rows in (edges.ROWS, []):
        docs = edges.frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, SF_SMALL), name)
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
        assert docs.count() > 10 or not rows


def test_a_worker_keeps_the_memos_of_one_operator():
    """Stages run in the same Python workers: what one of them memoised goes
    when another one begins."""
    blob = b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256))
    encoder = weakref.ref(bpe._encoder(blob, r"\w+"))
    assert bpe._encoder(blob, r"\w+") is encoder()
    assert len(decontaminate.word_hashes("one two one")) == 3
    gc.collect()
    assert encoder() is None
    hashes = weakref.ref(decontaminate._word_hash())
    assert decontaminate._word_hash() is hashes() and len(hashes()) == 2
    drop_kept()
    gc.collect()
    assert hashes() is None
