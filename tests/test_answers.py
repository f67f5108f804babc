"""J1 answer store: lost tasks repeat only what has no answer, errors may be
asked again, results equal the plain model stage."""

import os

import pytest
from pyspark.sql import functions as F

from papyra.operators import answers as A
from papyra.operators import model as MD


def _counted(log, crash_at=None):
    """A model that logs its calls and kills its process at a count of them."""
    def fn(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if crash_at is not None and sum(1 for _ in open(log)) >= crash_at:
            os._exit(1)
        return prompt.upper()
    return fn


def _calls(log):
    return open(log).read().split() if os.path.exists(log) else []


def test_lost_task_repeats_unanswered_only(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id") % 200).alias("prompt"))
    store, first, second = str(tmp_path / "store"), str(tmp_path / "a"), str(tmp_path / "b")
    with pytest.raises(Exception):  # noqa: B017 - the worker process is gone
        A.stored_model_stage(rows, _counted(first, 120), store, calls_per_task=4)
    kept = {r.response.lower() for r in A.stored_answers(spark, store).collect()}
    assert 40 <= len(kept) < 200 and kept <= set(_calls(first))
    out = A.stored_model_stage(rows, _counted(second), store, calls_per_task=4).collect()
    assert sorted(_calls(second)) == sorted({f"p{i}" for i in range(200)} - kept)
    assert len(out) == 300 and all(r.response == r.prompt.upper() and r.error is None for r in out)
    assert A.ask_missing(rows, _counted(second), store, calls_per_task=4) == 0


def test_waves_errors_models_and_nulls(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, None if i == 9 else "x" * (i % 5)) for i in range(40)], "doc_id long, prompt string")

    def strict(p):
        if len(p) == 3:
            raise ValueError("tres")
        return str(len(p))
    got = {r.doc_id: (r.response, r.error) for r in A.stored_model_stage(rows, strict, store, calls_per_task=1, tasks_per_wave=2).collect()}
    plain = {r.doc_id: (r.response, r.error) for r in MD.model_stage(rows.filter("prompt is not null"), strict).collect()}
    assert got == plain | {9: (None, None)} and got[3] == (None, "ValueError: tres")
    assert A.ask_missing(rows, len, store) == 0 and A.ask_missing(rows, strict, store, retry_errors=True) == 1
    assert A.stored_model_stage(rows, lambda p: "ok", store, retry_errors=True).filter("doc_id = 3").first().response == "ok"
    assert A.ask_missing(rows, strict, store, model="v2") == 5


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, prompt string")
    assert A.stored_model_stage(rows, str, str(tmp_path / "s")).collect() == []
