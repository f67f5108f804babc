"""Stored answers of the model stage (J1): calls are paid for once.

Answers live in a table of files, appended by the tasks that make the calls.
Each task answers a few prompts and its file appears when the task commits
(file committer version 2), not when the job does, so a lost executor, a failed
job or a killed driver costs the calls of the tasks that were running. The next
run asks for what has no answer yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

ANSWERS = "key string, response string, error string"
COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """One row per prompt key ever asked: a response if any attempt gave one,
    else an error. Attempts that disagree resolve to the largest response."""
    try:
        files = spark.read.schema(ANSWERS).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], ANSWERS)
    best = F.max(F.struct(F.col("error").isNull().alias("ok"), "response", "error")).alias("_a")
    return files.groupBy("key").agg(best).select("key", "_a.response", "_a.error")


def _call(fn: Callable[[str], str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, prompt in zip(b["key"], b["prompt"]):
                try:
                    rows.append((key, fn(prompt), None))
                except Exception as e:  # noqa: BLE001 - one bad prompt never fails its task
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "response", "error"])
    return run


def prompt_key(prompt: str, model: str):
    """The stored name of a prompt: model and version are part of it."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), F.col(prompt)), 256)


def ask_missing(prompts: DataFrame, fn: Callable[[str], str], store: str, model: str = "", text_col: str = "prompt",
                calls_per_task: int = 50, tasks_per_wave: int = 2000, retry_errors: bool = False) -> int:
    """Call ``fn`` once for every distinct prompt without a stored answer and
    append what it gives; returns how many were asked. A stored error counts
    as an answer unless ``retry_errors``. About ``calls_per_task`` prompts go
    to a task, so that many calls a running task are lost at most with it.
    Waves of ``tasks_per_wave`` tasks keep the shuffle small; nulls are not asked."""
    spark = prompts.sparkSession
    asked = prompts.filter(F.col(text_col).isNotNull()).select(prompt_key(text_col, model).alias("key"), F.col(text_col).alias("prompt"))
    have = stored_answers(spark, store)
    if retry_errors:
        have = have.filter(F.col("error").isNull())
    todo = cut_lineage(asked.groupBy("key").agg(F.first("prompt").alias("prompt")).join(have, "key", "left_anti"))
    n = todo.count()
    waves = max(1, math.ceil(n / calls_per_task / tasks_per_wave))
    tasks = max(1, math.ceil(n / waves / calls_per_task))
    for wave in range(waves if n else 0):
        part = todo.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).repartition(tasks, "key")
        part.mapInPandas(_call(fn), ANSWERS).write.options(**COMMIT_BY_TASK).mode("append").parquet(store)
    return n


def stored_model_stage(rows: DataFrame, fn: Callable[[str], str], store: str, model: str = "",
                       text_col: str = "prompt", **params) -> DataFrame:
    """J1 over the store: ``rows`` with ``response`` and ``error``, as
    ``model_stage`` gives them. A null prompt has neither."""
    ask_missing(rows, fn, store, model, text_col, **params)
    keyed = rows.withColumn("_key", prompt_key(text_col, model))
    return keyed.join(stored_answers(rows.sparkSession, store).withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
