"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# What this process keeps between tasks: one result of one function.
_KEPT: dict[tuple, object] = {}


def drop_kept() -> None:
    _KEPT.clear()


def kept_alone(make: Callable) -> Callable:
    """``make`` with its last result kept in the process until any function so
    marked is called for another one. Spark hands a Python worker from operator
    to operator, so it holds the memos of the running one, not of all so far."""
    @wraps(make)
    def get(*args):
        key = (make.__module__, make.__qualname__, *args)
        if key not in _KEPT:
            drop_kept()
            _KEPT[key] = make(*args)
        return _KEPT[key]

    return get


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def utf8(c: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(c, F.lit("")).cast("binary")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: it
    is computed once, and a lost executor costs a re-read, not a re-run."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of the input has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so extra
    columns of any name cannot clash and are not read from the file."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
