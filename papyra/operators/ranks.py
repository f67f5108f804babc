"""Places in a total order, found without a window over a group.

Rows are range-partitioned by the order and sorted inside the partitions
(runs); a run's row count (or sum) is an aggregate, and the sums of the runs
before it, one row a run, are its offset. A group of any size is spread over as
many runs as it fills. Runs are checkpointed, so their rows keep their places
whichever executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

Order = Sequence[str | Column]


def sorted_runs(rows: DataFrame, order: Order) -> DataFrame:
    """``rows`` with ``_run`` (ascending in the order) and ``_at`` (place in
    the run). ``order`` must be total: rows that tie may swap places."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_place", F.monotonically_increasing_id())
    return (cut_lineage(placed).withColumn("_run", F.shiftright("_place", 33))
            .withColumn("_at", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place"))


def before_runs(runs: DataFrame, **sums: Column) -> DataFrame:
    """``_run`` and, under each name, the sum over all earlier runs: a window
    over one row a run, whose number is that of the shuffle partitions."""
    per = runs.groupBy("_run").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_run", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def ordered_index(rows: DataFrame, order: Order, name: str = "index") -> DataFrame:
    """``rows`` with their place (from 0) in the order."""
    runs = sorted_runs(rows, order)
    offsets = before_runs(runs, _offset=F.lit(1))
    return runs.join(offsets, "_run").withColumn(name, F.col("_offset") + F.col("_at")).drop("_run", "_at", "_offset")


def index_in_group(rows: DataFrame, group: Sequence[str], order: Order, name: str = "index") -> DataFrame:
    """``rows`` with their place (from 0) in the order of their group: the
    place among all rows less the group's first one (a partial minimum)."""
    placed = ordered_index(rows, [*group, *order], "_all")
    first = placed.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.min("_all").alias("_first"))
    same = F.lit(True)
    for i, c in enumerate(group):
        same = same & placed[c].eqNullSafe(F.col(f"_g{i}"))
    return placed.join(first, same).withColumn(name, F.col("_all") - F.col("_first")).drop(
        "_all", "_first", *[f"_g{i}" for i in range(len(group))])


def allocate_ids(new: DataFrame, taken: DataFrame, order: Order, id_col: str = "id") -> DataFrame:
    """``new`` rows with ids after the largest of ``taken``, in the order:
    gapless, and the same whenever it is run again on the same rows."""
    last = F.coalesce(taken.agg(F.max(id_col)).scalar(), F.lit(0))
    placed = ordered_index(new, order, "_index")
    return placed.withColumn(id_col, (last + F.col("_index") + 1).cast(taken.schema[id_col].dataType)).drop("_index")
