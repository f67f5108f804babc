"""Stored shapes and the plan table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Plan limits (-1 = unlimited) and monthly prices (None = custom).
PLAN_LIMITS = {
    "free":       {"docs_per_month": 50,   "doc_types_max": 1,  "max_file_size_mb": 5,  "batch_infer_max": 5},
    "starter":    {"docs_per_month": 500,  "doc_types_max": 10, "max_file_size_mb": 10, "batch_infer_max": 10},
    "pro":        {"docs_per_month": 1000, "doc_types_max": -1, "max_file_size_mb": 25, "batch_infer_max": 10},
    "enterprise": {"docs_per_month": -1,   "doc_types_max": -1, "max_file_size_mb": 50, "batch_infer_max": 10},
}
PLAN_PRICES = {"free": 0, "starter": 29, "pro": 49, "enterprise": None}

PLAN_SCHEMA = ("plan string, docs_per_month int, doc_types_max int, max_file_size_mb int, "
               "batch_infer_max int, price int")


def plan_limits_df(spark: SparkSession) -> DataFrame:
    """The plan table as a 4-row DataFrame (its size is fixed, so it is
    always safe to broadcast)."""
    rows = [(p, v["docs_per_month"], v["doc_types_max"], v["max_file_size_mb"], v["batch_infer_max"],
             PLAN_PRICES[p]) for p, v in PLAN_LIMITS.items()]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


PLAN_VALUES_SQL = ("(VALUES ('free', 50, 1, 5, 5, 0), ('starter', 500, 10, 10, 10, 29), "
                   "('pro', 1000, -1, 25, 10, 49), ('enterprise', -1, -1, 50, 10, NULL)) "
                   "AS pl(plan, docs_per_month, doc_types_max, max_file_size_mb, batch_infer_max, price)")
