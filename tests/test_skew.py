"""A tenant holding a third of all rows: per-tenant operators still give
the brute-force answer (their plans use partial aggregation and
WindowGroupLimit instead of a window over the tenant)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from papyra.operators import gates as G
from papyra.operators import listing as L
from papyra.operators import matching as M


def _docs(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        user = 1 if i % 3 == 0 else rnd.randint(2, 60)  # tenant 1 holds a third
        rows.append((i, user, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 2000)),
                     rnd.choice(["queued", "completed", "error", "processing"]), f"d{i}.pdf",
                     rnd.randint(0, 12_000_000), rnd.choice(["Factura", "Orden", "Boleta"])))
    cols = "id bigint, user_id bigint, created_at timestamp_ntz, status string, filename string, size_bytes bigint, name string"
    return spark.createDataFrame(rows, cols), pd.DataFrame(rows, columns=[c.split()[0] for c in cols.split(", ")])


def test_paginate_hot_tenant(spark):
    df, pdf = _docs(spark)
    got = L.paginate(df, page=3, limit=7, group_cols=["user_id"]).filter(F.col("user_id") == 1)
    want = pdf[pdf.user_id == 1].sort_values(["created_at", "id"], ascending=False).iloc[14:21]
    assert [r.id for r in got.orderBy("rank").collect()] == list(want.id)
    assert got.first().total == (pdf.user_id == 1).sum()


def test_batch_gate_and_usage_hot_tenant(spark):
    df, pdf = _docs(spark)
    g = G.batch_gate(df.withColumn("mime", F.lit("application/pdf")))
    hot = g.filter(F.col("user_id") == 1).select("n_files", "n_valid", "batch_error").distinct().collect()
    assert len(hot) == 1 and hot[0].n_files == 1000 and hot[0].batch_error == "Maximo 10 archivos permitidos"
    assert hot[0].n_valid == int((pdf[pdf.user_id == 1].size_bytes <= 10 * 1024 * 1024).sum())
    subs = df.select("user_id").distinct().withColumn("period_start", F.lit(dt.datetime(2024, 2, 1))) \
        .withColumn("period_end", F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz")) \
        .withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))
    u = {r.user_id: r.docs_in_period for r in M.usage_in_period(subs, df).collect()}
    m = pdf[(pdf.created_at >= "2024-02-01") & (pdf.created_at < "2024-03-01")].groupby("user_id").size()
    assert all(u[k] == int(m.get(k, 0)) for k in u)


def test_type_match_hot_tenant(spark):
    df, pdf = _docs(spark)
    types = spark.createDataFrame([(10 * u + k, u, n) for u in range(1, 61) for k, n in enumerate(["factura", "orden"])],
                                  "id bigint, user_id bigint, name string")
    got = {r.id: r.match_type_id for r in M.match_type_exact(df.withColumnRenamed("name", "classified_name"), types).collect()}
    for r in pdf.itertuples():
        exp = {"Factura": 10 * r.user_id, "Orden": 10 * r.user_id + 1}.get(r.name)
        assert got[r.id] == exp
