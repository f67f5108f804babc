"""B8 guard rules and the display expressions."""

import datetime as dt

import pytest

from papyra.functions import display as R
from papyra.plans.guard import GuardError, guarded_select, prepare_safe_query, validate_sql


@pytest.mark.parametrize("sql", [
    "SELECT * FROM my_documents WHERE user_id = $1; DROP TABLE x",
    "select * from my_documents where user_id = $1 -- comment",
    "SELECT /* x */ 1 FROM my_documents WHERE user_id = $1",
    "DELETE FROM my_documents WHERE user_id = $1",
    "WITH t AS (SELECT 1) SELECT * FROM t WHERE 1 = $1",
    "SELECT * FROM my_documents",
    "SELECT * FROM my_documents WHERE created_at > now() AND user_id = $1 AND note = 'update'",
])
def test_guard_rejects(sql):
    with pytest.raises(GuardError):
        validate_sql(sql)


def test_guard_accepts_and_caps():
    sql = "  select count(*) AS total from my_documents where user_id = $1"
    validate_sql(sql)
    assert prepare_safe_query(sql).endswith("LIMIT 1000")
    assert "LIMIT 5" in prepare_safe_query("SELECT 1 FROM my_documents WHERE user_id = $1 LIMIT 5")
    assert "1000" not in prepare_safe_query("SELECT 1 FROM my_documents WHERE user_id = $1 LIMIT 5")


def test_guarded_select_sees_only_the_tenant(spark, fx):
    sql = "SELECT DISTINCT user_id FROM my_documents WHERE user_id = $1 OR user_id <> $1"
    rows = guarded_select(spark, sql, 7, fx.v_documents, fx.v_document_types).collect()
    assert [r.user_id for r in rows] == [7]
    assert guarded_select(spark, sql, "", fx.v_documents, fx.v_document_types).count() == 0


@pytest.mark.parametrize("sql", [
    "SELECT filename FROM v_documents WHERE user_id = $1",
    "SELECT * FROM parquet.`/tmp/x` WHERE 1 = $1",
    "SELECT * FROM parquet.tmp WHERE 1 = $1",
    "SELECT * FROM spark_catalog.default.v_documents WHERE 1 = $1",
    "SELECT * FROM my_documents WHERE user_id = $1 AND id IN (SELECT id FROM v_documents)",
    "SELECT (SELECT max(id) FROM v_documents) FROM my_documents WHERE user_id = $1",
    "SELECT * FROM (WITH c AS (SELECT * FROM v_documents) SELECT * FROM c) z WHERE user_id = $1",
    "SELECT * FROM (WITH v_documents AS (SELECT * FROM my_documents) SELECT 1) z, v_documents WHERE user_id = $1",
    "SELECT * FROM my_documents d JOIN documents x ON d.id = x.doc_id WHERE user_id = $1",
    "SELECT 1 FROM my_documents WHERE user_id = $1 UNION ALL SELECT id FROM v_documents",
    "SELECT * FROM IDENTIFIER('v_' || 'documents') WHERE user_id = $1",
    "SELECT * FROM range(5) WHERE id = $1",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM my_documents WHERE user_id = $1",
])
def test_guard_refuses_every_other_relation(spark, fx, sql):
    with pytest.raises(GuardError):
        guarded_select(spark, sql, 7, fx.v_documents, fx.v_document_types)


def test_guard_allows_own_expressions(spark, fx):
    sql = "SELECT * FROM (WITH c AS (SELECT id, user_id FROM my_documents) SELECT count(*) AS n FROM c WHERE user_id = $1) z"
    n = guarded_select(spark, sql, 7, fx.v_documents, fx.v_document_types).first().n
    assert n == fx.v_documents.filter("user_id = 7").count()
    before = set(t.name for t in spark.catalog.listTables())
    guarded_select(spark, sql, 7, fx.v_documents, fx.v_document_types, max_rows=1)
    assert set(t.name for t in spark.catalog.listTables()) == before


def test_two_tenants_at_once(spark, fx):
    from concurrent.futures import ThreadPoolExecutor
    sql = "SELECT DISTINCT user_id FROM my_documents WHERE user_id = $1 OR true"

    def run(tenant):
        return tenant, [r.user_id for r in guarded_select(spark, sql, tenant, fx.v_documents, fx.v_document_types).collect()]

    with ThreadPoolExecutor(4) as pool:
        assert all(rows in ([], [t]) for t, rows in pool.map(run, [7, 8, 10, 11] * 2))


def _eval(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_format_bytes(spark):
    vals = [(0,), (1,), (1023,), (1024,), (1280,), (1536,), (1048576,), (15 * 1024 * 1024 + 1,)]
    assert _eval(spark, vals, "b bigint", R.format_bytes("b")) == [
        "0 B", "1 B", "1023 B", "1 KB", "1.3 KB", "1.5 KB", "1 MB", "15 MB"]


def test_number_and_dates_es(spark):
    assert _eval(spark, [(1234567.0,), (12.0,), (1234.5,)], "x double", R.format_number_es("x")) == [
        "1.234.567", "12", "1.234,5"]
    d = [(dt.datetime(2024, 3, 5, 10, 0),)]
    assert _eval(spark, d, "t timestamp_ntz", R.format_date_es("t")) == ["5 de marzo de 2024"]
    now = "2024-03-05 12:00:00"
    rows = [(dt.datetime(2024, 3, 5, 11, 59, 30),), (dt.datetime(2024, 3, 5, 11, 15),), (dt.datetime(2024, 3, 5, 1),),
            (dt.datetime(2024, 3, 1, 12),), (dt.datetime(2024, 2, 1, 12),)]
    from pyspark.sql import functions as F
    out = _eval(spark, rows, "t timestamp_ntz", R.relative_time("t", F.lit(now).cast("timestamp_ntz")))
    assert out == ["Hace un momento", "Hace 45 min", "Hace 11h", "Hace 4d", "01 feb"]


def test_labels(spark):
    names = [("a.PDF",), ("b.jpeg",), ("noext",), ("c.zip",), ("",)]
    assert _eval(spark, names, "f string", R.file_type_label("f")) == ["PDF", "Imagen JPEG", "NOEXT", "ZIP", "Archivo"]
    assert _eval(spark, [("pending_confirmation",), ("docsUsedThisPeriod",)], "c string", R.column_label("c")) == [
        "pending confirmation", "docs used this period"]
    st = [("completed",), ("queued",), ("odd",)]
    assert _eval(spark, st, "s string", R.status_label("s")) == ["Completo", "En cola", "odd"]
    assert _eval(spark, st, "s string", R.status_label("s", "storage")) == ["Procesado", "queued", "odd"]
