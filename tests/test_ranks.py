"""Places in a total order, allocated ids, change sets: hot groups, edge
requests, plans without a window over a group."""

import json

from pyspark.sql import functions as F

from papyra.operators import ranks, windows
from papyra.plans import changes as CH

TYPES = "id long, user_id long, name string, description string, field_schema string"
DOCS = ("id long, user_id long, document_type_id long, filename string, status string, confidence_score double, "
        "inferred_type string, size_bytes long, extracted_data string, created_at timestamp_ntz")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_index_in_group_with_a_hot_group(spark):
    rows = [(7 if k % 3 else k % 5, (k * 7919) % 100_003, k) for k in range(3000)] + [(None, 1, -1), (None, 2, -2)]
    df = spark.createDataFrame(rows, "g long, t long, id long").repartition(11)
    got = {r.id: r["index"] for r in ranks.index_in_group(df, ["g"], ["t", "id"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((t, i) for h, t, i in rows if h == g)
        assert [got[i] for _, i in own] == list(range(len(own)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small rows would share a task
    try:
        runs = ranks.sorted_runs(df, ["g", "t", "id"])
        spread = {r.id: r["index"] for r in ranks.index_in_group(df, ["g"], ["t", "id"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread == got
    hot = runs.filter("g = 7").groupBy("_run").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 1500
    assert ranks.index_in_group(df.limit(0), ["g"], ["t"]).count() == 0


def test_allocated_ids_follow_the_largest(spark):
    taken = spark.createDataFrame([(41,), (12,)], "id long")
    new = spark.createDataFrame([(k % 4, f"n{k}") for k in range(50)], "user_id long, name string").repartition(6)
    for _ in range(2):
        got = {(r.user_id, r.name): r.id for r in ranks.allocate_ids(new, taken, ["user_id", "name"]).collect()}
        assert [got[k] for k in sorted(got)] == list(range(42, 92))
    assert min(r.id for r in ranks.allocate_ids(new, taken.limit(0), ["user_id", "name"]).collect()) == 1


def test_rate_audit_of_one_provider_in_one_minute(spark):
    """All calls within a minute: spread over runs, counts as by hand."""
    calls = [("ocr", k, (k * 7907) % 59_000) for k in range(2500)] + [("model", 9000 + k, k * 3001) for k in range(50)] \
        + [("idle", 9999, 5)]
    df = spark.createDataFrame(calls, "provider string, event_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = windows.rate_audit(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert "partitionBy" not in _plan(out) and "windowspecdefinition(_p" not in _plan(out)
    got = {r.event_id: (r.prev_in_window, r.gap_ms) for r in out.collect()}
    for p in ("ocr", "model", "idle"):
        own = sorted((t, i) for q, i, t in calls if q == p)
        for k, (t, i) in enumerate(own):
            assert got[i] == (sum(t - s < 60_000 for s, _ in own[:k]), t - own[k - 1][0] if k else None)


def _doc(i, user, status, name, fields, key="key_fields"):
    return (i, user, None, f"f{i}.pdf", status, 0.5, name, 1, json.dumps({"summary": f"s{i}", key: fields}), None)


def test_confirm_requests_that_meet(spark):
    """Several requests for a document, several documents for one new name,
    repeated field names, nulls, a type of another tenant."""
    f = [{"name": "total", "type": "currency", "value": "1.234,50"}, {"name": "total", "type": "string", "value": "x"},
         {"name": "fecha", "type": "datetime", "value": "3/2/2024"}]
    docs = spark.createDataFrame([_doc(1, 1, "pending_confirmation", "Nota", f), _doc(2, 1, "pending_confirmation", "Nota", []),
                                  _doc(3, 1, "pending_confirmation", None, f, "fields"), _doc(4, 1, "completed", "Nota", f),
                                  _doc(5, 2, "pending_confirmation", "Nota", f), (6, 2, None, "f", "pending_confirmation", None, "", 1, None, None),
                                  _doc(7, 1, "pending_confirmation", "Vieja", f)], DOCS)
    schema = '{"fields":[{"name":"fecha","type":"date","label":"F","required":false,"description":""}]}'
    types = spark.createDataFrame([(10, 1, "Vieja", None, schema), (20, 2, "Ajena", None, '{"fields":[]}')], TYPES)
    requests = spark.createDataFrame(
        [(1, 1, "create_type", None, None), (2, 1, "create_type", None, "Nota"), (3, 1, "create_type", None, ""),
         (4, 1, "cancel", None, None), (5, 2, "assign_type", 10, None), (6, 2, "create_type", None, None), (6, 2, "cancel", None, None),
         (7, 1, "assign_type", 10, None), (7, 1, "assign_type", 10, None), (7, 1, "create_type", None, "Otra"), (8, 1, "cancel", None, None),
         (None, 1, "cancel", None, None)], "doc_id long, user_id long, action string, type_id long, type_name string")
    change = CH.confirm_changes(requests, docs, types)
    made = {(r.user_id, r.name): r for r in change.created_types.collect()}
    assert {k: r.id for k, r in made.items()} == {(1, "Nota"): 21, (1, "Tipo Sin Nombre"): 22}
    assert [(x["name"], x["type"], x["label"]) for x in json.loads(made[1, "Nota"].field_schema)["fields"]] == [
        ("total", "number", "total"), ("fecha", "date", "fecha")]
    after, types_after = CH.apply_changes(docs, types, change)
    rows = {r.id: r for r in after.collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 7} and types_after.count() == 4
    assert {i: (rows[i].status, rows[i].document_type_id) for i in rows} == {
        1: ("completed", 21), 2: ("completed", 21), 3: ("completed", 22), 4: ("completed", None), 5: ("pending_confirmation", None),
        7: ("completed", 10)}
    assert json.loads(rows[1].extracted_data) == {"summary": "s1", "fields": [
        {"name": "total", "type": "number", "value": "1234.50"}, {"name": "fecha", "type": "date", "value": "2024-02-03"}]}
    assert json.loads(rows[7].extracted_data)["fields"] == [{"name": "fecha", "type": "date", "value": "2024-02-03"}]
    results = [(r.doc_id, r.action, r.result, r.type_id, r.low_confidence) for r in change.results.collect()]
    assert len(results) == 12 and results.count((7, "assign_type", "completed", 10, False)) == 2
    assert {(6, "cancel", "deleted", None, None), (6, "create_type", "error", None, None), (7, "create_type", "error", None, None),
            (5, "assign_type", "error", None, None), (8, "cancel", "error", None, None)} <= set(results)
    again = CH.confirm_changes(requests, after, types_after)
    assert again.created_types.count() == 0 and again.changed_documents.count() == 0 and again.deleted_documents.count() == 0


def test_confirm_with_a_callers_extraction(spark):
    docs = spark.createDataFrame([_doc(1, 1, "pending_confirmation", "A", [])], DOCS)
    types = spark.createDataFrame([(3, 1, "A", None, '{"fields":[{"name":"n","type":"number"}]}')], TYPES)
    req = spark.createDataFrame([(1, 1, "assign_type", 3, None)], "doc_id long, user_id long, action string, type_id long, type_name string")
    values = spark.createDataFrame([(1, "n", "7 kg"), (2, "n", "8")], "doc_id long, name string, value string")
    for v, low in ((None, True), (values, False)):
        change = CH.confirm_changes(req, docs, types, v)
        assert [r.low_confidence for r in change.results.collect()] == [low]
    assert json.loads(change.changed_documents.first().extracted_data)["fields"] == [{"name": "n", "type": "number", "value": "7"}]


def test_resolve_and_file_others(spark):
    docs = spark.createDataFrame([_doc(1, 1, "error", "A", [{"name": "x", "type": None, "value": "v"}]), _doc(2, 1, "completed", "A", [])], DOCS)
    types = spark.createDataFrame([(3, 1, "A", None, '{"fields":[]}')], TYPES)
    asked = spark.createDataFrame([(1, 1, "B", None), (1, 1, "A", None), (2, 1, "B", 99), (9, 1, "C", None), (2, 2, "C", None)],
                                  "document_id long, user_id long, type_name string, type_id long")
    change = CH.resolve_changes(asked, docs, types)
    assert {(r.user_id, r.name, r.id) for r in change.created_types.collect()} == {(1, "B", 4)}
    assert {r.id: (r.document_type_id, r.status) for r in change.changed_documents.collect()} == {1: (4, "completed"), 2: (4, "completed")}
    assert {(r.document_id, r.status) for r in change.results.collect()} == {(1, "completed"), (2, "completed"), (9, "error"), (2, "error")}
    done = spark.createDataFrame([(1, 1, "completed", None, True), (2, 1, "completed", None, True), (3, 2, "completed", None, True),
                                  (4, 3, "completed", 3, False), (5, 4, "error", None, None)],
                                 "doc_id long, user_id long, status string, document_type_id long, is_others boolean")
    own = types.unionByName(spark.createDataFrame([(8, 2, CH.OTHERS_TYPE_NAME, None, "{}")], TYPES))
    filed = CH.file_others(done, own)
    assert [(r.user_id, r.id) for r in filed.created_types.collect()] == [(1, 9)]
    table, after = CH.apply_changes(done, own, filed, "doc_id", "doc_id")
    assert {r.doc_id: r.document_type_id for r in table.collect()} == {1: 9, 2: 9, 3: 8, 4: 3, 5: None}
    assert CH.file_others(done, after).created_types.count() == 0
