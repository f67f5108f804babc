"""Hand-made edge rows for the operators (the reference has no unit tests;
these follow the cases listed for each operator)."""

import datetime as dt

from pyspark.sql import functions as F

from papyra.functions import fields as H
from papyra.functions import json_repair as J
from papyra.functions import text as X
from papyra.operators import matching as M
from papyra.operators import model as MD
from papyra.operators import stats as S
from papyra.operators import windows as W
from papyra.plans import jobs as K
from papyra.sources import tables as TB


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_parse_model_json_edges(spark):
    rows = [("{\"url\": \"http://x.y/z\", \"a\": 1}",),           # URL inside a value
            ("pre {\"a\": {\"b\": {\"c\": 2}}} post",),              # nested braces
            ("{\"a\": 1} and {\"b\": 2}",),                          # two objects: greedy span fails
            ("```json\n{\"a\": [1, 2,],}\n```",),                    # fence + trailing commas
            ("",), (None,)]
    ref = _one(spark, rows, "t string", F.to_json(J.parse_model_json("t", mode="reference")))
    safe = _one(spark, rows, "t string", F.to_json(J.parse_model_json("t")))
    assert ref[0] is None  # '//' stripping breaks the URL, as in the original
    assert safe[0] == '{"a":1,"url":"http://x.y/z"}'
    assert ref[1] == '{"a":{"b":{"c":2}}}'
    assert ref[2] is None
    assert ref[3] == '{"a":[1,2]}'
    assert ref[4] is None and ref[5] is None


def test_repair_python_dict_edges(spark):
    rows = [("{'a': 'it''s'}",), ("{'a': None, 'b': True}",), ("{\"ok\": 1}",), ("",), (None,)]
    out = _one(spark, rows, "t string", F.to_json(J.repair_python_dict("t")))
    assert out[1] == '{"a":null,"b":true}'
    assert out[2] == '{"ok":1}'
    assert out[3] is None and out[4] is None
    plain = _one(spark, [("{'a': None}",)], "t string", F.to_json(J.repair_python_dict("t", keywords=False)))
    assert plain == [None]


def test_slugify_edges(spark):
    rows = [("Factura de Venta",), ("Índice Ñandú",), ("--a--",), ("¡¿!!",), ("Straße",)]
    assert _one(spark, rows, "t string", X.slugify("t")) == ["factura-de-venta", "indice-nandu", "a", "", "stra-e"]


def test_is_others_edges(spark):
    rows = [(None, 0.7), (None, None), (None, 0.0), (True, 0.99), (None, 0.69)]
    out = _one(spark, rows, "f boolean, c double", H.is_others("f", "c"))
    assert out == [False, False, True, True, True]
    assert H.effective_threshold(0) == 0.7


def test_text_quality_edges(spark):
    short = "1" * 99
    five = "\n".join(["valor 12"] + ["texto"] * 4) + " " * 100  # exactly 20 % of lines
    crlf = "linea 2024-01-01\r\n" + "abc\r\n" * 3 + "x" * 100
    flat = "a" * 150
    out = _one(spark, [(short,), (five,), (crlf,), (flat,)], "t string", X.text_quality("t"))
    assert out == [False, True, True, False]


def test_add_month_and_roll_period(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 31),)], "ts timestamp_ntz")
    assert d.select(H.add_month("ts")).first()[0] == dt.datetime(2024, 2, 29)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    subs = spark.createDataFrame(
        [(1, "pro", 5, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)),
         (2, "starter", 7, dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1))],
        "user_id bigint, plan string, docs_used_this_period int, period_start timestamp_ntz, period_end timestamp_ntz")
    out = {r.user_id: r for r in W.roll_period(users, subs, "2024-02-01 00:00:00").collect()}
    assert out[1].action == "unchanged"           # now == end is not expired (strict >)
    assert out[2].action == "unchanged"
    assert out[3].action == "created" and out[3].plan == "free"


def test_partial_match_edges(spark):
    items = spark.createDataFrame([(1, 10, "fact"), (2, 10, ""), (3, 10, "Guia")],
                                  "id bigint, user_id bigint, classified_name string")
    types = spark.createDataFrame([(5, 10, "Factura Venta"), (4, 10, "Factura Compra"), (9, 11, "Guia")],
                                  "id bigint, user_id bigint, name string")
    out = {r.id: r for r in M.match_type_partial(items, types).collect()}
    assert out[1].match_type_id == 4          # prefix of two names → lowest id
    assert out[2].match_type_id is None       # an empty answer names no type
    assert out[3].match_type_id is None       # same name, other tenant


def test_usage_in_period_bounds(spark):
    subs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)), (2, None, None)],
                                 "user_id bigint, period_start timestamp_ntz, period_end timestamp_ntz")
    docs = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1)), (2, 1, dt.datetime(2024, 2, 1)),
                                  (3, 2, dt.datetime(1990, 1, 1))], "id bigint, user_id bigint, created_at timestamp_ntz")
    out = {r.user_id: r.docs_in_period for r in M.usage_in_period(subs, docs).collect()}
    assert out == {1: 1, 2: 1}


def test_batch_status_edges(spark):
    docs = spark.createDataFrame([(1, 7, "queued"), (2, 7, "queued"), (3, 8, "processing")],
                                 "id bigint, user_id bigint, status string")
    req = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (99, 7)], "id bigint, user_id bigint")
    r = S.batch_status(req, docs).collect()
    assert len(r) == 1 and r[0].total == 2 and r[0].all_done  # queued never blocks; foreign and unknown ids ignored


def test_consolidate_schema_edges(spark):
    rows = [(d, "T", "half", "string", "x") for d in (1, 2)]
    rows += [(d, "T", "all", "number", "1") for d in (1, 2, 3, 4)]
    rows += [(1, "T", "all", "number", "2")]                      # duplicate inside one document
    rows += [(1, "T", f"f{i:02d}", "string", "v") for i in range(31)]
    f = spark.createDataFrame(rows, "doc_id bigint, type_name string, name string, type string, value string")
    out = {r.name: r for r in S.consolidate_schema(f).collect()}
    assert len(out) == 30
    assert out["all"].frequency == 1.0 and out["half"].required  # exactly 50 % is required


def test_schemas_of_two_tenants_stay_apart(spark):
    rows = [(1, 10, "Venta", "total", "number", "1"), (2, 10, "Venta", "fecha", "date", "2024-01-01"),
            (3, 20, "Venta", "placa", "string", "x")]
    f = spark.createDataFrame(rows, "doc_id bigint, user_id bigint, type_name string, name string, type string, value string")
    keys = ("user_id", "type_name")
    schema = S.consolidate_schema(f, keys)
    assert {(r.user_id, r.name) for r in schema.collect()} == {(10, "total"), (10, "fecha"), (20, "placa")}
    out = {(r.doc_id, r.field): r.value for r in MD.conform_fields(None, schema, f, type_col=keys).collect()}
    assert out == {(1, "total"): "1", (1, "fecha"): None, (2, "total"): None, (2, "fecha"): "2024-01-01", (3, "placa"): "x"}
    types = spark.createDataFrame([(5, 10, "Venta"), (6, 20, "Venta")], "id bigint, user_id bigint, name string")
    docs = spark.createDataFrame([(1, 10, 5)], "id bigint, user_id bigint, document_type_id bigint")
    text = {r.user_id: r.context for r in MD.schema_context(types, docs, schema).collect()}
    assert "placa" not in text[10] and "total" not in text[20]


def test_upsert_keeps_the_latest(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", None)], "id bigint, v string, updated_at int")
    new = spark.createDataFrame([(1, "x", 4), (2, "y", 5), (2, "z", 6), (3, "w", 1), (9, "n", 1)], "id bigint, v string, updated_at int")
    assert {r.id: r.v for r in TB.upsert_documents(base, new).collect()} == {1: "a", 2: "z", 3: "w", 9: "n"}


def test_repeat_requests(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(3, "h", base), (2, "h", base), (1, "h", base + dt.timedelta(hours=1)), (4, "g", base), (5, None, base),
            (6, None, base + dt.timedelta(seconds=2))]
    req = spark.createDataFrame(rows, "event_id bigint, content_hash string, ts timestamp_ntz")
    out = {r.event_id: (r.repeated, r.since_first_ms) for r in W.repeat_requests(req).collect()}
    assert out == {2: (False, 0), 3: (True, 0), 1: (True, 3_600_000), 4: (False, 0), 5: (False, 0), 6: (True, 2000)}


def test_dedup_keeps_rows_without_hash(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "doc_id bigint, content_hash string")
    out = {r.doc_id: r.kept for r in W.dedup_by_content(d).collect()}
    assert out == {1: True, 2: False, 3: True, 4: True}


def test_numbers_keep_their_digits(spark):
    cases = {"1.23456": "1.23456", "1,234.56": "1234.56", "1.234,56": "1234.56", "$ 37,50": "37.50", "1.234.567": "1234567",
             "1,234,567": "1234567", "-5": "-5", "12": "12", "1.2,3.4": None, "abc": None, "5-": None, "": None}
    df = spark.createDataFrame([(k, "number") for k in cases], "v string, t string")
    assert {r.v: r.x for r in df.withColumn("x", MD.convert_value("v", "t")).collect()} == cases


def test_long_labels_are_read(spark):
    label = "etiqueta " * 25
    d = spark.createDataFrame([(1, f"{label}: valor\nsin nada")], "doc_id bigint, text string")
    assert [(r.label_key, r.raw_value) for r in MD.label_lines(d).collect()] == [(label.strip(), "valor")]


def test_an_empty_name_matches_no_type(spark):
    types = spark.createDataFrame([(1, 10, "Venta"), (2, 10, "")], "id bigint, user_id bigint, name string")
    items = spark.createDataFrame([(1, 10, ""), (2, 10, " venta "), (3, 10, "ventas del mes"), (4, 10, None), (5, 11, "venta")],
                                  "id bigint, user_id bigint, classified_name string")
    out = {r.id: (r.match_type_id, r.match_kind) for r in M.match_type_partial(items, types).collect()}
    assert out == {1: (None, None), 2: (1, "exact"), 3: (1, "partial"), 4: (None, None), 5: (None, None)}


def test_reprocess_keeps_documents_without_upload(spark, fx):
    up = K.uploads_from_documents(fx.v_labeled_documents).filter("doc_id < 40")
    table = K.process_documents(up, fx.v_type_catalogue)
    ids = table.select("doc_id").filter("doc_id IN (1, 2, 3)")
    out = K.reprocess(table, up.filter("doc_id <> 2"), ids, fx.v_type_catalogue, threshold=0.5)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in table.collect())


def test_jobs_with_a_model(spark, fx):
    calls = {"Folio: 1": '{"inferred_type": "VENTA", "confidence": 0.9}', "raro": '{"inferred_type": "Bitacora", "confidence": 0.99}',
             "dudoso": '{"inferred_type": "Venta", "confidence": 0.2}', "roto": "no es json"}

    def model(prompt):
        return next(v for k, v in calls.items() if prompt.endswith(k))

    texts = list(calls) + ["nada"]
    up = spark.createDataFrame([(i, 1, 1, f"a{i}.pdf", 100, "application/pdf", t) for i, t in enumerate(texts)],
                               "doc_id bigint, user_id bigint, batch_id bigint, filename string, size_bytes bigint, mime string, text string")
    out = {r.doc_id: r for r in K.process_documents(up, fx.v_type_catalogue, model=model).collect()}
    assert [out[i].status for i in range(5)] == ["completed", "completed", "completed", "error", "error"]
    assert (out[0].document_type_name, out[0].document_type_id, out[0].populated) == ("Venta", 1, 1)
    assert out[1].is_others and out[1].inferred_type == "Bitacora" and out[2].is_others
    assert out[3].gate_error == "La respuesta no es JSON" and "StopIteration" in out[4].gate_error
    _, report = K.infer_types(up.filter("doc_id < 2"), fx.v_type_catalogue, model=model)
    assert {(r.type_name, r.is_new) for r in report.collect()} == {("Venta", False), ("Bitacora", True)}


def test_documents_wait_where_there_is_no_type(spark, fx):
    up = K.uploads_from_documents(fx.v_labeled_documents).filter("doc_id < 24")
    none = {r.status for r in K.process_documents(up, fx.v_type_catalogue.limit(0)).collect()}
    assert none == {"pending_confirmation", "error"}
    own = fx.v_type_catalogue.withColumn("user_id", F.lit(1).cast("bigint"))
    for r in K.process_documents(up, own).collect():
        assert r.status == "error" or (r.status == "completed") == (r.user_id == 1)


def test_run_ends_with_its_last_stage(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, 7, base, "ocr", 5000, 0.1), (2, 7, base + dt.timedelta(seconds=2), "save", 1500, None)]
    d = spark.createDataFrame(rows, "event_id bigint, run_id bigint, ts timestamp_ntz, stage string, duration_ms bigint, cost_usd double")
    assert [r.total_duration_ms for r in S.run_metrics(d).collect()] == [5000]


def test_merge_groups_edges(spark):
    groups = spark.createDataFrame([(1, "Factura", 2), (1, "Factura Movil", 3), (1, "Boleta", 1)],
                                   "user_id bigint, group_name string, doc_count bigint")
    mapping = spark.createDataFrame([(1, "Factura Movil", "Factura"), (1, "Factura Movil", "Boleta")],
                                    "user_id bigint, variant string, canonical string")
    out = {r.merged_name: r for r in MD.merge_groups(groups, mapping).collect()}
    # the variant listed twice goes to the smallest canonical; groups union, never overwrite
    assert out["Boleta"].doc_count == 4 and out["Factura"].doc_count == 2


def test_conform_fields_edges(spark):
    schema = spark.createDataFrame([("T", "total", "number", 1), ("T", "fecha", "date", 2)],
                                   "type_name string, name string, type string, position int")
    docs = spark.createDataFrame([(1, "T"), (2, "T")], "doc_id bigint, type_name string")
    vals = spark.createDataFrame([(1, "total", "12,50"), (1, "extra", "x"), (1, "fecha", "no es fecha")],
                                 "doc_id bigint, name string, value string")
    out = sorted((r.doc_id, r.position, r.field, r.value) for r in MD.conform_fields(docs, schema, vals).collect())
    assert out == [(1, 1, "total", "12.50"), (1, 2, "fecha", None), (2, 1, "total", None), (2, 2, "fecha", None)]


def test_homologate_every_name_once(spark):
    names = spark.createDataFrame([("Orden de Compra",), ("orden compra",), ("ORDEN DE COMPRA",), ("Factura",)],
                                  "name string")
    out = MD.homologate_names(names).collect()
    assert len(out) == 4 and len({r.variant for r in out}) == 4
    canon = {r.variant: r.canonical for r in out}
    assert canon["orden compra"] == canon["Orden de Compra"] == canon["ORDEN DE COMPRA"]


def test_model_stage_isolates_failures(spark):
    rows = spark.createDataFrame([(1, "x" * 150), (2, "short"), (3, "x" * 150)], "doc_id bigint, prompt string")
    out = {r.doc_id: r for r in MD.model_stage(rows, MD.demo_model).collect()}
    assert out[2].response is None and "texto insuficiente" in out[2].error
    assert out[1].response == out[3].response and out[1].error is None


def test_lexical_classify_per_tenant(spark):
    cat = spark.createDataFrame(
        [(1, 1, "Factura", 1, "total", "Total", "number"), (1, 2, "Orden", 1, "proveedor", "Proveedor", "string"),
         (2, 3, "Recibo", 1, "total", "Total", "number")],
        "user_id bigint, type_id int, type_name string, position int, name string, label string, type string")
    docs = spark.createDataFrame([(10, 1, "Total: 5"), (11, 2, "Total: 7\nProveedor: X"), (12, 2, "nada")],
                                 "doc_id bigint, user_id bigint, text string")
    out = {r.doc_id: r for r in MD.lexical_classify(docs, cat, tenant_col="user_id").collect()}
    assert out[10].best_type_name == "Factura" and out[11].best_type_name == "Recibo"  # own catalogue only
    assert out[12].best_type_id is None and out[12].is_others


def test_prompt_lists_only_the_tenants_types(spark):
    cat = spark.createDataFrame([(1, 7, "Invoice", "bills", "Total", 2), (1, 7, "Invoice", "bills", "Date", 1),
                                 (1, 9, "Memo", None, "To", 1), (2, 8, "Letter", "", "From", 1)],
                                "user_id long, type_id long, type_name string, description string, label string, position int")
    docs = spark.createDataFrame([(10, 1, "a"), (11, 2, "b"), (12, 3, "c"), (13, None, None)], "doc_id long, user_id long, text string")
    frame = "Classify this document. Available types:\n%s\n\nDocument text:\n%s"
    got = {r.doc_id: r.prompt for r in MD.classify_prompts(docs, cat).collect()}
    assert got == {10: frame % ('1. "Invoice": bills | Campos: Date, Total\n2. "Memo": - | Campos: To', "a"),
                   11: frame % ('1. "Letter": - | Campos: From', "b"), 12: frame % ("", "c"), 13: frame % ("", "")}
    shared = MD.classify_prompts(docs, cat.filter("user_id = 2").drop("user_id")).collect()
    assert {r.prompt for r in shared} == {frame % ('1. "Letter": - | Campos: From', t) for t in ("a", "b", "c", "")}


def test_utc_timestamp_offsets_and_bad_texts(spark):
    from papyra.functions.fields import utc_timestamp
    texts = {"2024-01-01T10:00:00-03:00": "2024-01-01 13:00:00", "2024-01-01T10:00:00+03:00": "2024-01-01 07:00:00",
             "2024-01-01T10:00:00Z": "2024-01-01 10:00:00", "2024-01-01T10:00:00": "2024-01-01 10:00:00",
             "2024-01-01T10:00:00.5-01:00": "2024-01-01 11:00:00.5", "no date": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", utc_timestamp("t").cast("string").alias("u")).collect()} == texts


def test_inference_report_keeps_tenants_apart(spark):
    fields = spark.createDataFrame([(1, 1, "Venta", "a"), (1, 1, "Venta", "b"), (2, 2, "Venta", "a"), (3, 2, "Nota", "c")],
                                   "doc_id long, user_id long, type_name string, name string")
    types = spark.createDataFrame([(7, 1, "Venta"), (5, 1, "Venta"), (9, 3, "Nota")], "id long, user_id long, name string")
    out = {(r.user_id, r.type_name): (r.type_id, r.field_count, r.sample_count) for r in S.inference_report(fields, types).collect()}
    assert out == {(1, "Venta"): (5, 2, 1), (2, "Venta"): (None, 1, 1), (2, "Nota"): (None, 1, 1), (None, None): (None, 3, 3)}
