"""Prompts, packing, readers of replies, groups merged across calls."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from papyra.operators import model as MD
from papyra.operators import prompts as P
from papyra.plans import jobs as K


def _listed(prompt):
    return re.findall(r"(?m)^\d+\. (.*)$", prompt)


def test_packed_slices(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < .8 else "b", i, rng.randrange(1, 40)) for i in range(3000)] + [("c", 1, 900)]
    df = spark.createDataFrame(rows, "g string, at long, w long").repartition(5)
    got = P.packed(df, "g", ["at"], F.col("w"), 500).collect()
    want, total = {}, {}
    for g, at, w in sorted(rows):
        want[g, at] = total.get(g, 0)
        total[g] = want[g, at] + w
    assert {(r.g, r["at"]): r._start for r in got} == want and {r.g: r._total for r in got} == total


def test_homologate_merges_across_calls(spark):
    """A model that sees one call at a time and only joins neighbours: chains of
    names meet through the shifted calls and the rounds."""
    stems = [f"tipo {i:03d}" for i in range(60)]
    names = [(u, f"{s} v{j}") for u in (1, None) for s in stems for j in range(6)] + [(2, "solo"), (2, None), (1, "tipo 001 v1")]
    budgets = []

    def model(prompt):
        budgets.append(len(prompt))
        groups = {}
        for n in _listed(prompt):
            groups.setdefault(" ".join(n.split()[:2]), []).append(n)
        return json.dumps({"groups": groups})
    df = spark.createDataFrame(names, "user_id long, name string")
    out = P.homologate_with_model(df, model, budget=200).collect()
    assert len(out) == 2 * 360 + 1 and len({(r.user_id, r.variant) for r in out}) == len(out)
    assert all(r.canonical == " ".join(r.variant.split()[:2]) for r in out)


def test_homologate_failed_and_invented(spark):
    def model(prompt):
        if "roto" in prompt:
            raise ValueError("x")
        return 'Claro: {"groups": {"Factura": ["Factura movil", "Invento"], "": ["Boleta"], "Otra": "Nota",}}'
    df = spark.createDataFrame([(1, "Factura movil"), (1, "Factura"), (1, "Boleta"), (1, "Nota"), (2, "roto"), (2, "Factura movil")],
                               "user_id long, name string")
    out = {(r.user_id, r.variant): r.canonical for r in P.homologate_with_model(df, model).collect()}
    assert set(out) == {(1, "Factura movil"), (1, "Factura"), (1, "Boleta"), (1, "Nota"), (2, "roto"), (2, "Factura movil")}
    assert out[2, "roto"] == "roto" and out[2, "Factura movil"] == "Factura movil" and out[1, "Boleta"] == "Boleta"
    assert P.homologate_with_model(df.limit(0), model).collect() == []


CATALOGUE = [(1, 7, "Venta", "", "folio", "Folio", "string", 1, True), (1, 7, "Venta", "", "total", None, "number", 2, False)]
CAT_SCHEMA = "user_id long, type_id long, type_name string, description string, name string, label string, type string, position int, required boolean"


def test_extract_conforms(spark):
    cat = spark.createDataFrame(CATALOGUE, CAT_SCHEMA)
    docs = spark.createDataFrame([(1, 1, 7, "uno"), (2, 1, 7, None), (3, 1, 7, "roto"), (4, 2, 7, "ajeno"), (5, 1, 7, "uno")],
                                 "doc_id long, user_id long, type_id long, text string")
    prompts = {r.doc_id: r.prompt for r in P.extract_prompts(docs, cat).collect()}
    assert set(prompts) == {1, 2, 3, 5} and prompts[1].endswith("Document text:\nuno") and prompts[2].endswith("Document text:\n")
    assert "- folio (string, req): Folio\n- total (number): total\n" in prompts[1]

    def model(prompt):
        if prompt.endswith("roto"):
            return "nada"
        return """```json
{'summary': 'S', 'fields': [{'name': 'total', 'value': 1234.5}, {'name': 'otro', 'value': 'x'}, {'value': 'y'}]}
```"""
    values, summaries = P.extract_with_model(docs, cat, model)
    got = {}
    for r in values.orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append((r.field, r.value))
    assert set(got) == {1, 2, 3, 5} and all([f for f, _ in v] == ["folio", "total"] for v in got.values())
    assert got[3] == [("folio", None), ("total", None)]
    errors = {r.doc_id: r.error for r in summaries.collect()}
    assert errors[1] == errors[2] and errors[3] == "La respuesta no es JSON"


def test_infer_reads_names_and_fields(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "doc_id long, text string")

    def model(prompt):
        if prompt.endswith(":\na"):
            return '{"inferred_type": " Acta ", "confidence": 0.8, "summary": "s", "fields": [{"name": "monto", "type": "currency", "label": "Monto", "value": {"n": 1}}]}'
        if prompt.endswith(":\nb"):
            raise RuntimeError("503")
        return '{"inferred_type": "", "fields": "ninguno"}'
    types, fields = P.infer_with_model(docs, model)
    got = {r.doc_id: (r.inferred_type, r.confidence, r.error) for r in types.collect()}
    assert got == {1: ("Acta", 0.8, None), 2: (None, None, "RuntimeError: 503"), 3: (None, None, None)}
    assert [tuple(r) for r in fields.collect()] == [(1, "monto", "number", "Monto", '{"n":1}')]


@pytest.mark.parametrize("budget", [60, 5000])
def test_consolidate(spark, budget):
    rows = [(1, "Venta", d, f"campo_{k:02d}", "currency" if k % 2 else "texto") for k in range(40) for d in range(40 - k)]
    fields = spark.createDataFrame(rows + [(2, "Nota", 1, "roto", "date")], "user_id long, type_name string, doc_id long, name string, type string")

    def model(prompt):
        names = re.findall(r"(?m)^- (\S+) \(", prompt)
        if "roto" in names:
            raise ValueError("x")
        keep = [n for n in names if not n.endswith("3")]
        return json.dumps({"consolidatedFields": [{"name": n, "label": n.upper(), "type": "date" if n == "campo_00" else "number"} for n in keep]
                           + [{"name": "inventado"}]})
    out = P.consolidate_with_model(fields, model, budget=budget).orderBy("user_id", "position").collect()
    venta = [r for r in out if r.user_id == 1]
    want = [f"campo_{k:02d}" for k in range(40) if k % 10 != 3][:30]
    assert [r.name for r in venta] == want and [r.position for r in venta] == list(range(1, 31))
    assert venta[0].type == "date" and venta[0].label == "CAMPO_00" and venta[0].required and not venta[-1].required
    assert [(r.name, r.type, r.label) for r in out if r.user_id == 2] == [("roto", "date", "roto")]


def test_classify_reply_contract(spark):
    cat = spark.createDataFrame(CATALOGUE + [(2, 9, "Nota", "", "n", "N", "string", 1, False)], CAT_SCHEMA)
    replies = {"a": '{"matchedTypeId": 7, "confidence": 0.9, "isOthers": false}',
               "b": '{"matchedTypeName": "venta", "confidence": 0.9}',
               "c": '{"matchedTypeId": 9, "confidence": 0.9, "inferredType": "Acta"}',
               "d": '{"matchedTypeName": "Venta", "confidence": 0.9, "isOthers": true, "inferredType": "Recibo"}',
               "e": '{"matched_type_name": "Venta", "confidence": 0.3, "inferred_type": "Guia"}'}
    docs = spark.createDataFrame([(i, 1, t) for i, t in enumerate(replies)], "doc_id long, user_id long, text string")
    prompts = MD.classify_prompts(docs, cat, reply_threshold=0.5).collect()
    assert all('1. "Venta" [id=7]: ' in p.prompt and "below 0.5" in p.prompt and "Nota" not in p.prompt for p in prompts)
    out = {r.doc_id: (r.best_type_id, r.is_others, r.answer) for r in MD.classify_with_model(docs, cat, lambda p: replies[p[-1]]).collect()}
    assert out == {0: (7, False, "Venta"), 1: (7, False, "venta"), 2: (None, True, "Acta"), 3: (None, True, "Recibo"), 4: (None, True, "Guia")}


def test_jobs_keep_answers(spark, fx, tmp_path):
    log = tmp_path / "calls"

    def model(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        return '{"matchedTypeName": "Venta", "confidence": 0.9}'
    up = K.uploads_from_documents(fx.v_labeled_documents).filter("doc_id < 20")
    first = K.process_documents(up, fx.v_type_catalogue, model=model, store=str(tmp_path / "s")).collect()
    calls = log.read_text()
    again = K.process_documents(up, fx.v_type_catalogue, model=model, store=str(tmp_path / "s")).collect()
    assert sorted(first) == sorted(again) and log.read_text() == calls != ""
