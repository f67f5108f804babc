"""File-based sources and sinks: object listings, ingestion, exports,
typed layout and pasted catalogues."""

import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from papyra.functions.fields import progress_percent
from papyra.operators.matching import new_types_from_assignments, resolve_assignments
from papyra.sources import catalogue as CAT
from papyra.sources import objects as O
from papyra.sources import tables as TB


def _tree():
    root = tempfile.mkdtemp(prefix="papyra-objs-")
    files = {"7/originals/a.pdf": b"%PDF-1", "7/extracted/a.txt": b"hello", "7/tipos/factura/b.png": b"\x89PNG..",
             "8/extracted/c.txt": b"abc", "8/originals/d.jpg": b"jpegdata"}
    for k, v in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, k)), exist_ok=True)
        with open(os.path.join(root, k), "wb") as fh:
            fh.write(v)
    return root, files


def test_read_list_and_audit_objects(spark):
    root, files = _tree()
    objs = O.read_objects(spark, root)
    got = {r.key: r.size_bytes for r in objs.collect()}
    assert got == {k: len(v) for k, v in files.items()}
    listed = {r.filename for r in O.list_files(objs, 7).collect()}
    assert listed == {"a.pdf", "a.txt", "b.png"}
    assert {r.filename for r in O.list_files(objs, 7, "tipos").collect()} == {"b.png"}
    audit = {r.tenant: (r.objects, r.bytes) for r in O.audit_extracted_objects(objs).collect()}
    assert audit == {"7": (1, 5), "8": (1, 3)}


def test_ingest_files_hashes_content(spark):
    root, files = _tree()
    rows = {r.filename: r for r in O.ingest_files(spark, root).collect()}
    assert rows["a.pdf"].mime == "application/pdf" and rows["d.jpg"].mime == "image/jpeg"
    assert rows["a.txt"].content_hash == hashlib.sha256(b"hello").hexdigest()
    assert rows["b.png"].size_bytes == len(files["7/tipos/factura/b.png"])


def test_export_and_typed_layout_writers(spark):
    conformed = spark.createDataFrame([(1, "T", "total", "1.00"), (1, "T", "fecha", None), (2, "T", "total", "2.00")],
                                      "doc_id bigint, type_name string, field string, value string")
    wide = TB.export_fields(conformed, ["fecha", "total"])
    out = tempfile.mkdtemp(prefix="papyra-export-")
    TB.write_export(wide, out, "csv")
    back = spark.read.option("header", True).csv(out)
    assert sorted(back.columns) == ["doc_id", "fecha", "total", "type_name"] and back.count() == 2
    docs = spark.createDataFrame([(1, 7, "a.pdf", "Factura de Venta"), (2, 7, "a.pdf", "Factura de Venta")],
                                 "id bigint, user_id bigint, filename string, document_type_name string")
    laid = O.typed_layout(docs)
    assert all(r.collision for r in laid.collect())
    path = tempfile.mkdtemp(prefix="papyra-layout-")
    O.write_typed_layout(laid, path)
    assert os.path.isdir(os.path.join(path, "user_id=7", "type_slug=factura-de-venta"))


def test_catalogue_files_and_schema(spark):
    root = tempfile.mkdtemp(prefix="papyra-cat-")
    with open(os.path.join(root, "Factura.tsv"), "w") as fh:
        fh.write("numero\tNúmero\ttexto\tsí\tNúmero de factura\n\n  \nfecha\t\tFecha\t1\ntotal\tTotal\tNUMERO\tno\t\n")
    fields = CAT.read_catalogue_files(spark, root)
    rows = [(r.type_name, r.position, r.name, r.label, r.type, r.required, r.description)
            for r in fields.orderBy("position").collect()]
    assert rows == [("Factura", 1, "numero", "Número", "string", True, "Número de factura"),
                    ("Factura", 2, "fecha", "fecha", "date", True, ""),
                    ("Factura", 3, "total", "Total", "number", False, "")]
    sch = CAT.field_schema(fields).first()
    assert [f["name"] for f in sch.field_schema.fields] == ["numero", "fecha", "total"]


def test_new_types_and_progress(spark):
    docs = spark.createDataFrame([(1, 7), (2, 7)], "id bigint, user_id bigint")
    types = spark.createDataFrame([(70, 7, "Factura")], "id bigint, user_id bigint, name string")
    assign = spark.createDataFrame([(1, 7, "Boleta", None), (2, 7, "Boleta", None), (9, 7, "X", None)],
                                   "document_id bigint, user_id bigint, type_name string, type_id bigint")
    r = resolve_assignments(assign, docs, types)
    assert [tuple(x) for x in new_types_from_assignments(r).collect()] == [(7, "Boleta")]
    p = spark.createDataFrame([(1, 3), (0, 0)], "d int, t int").select(progress_percent("d", "t").alias("p"))
    assert [x.p for x in p.collect()] == [33, 0]


def test_typed_export_is_a_table_per_type(spark, tmp_path):
    """Each folder reads with its own type's columns, nulls and odd names kept;
    documents of a hot type are all there."""
    rows = [(d, 1, "Venta", 1, "folio", f'F"{d}') for d in range(300)] + [(d, 1, "Venta", 2, "total", None if d % 2 else "1.5") for d in range(300)]
    rows += [(900, 2, "Venta", 1, "doc_id", "x"), (900, 2, "Venta", 2, "a", "ñ\n"), (901, 2, "Nota/é", 1, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, user_id long, type_name string, position int, field string, value string")
    path = str(tmp_path / "export")
    TB.write_typed_export(df.repartition(5), path)
    hot = spark.read.json(f"{path}/user_id=1/type_name=Venta")
    assert sorted(hot.columns) == ["doc_id", "folio", "total"]
    assert {(int(r.doc_id), r.folio, r.total) for r in hot.collect()} == {(d, f'F"{d}', None if d % 2 else "1.5") for d in range(300)}
    other = spark.read.json(f"{path}/user_id=2/type_name=Venta").collect()
    assert [r.asDict() for r in other] == [{"doc_id": "900", "doc_id_field": "x", "a": "ñ\n"}]
    lines = {(r.user_id, r.type_name, r.value) for r in spark.read.text(path).collect()}
    assert len(lines) == 302 and (2, "Nota/é", '{"doc_id":"901","z":null}') in lines
