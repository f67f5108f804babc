"""Line deduplication against brute force and its SQL."""

import hashlib
import re
from collections import defaultdict

import duckdb

from papyra.llm import lines, queries

from ..conftest import SF_SMALL
from . import edges

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def _expected(rows, least=5):
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[_key(x)].add(float("-inf") if i is None else i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(_key(x)) < 40 or len(holders[_key(x)]) < least
                or max(holders[_key(x)]) == (float("-inf") if i is None else i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return edges.bag(out)


def _bag(df):
    return edges.bag((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def test_edge_rows(spark):
    rows = [*edges.ROWS, (None, edges.LINE + "\nz"), (30, "\n".join([edges.LINE] * 3)), (19, edges.LINE), (30, "other\n" + edges.LINE)]
    assert _bag(lines.dedup_lines(edges.frame(spark, rows))) == _expected(rows)
    assert lines.dedup_lines(edges.frame(spark, [])).count() == 0


def test_line_held_by_most_documents(spark):
    rows = [(i, f"own line {i}\n{edges.LINE}\n{'x' * 39}\nend") for i in range(500)]
    assert _bag(lines.dedup_lines(edges.frame(spark, rows))) == _expected(rows)


def test_pipeline_form(spark):
    df = edges.frame(spark)
    got = lines.clean_documents(df)
    assert got.columns == df.columns
    expected = {(i, t): k for (i, t), (_, _, d, k) in zip(
        sorted(edges.ROWS, key=repr), [next(e for e in _expected(edges.ROWS) if e[0] == i and e[3] is not None and
                                            (e[1] == len((t or "").split("\n")))) for i, t in sorted(edges.ROWS, key=repr)], strict=True) if d}
    rows = got.collect()
    assert len(rows) == len(edges.ROWS)
    changed = [r for r in rows if (r.doc_id, r.text) not in edges.ROWS]
    assert len(changed) == len(expected) and all(r.n_chars == len(r.text) for r in changed)


def test_columns_named_like_helpers_stay(spark):
    rows = [(i, edges.LINE, "a", "b", "c") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hit_id string, _hit_row string, _dropped string")
    got = lines.clean_documents(df)
    assert got.columns == df.columns
    assert edges.bag(tuple(r) for r in got.collect()) == edges.bag((i, edges.LINE if i == 5 else "", *"abc") for i in range(6))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    cur = con.execute(queries.ORACLES["op7_line_dedup"])
    names = [d[0] for d in cur.description]
    expected = edges.bag(tuple(dict(zip(names, r, strict=True))[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256"))
                         for r in cur.fetchall())
    assert edges.bag(tuple(r) for r in queries.QUERIES["op7_line_dedup"](spark, SF_SMALL).collect()) == expected
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert expected == edges.bag((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in _expected(docs))
