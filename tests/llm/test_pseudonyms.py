"""Format-preserving pseudonyms: permutations, formats, links."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from papyra.llm import pseudonyms, queries

from ..conftest import SF_SMALL
from . import edges


def _luhn(s):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


def _rewrite(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.pseudonymise(df, key).collect()}


def test_feistel_is_a_permutation(spark):
    pair = pseudonyms.feistel(F.floor(F.col("id") / 43), F.col("id") % 43, F.lit(17), F.lit(43), "k", F.lit("t"))
    got = [tuple(r.p) for r in spark.range(17 * 43).select(pair.alias("p")).collect()]
    assert len(set(got)) == 17 * 43 and all(0 <= a < 17 and 0 <= b < 43 for a, b in got)
    assert sum(p == divmod(i, 43) for i, p in enumerate(got)) < 20


def test_digit_strings_are_permuted_among_themselves(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = [r[0] for r in df.select(pseudonyms.permute_digits(F.col("d"), "k", "x")).collect()]
    assert sorted(got) == [f"{i:03d}" for i in range(1000)]


def test_formats_stay(spark):
    texts = ["card 4026083977531332.", "4026 0839 7753 1332", "+1 (017) 555-7713", "(212) 555-1234", "144.137.247.239!!",
             "on 2024-02-29", "31/12/1999", "01.02.2003", "123-45-6789", "a.b.27@mail6.example.com,",
             'TOKEN!! =!! "9233A8ECF7C5B09FE594"!!']
    shapes = [r"card \d{16}[.]", r"\d{4} \d{4} \d{4} \d{4}", r"[+]1 \(\d{3}\) \d{3}-\d{4}", r"\(\d{3}\) \d{3}-\d{4}",
              r"\d+[.]\d+[.]\d+[.]\d+!!", r"on \d{4}-\d\d-\d\d", r"\d\d/\d\d/\d{4}", r"\d\d[.]\d\d[.]\d{4}", r"\d{3}-\d\d-\d{4}",
              r"u[0-9a-f]{12}@m[0-9a-f]{8}[.]example,", r'TOKEN!! =!! "[0-9A-F]{20}"!!']
    got = _rewrite(spark, texts)
    for i, (t, shape) in enumerate(zip(texts, shapes, strict=True)):
        assert re.fullmatch(shape, got[i].text) and got[i].text != t
    cards = [re.sub(r"\D", "", got[i].text) for i in (0, 1)]
    assert cards[0] == cards[1] and _luhn(cards[0])
    assert all(int(x) <= 255 for x in got[4].text[:-2].split("."))
    datetime.date.fromisoformat(got[5].text[3:])
    assert got[8].text[:3] not in ("000", "666") and not got[8].text.startswith("9")


def test_numbers_after_a_phone_and_date_times(spark):
    texts = ["+1 (017) 555-7713", "+1 (017) 555-7713 2024-01-31", "+1 (017) 555-7713 12 people", "2024-01-31",
             "+49 30 1234567", "+49 30 1234567 2024-01-31", "+49 30 1234567 4026083977531332", "+49 30 1234567 123-45-6789",
             "1984-05-17T10:00:00Z", "1984-05-17", "12/25/1999", "1999-12-25", "+33 1 42.68.53.00", "+44 20 7123 4567 89012345"]
    got = _rewrite(spark, texts)
    out = [got[i].text for i in range(len(texts))]
    assert out[0] != texts[0] and out[1] == f"{out[0]} {out[3]}" and out[2] == f"{out[0]} 12 people"
    assert out[4] != texts[4] and out[3] != texts[3] and out[5] == f"{out[4]} {out[3]}"
    assert out[6].startswith(out[4] + " ") and out[6][-16:] != texts[6][-16:] and _luhn(out[6][-16:])
    assert out[7].startswith(out[4] + " ") and out[7][-11:] != texts[7][-11:] and got[7].n_ssn == 1
    assert out[8] == f"{out[9]}T10:00:00Z" and out[9] != texts[9]
    month, day, year = out[10].split("/")
    assert f"{year}-{month}-{day}" == out[11] != texts[11]
    assert got[12].n_phone == 1 and out[12][-11:] != texts[12][-11:]
    assert got[13].n_phone == 1 and out[13][:16] != texts[13][:16] and out[13][16:] == texts[13][16:]


def test_what_fails_its_check_stays(spark):
    texts = ["1234567812345678", "999.1.1.1", "1.2.3.4.5", "version 4.0.", "2023-02-29", "31.02.2003", "000-12-3456",
             "666-12-1234", "+1 23", "x4026083977531332", "user@host", "deadbeefdeadbeefdeadbeef", "", None]
    got = _rewrite(spark, texts)
    assert [got[i].text for i in range(len(texts))] == texts


def test_equal_values_stay_linked_and_keys_differ(spark):
    a = _rewrite(spark, ["x 144.137.247.239 y", "(144.137.247.239)"])
    b = _rewrite(spark, ["x 144.137.247.239 y"], key="other")
    assert a[0].text[2:-2] == a[1].text[1:-1] != b[0].text[2:-2]


@pytest.mark.parametrize("rows", [edges.ROWS, []])
def test_edge_rows(spark, rows):
    df = edges.frame(spark, rows)
    got = pseudonyms.pseudonymise(df, "k")
    assert set(got.columns) == set(df.columns) | {f"n_{k}" for k in pseudonyms.KINDS}
    assert edges.bag((r.doc_id, r.text) for r in got.collect()) == edges.bag(rows)


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([(1, "on 2024-02-29", "x", "y")], "doc_id long, text string, _hits string, _NEW string")
    (got,) = pseudonyms.pseudonymise(df, "k").collect()
    assert got["_hits"] == "x" and got["_NEW"] == "y" and got.n_date == 1 and got.text != "on 2024-02-29"


def test_query_leaves_no_value_and_no_clean_text_changed(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    found = 0
    for r in queries.QUERIES["op6_pseudonyms"](spark, SF_SMALL).collect():
        t = docs[r.doc_id]
        private = [m for m in re.findall(r"(?<!\w)\d{16}(?!\w)", t) if _luhn(m)]
        private += re.findall(r"[^\s|]+@[a-z0-9.]+\.com", t) + re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", t)
        private += re.findall(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w.]\d)", t)
        private += re.findall(r'= "([0-9a-f]{32,40})"', t)
        assert not [p for p in private if p in r.text]
        assert private or r.text == t
        found += len(private)
    assert found > 5


def test_plan_is_native(spark):
    plan = queries.QUERIES["op6_pseudonyms"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_phones_with_gaps_and_without_share_a_pseudonym(spark):
    pairs = [("+49 151 12345678", "+4915112345678", "49"), ("+351 912 345 678", "+351912345678", "351"),
             ("+1 (017) 555-7713", "+10175557713", "1"), ("+7 495 123-45-67", "+74951234567", "7"), ("+41 44 668 18 00", "+41446681800", "41")]
    got = _rewrite(spark, [t for a, b, _ in pairs for t in (a, b)])
    for i, (a, b, code) in enumerate(pairs):
        one, two = got[2 * i].text, got[2 * i + 1].text
        assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and one != a and two != b
        assert one.startswith(f"+{code}") and re.sub(r"\d", "0", one) == re.sub(r"\d", "0", a)


def test_long_secrets_go_and_keys_stay_out_of_plans(spark):
    secrets = ["ab12" * n for n in (4, 32, 36, 300)]
    got = _rewrite(spark, [f'token = "{x}" end' for x in secrets], key="the caller's own key")
    for i, x in enumerate(secrets):
        new = re.fullmatch(r'token = "([0-9a-f]+)" end', got[i].text)[1]
        assert len(new) == len(x) and not any(x[k:k + 16] in new for k in range(0, len(x) - 16, 4))
    assert got[3].text[9:9 + 64] != got[3].text[9 + 64:9 + 128]
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "caller's own" not in pseudonyms.pseudonymise(df, "the caller's own key")._jdf.queryExecution().toString()


def test_rewriting_by_hand(spark):
    """Find and replace, done again in Python with the pseudonyms of single
    values: gaps stay as they are, each value becomes what it becomes alone."""
    values = ["4026083977531332", "+49 30 1234567", "144.137.247.239", "123-45-6789", "2024-02-29", "31/12/1999",
              "a.b@mail.example.com", "(212) 555-1234"]
    alone = _rewrite(spark, values)
    texts = [" é|".join(values), "\n".join(reversed(values)) + "\n", "; ".join(v for v in values for _ in range(3)), "none"]
    got = _rewrite(spark, texts)
    for i, t in enumerate(texts):
        want = t
        for k, v in enumerate(values):
            want = want.replace(v, f"\0{k}\0")
        for k in range(len(values)):
            want = want.replace(f"\0{k}\0", alone[k].text)
        assert got[i].text == want
    assert all(alone[k].text != v for k, v in enumerate(values))
