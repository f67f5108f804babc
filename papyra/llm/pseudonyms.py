"""Personal numbers and dates replaced by format-preserving pseudonyms.

A keyed Feistel network permutes the values of a format among themselves:
card numbers keep their length and a valid check digit, phone numbers their
country code and punctuation, IPv4 addresses and social-security numbers stay
valid, dates stay dates. A value has one pseudonym everywhere, so equal values
stay linked across documents. Only values that pass their check are touched.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
# Formats, tried in this order at each place of a text.
_BEFORE = r"(?<![\p{L}\p{N}_])(?<!\p{N}[.])"
_AFTER = r"(?![\p{L}\p{N}_])(?![.]\p{N})"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}[.]\d{2}[.]\d{4}"
_IP = r"\d{1,3}(?:[.]\d{1,3}){3}"
_SSN_FORM = r"\d{3}-\d{2}-\d{4}"
_CARD = r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"
# National digits of country codes that have one length only, so that a number after the phone is not read as part of it.
_NATIONAL = {10: "1|7|52|57|91", 9: "31|33|34|41|48|61|351", 8: "45|47|65"}
# Country codes: 1 and 7 have one digit, these two, all others three.
_CODE = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
# 8 to 15 digits, spelt out: Java bounds no group repeated in a look-behind.
_SIZED = "(?<=" + "|".join("[+]" + r"[ .()-]{0,3}\d" * n + "[)]?" for n in range(8, 16)) + ")"
_GROUPS = r"[+]\d{1,3}(?:[ .-]?%s(?:[(]\d{1,4}[)]|\d{1,4})){2,6}" + _AFTER + _SIZED
_PHONE = "|".join([
    *(rf"[+](?:{codes})(?:[ .-]?[(]0[)])?(?:[ .-]?[(]?\d[)]?){{{n}}}{_AFTER}" for n, codes in _NATIONAL.items()),
    # other codes: as many groups as make 15 digits at most, up to a value of another format if that leaves a phone
    _GROUPS % f"(?!(?<= )(?:{_DATE}|{_IP}|{_SSN_FORM}|{_CARD}){_AFTER})", _GROUPS % ""])
_FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:[.][\p{L}\p{N}-]{1,63}){0,8}[.]\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": r"(?<=(?i:token|secret|password|key)[^\p{L}\p{N}\"']{0,6}[=:][^\p{L}\p{N}\"']{0,6}[\"'])[0-9A-Fa-f]{16,}+(?=[\"'])",
    "date": _BEFORE + rf"(?:\d{{4}}-\d{{2}}-\d{{2}}(?=[Tt]\d{{2}}:?\d{{2}})|(?:{_DATE}){_AFTER})",
    "ip": _BEFORE + _IP + _AFTER,
    "phone": rf"(?:(?<![\p{{L}}\p{{N}}_+])(?:{_PHONE})|" + _BEFORE + r"(?:[(]\d{3}[)] |\d{3}-)\d{3}-\d{4}" + _AFTER + ")",
    "ssn": _BEFORE + _SSN_FORM + _AFTER,
    "card": _BEFORE + f"(?:{_CARD})" + _AFTER,
}
KINDS = tuple(_FORMATS)
_ANY = "|".join(_FORMATS.values())
# Shapes that tell the kinds of a match apart, without what surrounds it.
_SHAPES = {
    "email": "@", "date": f"^(?:{_DATE})$", "ip": f"^{_IP}$", "ssn": f"^{_SSN_FORM}$",
    "phone": r"^[+(]|^\d{3}-\d{3}-\d{4}$", "card": f"^(?:{_CARD})$",
}
# 1900-01-01 to 2099-12-31: 73,049 days = 17 * 4297. SSN areas 001-899 but 666, groups 01-99, serials 0001-9999.
_DAYS, _SSN = (17, 4297), (898, 99 * 9999)


def derived(key: str, kind: str) -> str:
    """The key of one format. Only these reach a plan (and so logs of plans):
    they do not tell the caller's key."""
    return hmac.new(key.encode(), f"papyra pseudonyms {kind}".encode(), hashlib.sha256).hexdigest()


def _digest(key: str, *parts: Column) -> Column:
    """A keyed hash, nested as HMAC is."""
    inner = F.sha2(F.concat_ws("|", F.lit(key + "i"), *[p.cast("string") for p in parts]), 256)
    return F.sha2(F.concat(F.lit(key + "o"), inner), 256)


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, tag: Column) -> Column:
    """Keyed permutation of the pairs (left < n_left, right < n_right): rounds
    add a keyed hash of one half to the other, in turn, modulo its size. The
    result is a struct (l, r); struct steps keep the expression small."""
    def mix(i: Column, half: Column) -> Column:
        return F.conv(F.substring(_digest(key, tag, i, half), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(F.pmod(s["l"] + mix(i, s["r"]) % n_left, n_left).alias("l"), s["r"].alias("r"))) \
            .otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + mix(i, s["l"]) % n_right, n_right).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _named(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    pair = feistel(F.substr(digits, F.lit(1), a).cast("long"), F.substr(digits, a + 1, b).cast("long"),
                   _ten(a), _ten(b), key, F.concat(F.lit(tag), n.cast("string")))
    return _named(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, F.lit("0")),
                                           F.lpad(p["r"].cast("string"), b, F.lit("0"))))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced, in order, by those given."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.struct(F.concat(acc["s"], F.substr(digits, acc["k"], F.lit(1))).alias("s"),
                                                    (acc["k"] + 1).alias("k"))) \
            .otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))

    return F.aggregate(F.split(pattern, ""), start, step)["s"]


def _check_digit(payload: Column) -> Column:
    """Luhn: digits doubled in turn from the right, nines cast out."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(payload, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return ((10 - F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        payload = F.concat(F.substr(d, F.lit(1), F.lit(1)),
                           permute_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
        return _named(payload, lambda p: F.concat(p, _check_digit(p)))
    return _named(_digits(m), lambda d: refill(m, new(d)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; it follows from the digits alone, so a number
    has one pseudonym with gaps and without."""
    head = F.regexp_extract(m, f"^([+](?:{_CODE})|)", 1)
    return _named(head, lambda h: _named(F.substr(m, F.length(h) + 1), lambda rest: F.concat(
        h, refill(rest, permute_digits(_digits(rest), key, "phone")))))


def _ip(m: Column, key: str) -> Column:
    q = F.transform(F.split(m, "[.]"), lambda x: x.cast("long"))
    pair = _named(q, lambda v: feistel(v[0] * 256 + v[1], v[2] * 256 + v[3], F.lit(65536), F.lit(65536), key, F.lit("ip")))
    return _named(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))


def _ssn(m: Column, key: str) -> Column:
    d = F.split(m, "-")
    area = d[0].cast("long")
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    right = (d[1].cast("long") - 1) * 9999 + d[2].cast("long") - 1
    pair = feistel(left, right, F.lit(_SSN[0]), F.lit(_SSN[1]), key, F.lit("ssn"))
    return _named(pair, lambda p: F.format_string(
        "%03d-%02d-%04d", p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0),
        F.floor(p["r"] / 9999) + 1, p["r"] % 9999 + 1))


def _read(m: Column, month: int, day: int) -> Column:
    return F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, month, 2), F.substring(m, day, 2)).try_cast("date")


def _month_first(m: Column) -> Column:
    """Whether the day comes second: only where the day-first reading is no date."""
    return ~m.rlike("^\\d{4}-") & _read(m, 4, 1).isNull()


def _day(m: Column) -> Column:
    """The date of a match, null if there is none in the range."""
    day = F.when(m.rlike("^\\d{4}-"), m.try_cast("date")).otherwise(F.coalesce(_read(m, 4, 1), _read(m, 1, 4)))
    return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), day)


def _date(m: Column, key: str) -> Column:
    k = F.datediff(_day(m), F.lit("1900-01-01").cast("date"))
    pair = feistel(F.floor(k / _DAYS[1]), k % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, F.lit("date"))
    new = _named(pair, lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * _DAYS[1] + p["r"]).cast("int")))
    return _named(new, lambda n: F.when(m.rlike("^\\d{4}-"), F.date_format(n, "yyyy-MM-dd"))
                  .when(_month_first(m), F.when(m.contains("/"), F.date_format(n, "MM/dd/yyyy"))
                        .otherwise(F.date_format(n, "MM.dd.yyyy")))
                  .when(m.contains("/"), F.date_format(n, "dd/MM/yyyy")).otherwise(F.date_format(n, "dd.MM.yyyy")))


def _email(m: Column, key: str) -> Column:
    h = _digest(key, F.lit("email"), F.lower(m))
    return _named(h, lambda x: F.concat(F.lit("u"), F.substring(x, 1, 12), F.lit("@m"), F.substring(x, 13, 8),
                                        F.lit(".example")))


def _secret(m: Column, key: str) -> Column:
    """As many blocks of keyed hashes as the secret is long."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64).cast("int"))
    h = F.array_join(F.transform(blocks, lambda i: _digest(key, i, F.lower(m))), "")
    out = F.substr(h, F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(out)).otherwise(out)


def _kind(m: Column) -> Column:
    """The kind of a match that passes its check, else null."""
    octets = F.transform(F.split(m, "[.]"), lambda x: x.cast("int"))
    good = {
        "email": F.lit(True), "date": _day(m).isNotNull(),
        "ip": F.forall(octets, lambda x: x <= 255),
        "ssn": ~m.rlike(r"^(?:000|666|9\d\d)-|-00-|-0000$"),
        "phone": F.length(_digits(m)).between(8, 15), "card": F.call_function("luhn_check", _digits(m)),
    }
    out = F
    for kind, shape in _SHAPES.items():
        out = out.when(m.rlike(shape), F.when(good[kind], kind))
    return out.otherwise("secret")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The input with ``text`` rewritten, plus ``n_email, n_secret, n_date,
    n_ip, n_phone, n_ssn, n_card``: values replaced, by kind.

    Numbers and dates are permuted inside their format; e-mail addresses and
    quoted hexadecimal secrets, which have no such domain, get keyed hashes of
    the same form. Numbers that fail their check (Luhn, octets, calendar,
    numbering rules) stay as they are. One projection over each row: no
    shuffle and no state, so hot values or long texts need no care.

    A date has one pseudonym in all its notations. A month-first date (read so
    only where its day is over 12) may get a pseudonym whose day is not; that
    text is then the same as the day-first notation of another date.

    Null text stays null with counts 0; texts without a digit or @ are passed
    through unread by the patterns. Repeated rows are rewritten alike. An
    input column named like a count is replaced by the count.
    """
    text = docs[text_col]
    found, made = free_name(docs, "_hits"), free_name(docs, "_new")
    some = text.rlike("[0-9@=]")
    hits = F.when(some, F.regexp_extract_all(text, F.lit(_ANY), 0)).otherwise(F.array().cast("array<string>"))
    read = docs.withColumn(found, F.transform(hits, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))))

    def new(h: Column) -> Column:
        m, out = h["m"], F
        for kind, make in (("email", _email), ("secret", _secret), ("date", _date), ("ip", _ip), ("phone", _phone),
                           ("ssn", _ssn), ("card", _card)):
            out = out.when(h["kind"] == kind, make(m, derived(key, kind)))
        return out.otherwise(m)

    read = read.withColumn(made, F.transform(found, new))
    gaps = F.split(text, _ANY, -1)
    whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(made), i), F.lit("")))), "")
    changed = F.exists(found, lambda h: h["kind"].isNotNull())
    out = read.withColumn(text_col, F.when(changed, whole).otherwise(F.col(text_col)))
    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(found, lambda h: h["kind"] == kind)), F.lit(0)).cast("long")

    return out.withColumns({f"n_{kind}": count(kind) for kind in KINDS}).drop(found, made)
