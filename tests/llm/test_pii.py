"""Pseudonyms against a plain version."""

import datetime
import hashlib
import re
import time

import pytest
import regex

pytest.importorskip("markerlake.llm")
from pyspark.sql import functions as F  # noqa: E402

from markerlake.llm.pii import KEY_SETTING, PATTERN, ROUNDS, feistel, op10_pii, pseudonymise, session_key  # noqa: E402


def plain(values, bases, key, kind):
    h = (len(values) + 1) // 2
    side, base = [values[:h], values[h:]], [bases[:h], bases[h:]]
    for r in range(ROUNDS):
        a, b = r % 2, 1 - r % 2
        other = ",".join(map(str, side[b]))
        digest = hashlib.sha256(f"{key}|{kind}|{len(values)}|{r}|{other}".encode()).hexdigest()
        side[a] = [(x + int(hashlib.sha256(f"{digest}|{i}".encode()).hexdigest()[:12], 16)) % m for i, (x, m) in enumerate(zip(side[a], base[a]))]
    return side[0] + side[1]


DAY0 = datetime.date(1800, 1, 1)


def day(m):
    y, o, d = m.split("-") if m[4] == "-" else (m[6:], m[3:5], m[:2])
    try:
        n = (datetime.date(int(y), int(o), int(d)) - DAY0).days
    except ValueError:
        return None
    return n if 0 <= n < 146_097 else None


def kind_of(m):
    digits = re.sub("[^0-9]", "", m)
    full = lambda p: re.fullmatch(p, m)
    if "@" in m:
        return "email"
    if full("[0-9a-f]{32,64}|[0-9A-F]{32,64}"):
        return "secret" if re.search("[0-9]", m) and re.search("[A-Fa-f]", m) else None
    if full("[0-9]{13,19}|([0-9]{4}[ -]){3}[0-9]{4}"):
        return "card" if luhn(digits) else None
    if full(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"):
        return None if day(m) is None else "date"
    if full("[0-9]{3}-[0-9]{2}-[0-9]{4}"):
        return None if m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[7:] == "0000" else "ssn"
    if full(r"([0-9]{1,3}\.){3}[0-9]{1,3}"):
        return "ip" if all(int(x) < 256 for x in m.split(".")) else None
    return "phone"


def laid(m, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in m)


def replaced(m, kind, key):
    digits = re.sub("[^0-9]", "", m)
    tens = lambda d: "".join(map(str, plain([int(c) for c in d], [10] * len(d), key, kind)))
    if kind == "card":
        body = tens(digits[:-1])
        return laid(m, next(body + str(c) for c in range(10) if luhn(body + str(c))))
    if kind == "phone":
        return laid(m, digits[:-10] + tens(digits[-10:]))
    if kind == "ssn":
        a = int(m[:3])
        a, g, n = plain([a - (2 if a > 666 else 1), int(m[4:6]) - 1, int(m[7:]) - 1], [898, 99, 9999], key, kind)
        return f"{a + (2 if a > 664 else 1):03d}-{g + 1:02d}-{n + 1:04d}"
    if kind == "ip":
        return ".".join(map(str, plain([int(x) for x in m.split(".")], [256] * 4, key, kind)))
    if kind == "date":
        hi, lo = plain([day(m) // 773, day(m) % 773], [189, 773], key, kind)
        d = DAY0 + datetime.timedelta(hi * 773 + lo)
        return d.strftime("%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if m[2] == "." else "%d/%m/%Y")
    if kind == "secret":
        new = "".join("0123456789abcdef"[v] for v in plain([int(c, 16) for c in m], [16] * len(m), key, kind))
        return new.upper() if re.search("[A-F]", m) else new
    head, _, top = m.rpartition(".")
    first = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
    base = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in head]
    new = plain([ord(c) - ord(first(c)) for c in head], base, key, kind)
    return "".join(chr(ord(first(c)) + v) for c, v in zip(head, new)) + "." + top


def whole(text, key):
    """(text, n_found) by a plain loop over the matches."""
    found, out, at = 0, [], 0
    for m in regex.finditer(PATTERN, text or ""):
        kind = kind_of(m[0])
        found += kind is not None
        out += [text[at : m.start()], replaced(m[0], kind, key) if kind else m[0]]
        at = m.end()
    return (None if text is None else "".join([*out, text[at:]])), found


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_permutation(spark):
    bases = [4, 3, 5, 2]
    rows = [([a, b, c, d],) for a in range(4) for b in range(3) for c in range(5) for d in range(2)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", feistel(F.col("v"), F.array(*map(F.lit, bases)), "k", "x").alias("n")).collect()
    assert len({tuple(r.n) for r in got}) == len(rows)
    assert all(r.n == plain(list(r.v), bases, "k", "x") for r in got)


CARD, BAD = "4111111111111111", "4111111111111112"


def test_values(spark):
    texts = [
        None, "", "nothing 12 here", f"a {CARD} {CARD}### {BAD}", "x 4111-1111-1111-1111.", f"{CARD}", "ip 10.0.0.255. and 1.2.3.400 v2.0.",
        "on 2024-02-29, 31.12.1999 and 30/02/2001", "+1 (743) 555-3824 or (743) 555-3824;+44 203 555 1234", "me.19@Mail5.example.com,x", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', "078-05-1120", "10.0.0.255",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS n_found", "7 AS n_card")
    out = {r.doc_id: r for r in pseudonymise(df, "k1").collect()}
    t = {i: r.text for i, r in out.items()}
    assert [out[i].n_found for i in range(13)] == [0, 0, 0, 2, 1, 1, 1, 2, 3, 1, 1, 1, 1]
    assert (t[0], t[1], t[2]) == (None, "", texts[2])
    a, b = re.findall(r"\d{16}", t[3])[:2]
    assert a == b != CARD and luhn(a) and BAD in t[3] and t[3].endswith(f"### {BAD}") and t[5] == a
    assert re.fullmatch(r"x \d{4}-\d{4}-\d{4}-\d{4}\.", t[4]) and luhn(t[4])
    new_ip = re.match(r"ip (\S+)\. and 1\.2\.3\.400 v2\.0\.", t[6])[1]
    assert new_ip == t[12] != "10.0.0.255" and all(0 <= int(x) < 256 for x in new_ip.split("."))
    assert new_ip == ".".join(map(str, plain([10, 0, 0, 255], [256] * 4, "k1", "ip")))
    m = re.match(r"on (\S+), (\S+) and 30/02/2001", t[7])
    assert 1800 <= datetime.date.fromisoformat(m[1]).year < 2200 and datetime.datetime.strptime(m[2], "%d.%m.%Y") and m[1] != "2024-02-29"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4};\+44 \d{3} \d{3} \d{4}", t[8]) and "555-3824" not in t[8]
    assert re.fullmatch(r"[a-z]{2}\.\d\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com,x", t[9]) and "me.19" not in t[9]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', t[10]) and t[10] != texts[10]
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", t[11]) and t[11] != texts[11]
    assert [(t[i], out[i].n_found) for i in range(13)] == [whole(x, "k1") for x in texts]
    assert pseudonymise(df.filter("doc_id < 0"), "k1").count() == 0


def test_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = op10_pii(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.text, r.n_found) == whole(docs[r.doc_id], session_key(spark))
        assert len(r.text) == len(docs[r.doc_id]) or r.n_ip
        if not r.n_found:
            assert r.text == docs[r.doc_id]
        assert not set(re.findall(r"[\w.]+@[\w.]+\w|[0-9a-f]{40}|\(\d{3}\) \d{3}-\d{4}", docs[r.doc_id])) & set(re.findall(r"[\w.]+@[\w.]+\w|[0-9a-f]{40}|\(\d{3}\) \d{3}-\d{4}", r.text))


def test_upper_case_hex_and_plain_phone(spark):
    token, dull = "9233A8EC" * 5, "1.415-555-01345 415 555 01340 x415-555-0134"
    rows = [(1, f'TOKEN = "{token}" {token.lower()}'), (2, "call 415-555-0134 or 415.555.0134"), (3, dull)]
    out = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k1").collect()}
    new, low = re.findall("[0-9A-Fa-f]{40}", out[1].text)
    assert out[1].n_secret == 2 and new != token and new == new.upper() and low == low.lower() != token.lower()
    assert out[2].n_phone == 2 and "415-555-0134" not in out[2].text and re.fullmatch(r"call \d{3}-\d{3}-\d{4} or \d{3}\.\d{3}\.\d{4}", out[2].text)
    assert out[3].n_found == 0 and out[3].text == dull


def test_equal_numbers_stay_linked(spark):
    rows = [(1, CARD), (2, "4111-1111-1111-1111"), (3, "4111 1111 1111 1111"), (4, "(212) 555-0147"), (5, "(212)555-0147"), (6, "212-555-0147"), (7, "+1 212 555 0147"), (8, "+12125550147"), (9, "000-12-3456 666-12-3456 900-12-3456 123-00-3456 123-45-0000")]
    out = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k1").collect()}
    digits = {i: re.sub("[^0-9]", "", r.text) for i, r in out.items()}
    assert len({digits[i] for i in (1, 2, 3)}) == 1 and digits[1] != CARD
    assert len({digits[i][-10:] for i in range(4, 9)}) == 1 and digits[7][0] == "1" and out[9].n_found == 0 and out[9].text == rows[8][1]
    other = pseudonymise(spark.createDataFrame(rows[:1], "doc_id long, text string"), "k2").first()
    assert other.text != out[1].text


def test_long_values(spark):
    """A value of 100,000 characters costs its length, and very many labels do not exhaust the search."""
    rows = [(1, "x" * 100_000 + "@a.com"), (2, "a@b" + ".c" * 20_000), (3, "1" * 200_000), (4, "+" * 50_000 + "(1" * 50_000), (5, "a@" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in pseudonymise(df, "k1").collect()}
    assert time.monotonic() - began < 60
    assert out[1].n_email == 1 and out[1].text == whole(rows[0][1], "k1")[0]
    assert all(len(out[i].text) == len(t) for i, t in rows)


def test_key(spark):
    assert session_key(spark) == session_key(spark) and len(session_key(spark)) == 32
    spark.conf.set(KEY_SETTING, "mine")
    try:
        assert session_key(spark) == "mine"
    finally:
        spark.conf.unset(KEY_SETTING)
