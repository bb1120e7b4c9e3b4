import datetime
import hashlib
import re

import regex
from pyspark.sql import functions as F

from pointloom.llm import pii_feistel as p
from tests.llm.cases import EDGE, edge, empty


def run(spark, *texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n_pii"]) for r in p.pseudonymise(df, key).orderBy("doc_id").collect()]


def luhn(s):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_formats_stay(spark):
    cards, phone, ip, date, ssn, secret, mail = (
        r[0]
        for r in run(spark, "4485460990498125, 4485 4609 9049 8125", "+1 (017) 555-7713", "97.51.17.173", "1987-05-31 31/12/1999 12/31/1999 01.02.2003", "123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "né.55@mail4.example.com!!")
    )
    a, b = cards.split(", ")
    assert luhn(a) and a != "4485460990498125" and len(a) == 16 and b == f"{a[:4]} {a[4:8]} {a[8:12]} {a[12:]}"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (017) 555-7713"
    assert all(0 <= int(x) <= 255 for x in ip.split(".")) and ip != "97.51.17.173"
    assert re.fullmatch(r"\d{4}-\d\d-\d\d (\d\d)/(\d\d)/\d{4} (\d\d)/(\d\d)/\d{4} \d\d\.\d\d\.\d{4}", date)
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn) and ssn != "123-45-6789"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', secret) and "04dbebab" not in secret
    assert re.fullmatch(r"u[0-9a-f]{16}@mail\.example\.invalid!!", mail)


def test_invalid_values_stay(spark):
    for t in ("4485460990498126", "999.1.1.1", "31.04.2000", "000-12-3456", "version 4.0 of 2", "1234567", "3.14159265358979", "e@", "deadbeef"):
        assert run(spark, t) == [(t, 0)]


def test_equal_values_stay_linked_and_keys_differ(spark):
    a, b = run(spark, "x 4485460990498125 y", "4485460990498125.")
    assert a[0].split()[1] == b[0][:-1] and a[1] == b[1] == 1
    assert run(spark, "4485460990498125", key="other")[0][0] != b[0][:-1]


def test_permutations(spark):
    for n in (1, 2, 3, 4):
        d = spark.range(10**n).select(p.permute_digits(F.lpad(F.col("id").cast("string"), n, "0"), "t", "k").alias("d"))
        assert sorted(r["d"] for r in d.collect()) == [f"{i:0{n}d}" for i in range(10**n)]
    h = spark.range(4096).select(p.permute_hex(F.lower(F.lpad(F.hex("id"), 3, "0")), "k").alias("d"))
    assert sorted(r["d"] for r in h.collect()) == [f"{i:03x}" for i in range(4096)]
    days = spark.range(p._DAYS).select(F.date_format(F.date_add(F.lit(p._FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("c"))
    moved = days.select(p._moved_date(F.col("c"), "k").alias("m")).agg(F.countDistinct("m").alias("n"), F.min("m").alias("a"), F.max("m").alias("b")).first()
    assert tuple(moved) == (p._DAYS, "1900-01-01", "2099-12-31")


def number(v, left, right, tag, key):
    a, b = v // right, v % right
    for i in range(p.ROUNDS):
        f = int(hashlib.sha256(f"{key}|{tag}|{i}|{b}".encode()).hexdigest()[:13], 16)
        a, b = b, (a + f) % (left if i % 2 == 0 else right)
    return a * right + b


def digits(s, tag, key):
    n = min(len(s), 18)
    head, low = s[: len(s) - n], s[len(s) - n :]
    return head + f"{number(int(low), 10 ** (n // 2), 10 ** (n - n // 2), f'{tag}:{n}:{head}', key):0{n}d}"


def shaped(shape, new):
    new = iter(new)
    return "".join(next(new) if c in "0123456789" else c for c in shape)


def hexed(s, key):
    n = len(s) // 2
    a, b = s[:n], s[n:]
    for i in range(p.ROUNDS):
        pad = hashlib.sha256(f"{key}|hex|{i}|{b}".encode()).hexdigest()
        a, b = b, "".join(f"{int(x, 16) ^ int(y, 16):x}" for x, y in zip(a, pad))  # noqa: B905
    return a + b


def dated(c, key):
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"):
        try:
            day = (datetime.datetime.strptime(c, form).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            continue
        if not 0 <= day < 73049:
            return None
        day = number(day, 283, 259, "date", key)
        while day >= 73049:
            day = number(day, 283, 259, "date", key)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(day)).strftime(form)
    return None


def brute_value(c, key):
    """The pseudonym of a candidate, or None if it doesn't validate: a plain version, with numbers in place of columns."""
    d = re.sub("[^0-9]", "", c)
    if "@" in c:
        return "u" + hashlib.sha256(f"{key}|email|{c.lower()}".encode()).hexdigest()[:16] + "@mail.example.invalid"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}", c):
        return dated(c, key)
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", c):
        return None if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else shaped(c, digits(d, "ssn", key))
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", c):
        parts = [int(x) for x in c.split(".")]
        v = number(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, "ip", key) if max(parts) < 256 else None
        return None if v is None else ".".join(str(x) for x in v.to_bytes(4, "big"))
    if c[0] in "+(" or re.fullmatch(r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", c):
        code = (re.match(r"\+[0-9]{1,3}(?=[ .(-])", c) or [""])[0]
        rest = c[len(code) :]
        return code + shaped(rest, digits(re.sub("[^0-9]", "", rest), "phone", key)) if 8 <= len(d) <= 15 else None
    if re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", c):
        if not (luhn(d) and d.strip("0")):
            return None
        new = digits(d[:-1], "card", key)
        return shaped(c, new + next(x for x in "0123456789" if luhn(new + x)))
    return hexed(c, key)


def brute(text, key):
    out, at, n = [], 0, 0
    for m in regex.finditer(p.CANDIDATE.replace(r"\d", "[0-9]"), text or ""):
        new = brute_value(m[0], key)
        out += [text[at : m.start()], m[0] if new is None else new]
        at, n = m.end(), n + (new is not None)
    return ("".join(out) + text[at:] if text else text), n


def test_digits_match_a_brute_force_network(spark):
    values = ["4485460990498", "0001112", "123456789012345678", "42"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(p.permute_digits(F.col("v"), "t", "k")).collect()]
    assert got == [digits(v, "t", "k") for v in values]


def test_every_path_from_text_to_text(spark):
    texts = [
        "mail Ann.B+x@sub-1.example.org, or a@b.co.2 and a@b.com..next, not a@b..com or a@b.c",
        "hosts 10.0.0.1 255.255.255.255 256.1.1.1 1.2.3.4.5 0.0.0.0", "days 1900-01-01 2099-12-31 2100-01-01 29.02.2000 29.02.1900 05/06/1999 13/06/1999 06/13/1999 31/31/1999",
        "hex " + "0123456789abcdef" * 2 + " " + "a1" * 64 + " " + "b2" * 33 + "c " + "d3" * 65 + " " + "a" * 40, "call +49 30 123456 or +1 (017) 555-7713 or (212) 555-1234 or 212.555.1234 or +1 2 34 5",
        "ssn 123-45-6789 000-45-6789 666-45-6789 123-00-6789 923-45-6789", "cards 4485460990498125 4485-4609-9049-8125 4485460990498126 0000000000000 6011000990139424000", "é@é.com x123-45-6789 1.1.1.1é", "", None,
    ]
    assert run(spark, *texts) == [brute(t, "k") for t in texts]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["text"], r["n_pii"]) for r in p.pseudonymise(docs, "key").collect()}
    assert got == {r["doc_id"]: brute(r["text"], "key") for r in docs.collect()}
    assert sum(n for _, n in got.values()) > 20


def test_no_text_is_too_long(spark):
    n = 100_000
    odd = ["x@" + "a." * n, "x@" + "ab." * n + "com", "1" * n, "1 " * 2000, "1-" * 2000, "1." * n, "+1" * n, "0a" * n, "a" * n, "@" * n, "a@" * n, "x@" + "a" * n, "x@" + "a-" * n, "." * n + "@a.com", "a" * n + "@a.com", "x@a." + "b" * n, "(1" * n, "(123) " * n, "2000-01-0" * 500]
    got = run(spark, *odd)
    for (new, found), text in zip(got, odd, strict=True):
        assert (new, found) == brute(text, "k"), text[:20]


def test_tables(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, p.pseudonymise(docs, "k")))
    private = re.compile(r"\S+@\S+\.com|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|[0-9a-f]{40}|\d+\.\d+\.\d+\.\d+")
    for i, t in before.items():
        found = {m for m in private.findall(t) if not (len(m) == 16 and m.isdigit() and not luhn(m))}
        assert not [m for m in found if m in after[i]]
        if not private.search(t):
            assert after[i] == t


def test_edges(spark):
    out = p.pseudonymise(edge(spark), "k")
    rows = out.collect()
    assert len(rows) == len(EDGE) and set(out.columns) == set(edge(spark).columns)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == sorted((str(r[0]), str(r[1])) for r in EDGE)
    assert p.pseudonymise(empty(spark), "k").count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
