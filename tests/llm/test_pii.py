"""A second, plain implementation of the pseudonyms, and texts of any length."""

import datetime
import hashlib
import re

import pytest
import regex

from querylens.llm import pii

KEY = "a key of the tests"


def network(kind, left, right, a, b):
    for i in range(1, 9):
        noise = int(hashlib.sha256(f"{KEY}:{kind}:{i}:{left if i % 2 else right}".encode()).hexdigest()[:15], 16)
        if i % 2:
            right = (right + noise) % b
        else:
            left = (left + noise) % a
    return left, right


def digits(kind, d):
    h = len(d) // 2
    x, y = network(kind, int(d[:h] or 0), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return (str(x).zfill(h) if h else "") + str(y).zfill(len(d) - h)


def refill(text, new):
    it = iter(new)
    return re.sub("[0-9]", lambda _: next(it), text)


def luhn(body):
    total = 0
    for j, c in enumerate(reversed(body)):
        x = int(c) * 2 if j % 2 == 0 else int(c)
        total += x - 9 if x > 9 else x
    return (10 - total % 10) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def email(h):
    local, domain = h.split("@")
    x, y = local[: len(local) // 2], local[len(local) // 2 :]

    def shifted(half, i, other):
        k = hashlib.sha512(f"{KEY}:email:{i}:{other}".encode()).hexdigest()
        out = ""
        for j, c in enumerate(half):
            by = int(k[4 * (j % 32) : 4 * (j % 32) + 4], 16)
            for lo, n in (("a", 26), ("A", 26), ("0", 10)):
                if ord(lo) <= ord(c) < ord(lo) + n:
                    c = chr(ord(lo) + (ord(c) - ord(lo) + by) % n)
                    break
            out += c
        return out

    for i in range(1, 9):
        if i % 2:
            y = shifted(y, i, x)
        else:
            x = shifted(x, i, y)
    return f"{x}{y}@{domain}"


def day(h):
    forms = {"-": ["%Y-%m-%d"], ".": ["%d.%m.%Y"], "/": ["%Y/%m/%d"] if h[4:5] == "/" else ["%m/%d/%Y", "%d/%m/%Y"]}[next(c for c in h if not c.isdigit())]
    for f in forms:
        try:
            n = (datetime.datetime.strptime(h, f).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            continue
        if 0 <= n < 17 * 4297:
            x, y = network("date", n // 4297, n % 4297, 17, 4297)
            new = datetime.date(1900, 1, 1) + datetime.timedelta(days=x * 4297 + y)
            return new.strftime(f).replace(str(new.year), f"{new.year:04d}")
    return h


def one(kind, h):
    d = re.sub("[^0-9]", "", h)
    if kind == "email":
        return email(h)
    if kind == "date":
        return day(h)
    if kind == "ip":
        o = [int(x) for x in h.split(".")]
        if max(o) > 255:
            return h
        x, y = network("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        area, group, serial = int(h[:3]), int(h[4:6]), int(h[7:])
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return h
        x, y = network("ssn", areas.index(area) * 99 + group - 1, serial - 1, len(areas) * 99, 9999)
        return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if kind == "phone":
        return refill(h, digits("phone", d)) if 7 <= len(d) <= 15 else h
    if kind == "card":
        if luhn(d[:-1]) != int(d[-1]) or not d.strip("0"):
            return h
        q = digits("card", d[:-1])
        return refill(h, q + str(luhn(q)))
    plain = h.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
        return h
    body = plain[4:]
    inner = re.sub("[^0-9]", "", body)
    q = refill(body, digits("iban", inner)) if inner else body
    new = plain[:2] + f"{98 - mod97(q + plain[:2] + '00'):02d}" + q
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in h)


EVERY = regex.compile("|".join(f"(?:{p})" for p in pii.LOOKS.values()))


def slow(text):
    counts = dict.fromkeys(pii.KINDS, 0)

    def mask(m):
        h = m.group()
        kind = next(k for k in pii.KINDS if regex.fullmatch(pii.LOOKS[k], h))
        new = one(kind, h)
        counts[kind] += new != h
        return new

    return EVERY.sub(mask, text), counts


def held(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, hits int, found string")
    for r in pii.pseudonymised(df, key=KEY).collect():
        t = texts[r["doc_id"]]
        text, counts = slow(t) if t is not None else (None, dict.fromkeys(pii.KINDS, 0))
        assert r["text"] == text and {k: r[f"n_{k}"] for k in pii.KINDS} == counts and r["n_pii"] == sum(counts.values()), t and t[:200]


def test_against_a_plain_implementation(spark):
    iban = "GB82WEST12345698765432"
    texts = [
        "mail John.Doe42@example.com, x_1%y@a-b.c.org or a@b.c now", "4111 1111 1111 1111, 4111111111111111, 5500-0000-0000-0004, 340000 000000009 0000000000000", "3400 000000 00009",
        "DE89 3704 0044 0532 0130 00 / DE89370400440532013000 / " + iban + " / XX00", "on 1984-02-29, 2001-02-30, 12/31/1999, 31/12/1999, 13/13/1999, 2020/01/05, 05.06.2077, 01.01.2100, 1899-12-31",
        "+1 (017) 555-7713; 555-123-4567; +49 30 1234567; (030) 1234 567; +1 23 45", "123-45-6789 666-12-3456 667-01-0001 899-99-9999 900-12-3456 000-12-3456 123-00-4567",
        "10.0.0.1 255.255.255.255 300.1.1.1 1.2.3.4.5 v1.2.3.4", None, "", "plain words only", "1.2.3.4 " * 3 + "\n" * 3 + "a@b.co",
    ]
    held(spark, texts)


def test_documents_against_a_plain_implementation(spark):
    held(spark, [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_null_and_repeated_ids_and_the_sessions_key(spark):
    df = spark.createDataFrame([(None, "10.0.0.1"), (1, "10.0.0.1"), (1, "10.0.0.1"), (None, None)], "doc_id long, text string")
    got = pii.pseudonymised(df).collect()
    assert len(got) == 4 and len({r["text"] for r in got}) == 2
    spark.conf.set(pii.KEY_CONF, KEY)
    try:
        assert {r["text"] for r in pii.pseudonymised(df).collect()} == {None, one("ip", "10.0.0.1")}
    finally:
        spark.conf.unset(pii.KEY_CONF)


LONG = {"dots": "a.", "digits": "1.", "numbers": "1", "underscores": "_a", "blanks": " ", "word": "a", "cards": "4111 ", "dashes": "12-", "phones": "+1 23 "}


@pytest.mark.parametrize("part", LONG)
def test_a_megabyte_of_anything_passes(spark, part):
    long = (LONG[part] * 1_000_000)[:1_000_000]
    df = spark.createDataFrame([(1, long), (2, f"a@{long}com"), (3, f"{long}@a.com")], "doc_id long, text string")
    assert pii.pseudonymised(df).count() == 3


def test_an_address_of_too_many_labels_is_none(spark):
    held(spark, ["a@" + "a." * 5000 + "com", "a@" + "a." * 100 + "com"])
