"""Personal data: fixed spans against plain patterns, loose ones by planted cases."""

import random
import re
import time

import pytest

from cpdspark.llm import pii
from tests.llm import brute

RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]
PIECES = ["1", "2", "45", ".", "-", " ", "@", "a", "b.c", "+", "+1", "(", ")", "%", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "\n", "é", "😀"]
PIECES += ["\x01", "\x02", "_", "256", "0001", "@@", "..", "123456789012", "0" * 30, "5500-0000-0000-0004", "+49 30 123456"]


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return kind != "card" or (12 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0)


def fixed_spans(text):
    return sorted((m.start(), o, k, m.end()) for o, (k, r) in enumerate(RULES) for m in r.finditer(text or "") if passes(k, m[0]))


def check(rows, got):
    for (_, text), r in zip(rows, got):
        want = fixed_spans(text)
        listed = [s for s in r.spans.split(",") if s.split(":")[0] in pii.FIXED]
        assert listed == [f"{k}:{s}:{e}" for s, _, k, e in want], text
        assert r.base_sha256 == brute.spans_digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k, _ in RULES]


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("i", "order", "start", "left", "match", "found", "spans", "_row"):
        df = df.withColumn(name, df.text)
    return {r.doc_id: r for r in pii.find(df.repartition(3)).collect()}


def test_fixed_spans(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a@b.c%d@e.f"), (5003, "1.2.3.4.5.6.7.8"), (5004, "+1" + " " * 500 + "23456789")]
    got = found(spark, rows)
    assert len(got) == len(rows)
    check(rows, [got[i] for i, _ in rows])


def test_long_runs_take_linear_time(spark):
    """Runs on which the plain patterns try every start again."""
    texts = ["x" * 70000 + "@a" + ".b" * 60000, "1.2" * 20000, "7" * 300000, "+" * 100000, "4111111111111111 " * 3000]
    start = time.time()
    got = found(spark, list(enumerate(texts)))
    assert time.time() - start < 120
    assert [got[0].n_email, got[1].n_ip, got[4].n_card] == [1, 5000, 0] and got[0].spans == f"email:0:{len(texts[0])}"
    assert got[2].spans == got[3].spans == "" and got[4].spans == ""


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a@b.co"), (None, None), (7, "a@b.co"), (7, "a@b.co")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in got) == [(0, 0), (0, 1), (7, 1), (7, 1)]


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    quiet = pii.find(spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")).collect()
    assert [r.spans for r in quiet] == ["", ""]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(300):
        kind = i % 6
        rows.append((i, [
            f"reach us: phone (0{digit(2)}) {digit(4)} {digit(4)} today",
            f"the mail x{digit(3)}@host.org and Tel. +49 {digit(3)} {digit(6)}",
            f"version {2000 + i % 20}.{1 + i % 12}.{1 + i % 28} and page {digit(4)}",
            f"server 8.8.{i % 250}.{i % 199} said order {digit(8)}",
            f"token a{digit(7)}b{digit(9)}c",
            f"plain words with {digit(3)} things",
        ][kind]))
    return rows


def test_loose_spans(spark, corpus):
    planted = {
        1000: ("call 555 123 4567 now", "number", "555 123 4567"),
        1001: ("IBAN DE89 3704 0044 0532 0130 00 please", "account", "DE89 3704 0044 0532 0130 00"),
        1002: ("contact bob.smith (at) example (dot) com", "spelled", "bob.smith (at) example (dot) com"),
        1003: ("patient Dr. Anna Schmidt was", "person", "Dr. Anna Schmidt"),
        1004: ("ssn 078-05-1120", "number", "078-05-1120"),
    }
    clean = {
        2000: "version 2023.10.12 of 20231012",
        2001: "a number 123456789 alone",
        2002: "see page 1999-2003, order 4829104829",
        2003: "key 9f8a7c6d5e4b3a29180f7e6d5c4b3a21",
        2004: "IBAN DE88 3704 0044 0532 0130 00",  # a wrong checksum
        2005: "The Robert. Maria went",
        2006: "in 3.14159265 of 12/11/2020",
    }
    rows = corpus + [(i, t) for i, (t, *_) in planted.items()] + list(clean.items())
    got = found(spark, rows)
    for i, (text, kind, span) in planted.items():
        start = text.index(span)
        assert f"{kind}:{start}:{start + len(span)}" in got[i].spans.split(","), (text, got[i].spans)
    for i, text in clean.items():
        assert got[i].spans == "", (text, got[i].spans)
    check(rows, [got[i] for i, _ in rows])


def test_reliabilities_are_found():
    """Votes drawn from known reliabilities: expectation-maximisation comes near them without any label."""
    rng = random.Random(4)
    true, share = [0.95, 0.7, 0.85, 0.9, 0.6], 0.4
    counts = {}
    for _ in range(40000):
        y = 1 if rng.random() < share else -1
        votes = [0 if rng.random() < 0.2 else y if rng.random() < r else -y for r in true]
        code = sum((v + 1) * 3**i for i, v in enumerate(votes))
        counts[code] = counts.get(code, 0) + 1
    reliability, shares = pii.reliabilities([(4, c, n) for c, n in counts.items()])
    assert all(abs(a - b) < 0.03 for a, b in zip(reliability, true)) and abs(shares[4] - share) < 0.03


def test_no_python_in_plans(spark, corpus):
    df = pii.find(spark.createDataFrame(corpus[:50], "doc_id long, text string"))
    for plan in (df, pii.candidates(spark.createDataFrame(corpus[:50], "doc_id long, text string"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", text)
