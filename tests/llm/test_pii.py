"""Base spans against Python's patterns; checksums, context and masking."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridproof.llm import pii

KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    text = text or ""
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS) for m in p.finditer(text) if passes(kind, m.group())]
    told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
    return [sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(told.encode()).hexdigest()


def check(documents, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(documents(rows))).collect()}
    for k, t in rows:
        r = got[k]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == base(t), t


TEXTS = [
    None, "", "a@b.c", "a@b.c_d@e.f x", "a@b@c.d", "😀 é me.x+1@mail.example.com, 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112 and 4111111111111111.",
    "+1 (017) 555-7713 +49.30.1234567", "+12", "+1 23 4", "x+1234567890", "4111 1111 1111 1111 4111 1111 1111 1111", "0000000000000", "0000000000000000000000", "a.b@c", "@a.b", "..@a.b", "1..2.3.4.5", "9.9.9.9@a.b",
]


def test_base_spans(documents):
    check(documents, TEXTS)


def test_odd_rows(documents, odd):
    check(documents, [t for _, t in odd])
    assert pii.find_personal_data(documents([])).count() == 0
    assert pii.find_personal_data(documents(odd)).where("doc_id is null").count() == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+- 2()é_0", max_size=40), min_size=20, max_size=60))
def test_random_texts(documents, texts):
    check(documents, texts)


@pytest.mark.parametrize("text", ["a" * 200_000 + "@b.c", "1" * 200_000 + " 1.2.3.4", "a." * 60_000 + "@", "1.2.3.4 " * 3_000, "4 " * 100_000, "+1 " * 30_000])
def test_very_long_runs(documents, text):
    check(documents, [text])


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "DE89370400440532013000"), ("4111111111111112", "DE89370400440532013001")], "d string, i string")
    assert [tuple(r) for r in df.select(pii.luhn(F.col("d")), pii.mod97(F.col("i"))).collect()] == [(True, True), (False, False)]


def spans_of(documents, text):
    return [(s.kind, s.start, s.stop, s.score) for s in pii.find_personal_data(documents([(1, text)])).first().spans]


def test_added_kinds_need_checksum_or_context(documents):
    assert spans_of(documents, "IBAN DE89 3704 0044 0532 0130 00 ok") == [("iban", 5, 32, 1.0)]
    assert spans_of(documents, "IBAN DE89 3704 0044 0532 0130 01 ok") == []
    assert spans_of(documents, "my ssn is 123-45-6789.") == [("ssn", 10, 21, 0.8)]
    assert spans_of(documents, "part 123-45-6789.") == []
    assert spans_of(documents, "order 1.2.3.4")[0][3] == 0.2


def test_masking(documents):
    got = pii.masked(documents([(1, "é a@b.cd, 1.2.3.4!"), (2, None), (3, "none")])).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["é [email], [ip]!", None, "none"]


def test_native(documents):
    plan = pii.digest(pii.find_personal_data(documents(TEXTS and [(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
