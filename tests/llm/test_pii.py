"""Personal data against the plain patterns."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, difference
from pyspark.sql import functions as F

from lodgeframe.llm import pii
from lodgeframe.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
#: As they are defined, searched for from every place.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sum_of_tens(text):
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


VALID = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": sum_of_tens,
    "phone": lambda m: 9 <= len(re.findall("[0-9]", m)) <= 15,
}


def plain_spans(text):
    return [
        (kind, *m.span()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if VALID[kind](m.group())
    ]


def base_spans(text, find=pii.finder()):
    return [s[:3] for s in find(text) if s[0] in PLAIN]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aB@.+-_%  0123459()é\n", max_size=40))
def test_base_spans(text):
    assert base_spans(text) == plain_spans(text)


def test_base_spans_of_numbers():
    drawn = random.Random(1)
    pieces = ["4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8", "256.1.1.1", "a.b@c.d.e",
              "x@y@z.org", "@", "..", " ", "-", "0", "+44 20 7946 0958", "001.002.003.004", "é", "5555-5555-5555-4444 7", "\t"]
    found = 0
    for _ in range(3000):
        text = "".join(drawn.choices(pieces, k=drawn.randrange(12)))
        assert base_spans(text) == plain_spans(text)
        found += len(plain_spans(text))
    assert found > 3000


def kinds_of(text):
    return [(kind, text[a:b]) for kind, a, b, _ in pii.finder()(text)]


def test_confirmed_by_checksums():
    assert kinds_of("IBAN: DE89 3704 0044 0532 0130 00 THE END") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds_of("NO9386011117947, GB82WEST12345698765432") == [
        ("iban", "NO9386011117947"), ("iban", "GB82WEST12345698765432")
    ]
    assert kinds_of("DE89 3704 0044 0532 0130 01 XDE89370400440532013000") == []
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")


def test_words_nearby_decide():
    assert kinds_of("my SSN is 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds_of("number 123-45-6789") == kinds_of("ssn 000-45-6789, 666-45-6789, 900-45-6789, 123-00-6789") == []
    assert kinds_of("Call 555-010-1234 now") == [("local_phone", "555-010-1234")]
    assert kinds_of("555-010-1234") == kinds_of("recall 555-010-1234") == []
    # a base span in its place
    assert kinds_of("tel +1 555-010-1234") == [("phone", "+1 555-010-1234")]
    assert [s[3] for s in pii.finder()("server 10.0.0.1 or " + "x" * 60 + " 10.0.0.2")] == [90, 60]
    assert pii.finder(nearby=5)("server up at 10.0.0.1") == [("ip", 13, 21, 60)]


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" + "(" * 300_000, "999." * 100_000, "call 1-2 " * 40_000])
def test_very_long_texts(text):
    assert kinds_of(text) == []


def test_many_spans_of_both_sorts():
    text = "call +1 555-010-1234 or 555-010-1234\n" * 20_000
    assert len(kinds_of(text)) == 40_000


def test_rows(spark):
    schema = "doc_id long, text string, spans string, redacted string, kind string"
    rows = [(1, "éü a@b.co é", "x", "y", "z"), (1, "éü a@b.co é", "x", "y", "z"), (None, "10.0.0.1", None, None, None), (2, None, "", "", ""), (3, "", "", "", "")]
    df = spark.createDataFrame(rows, schema)
    found = pii.find_pii(df, redact=True)
    assert found.columns == ["doc_id", "spans", "redacted"]
    got = sorted(((r[0], [tuple(s) for s in r[1]], r[2]) for r in found.collect()), key=repr)
    one = (1, [("email", 3, 9, 80)], "éü <EMAIL> é")
    assert got == sorted([one, one, (None, [("ip", 0, 8, 60)], "<IP>"), (2, [], None), (3, [], "")], key=repr)
    assert pii.find_pii(df.limit(0)).count() == 0
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_query(spark):
    assert difference(queries()["op11_pii"](spark, SF), connect(SF), oracle_sql()["op11_pii"])[0] is None
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op11_pii"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        plain = plain_spans(texts[r["doc_id"]])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in plain)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in plain) for k in PLAIN]
        assert set(shown.split(",")) <= set(r["spans"].split(","))
        assert len(r["spans"].split(",")) == len(r["scores"].split(","))
