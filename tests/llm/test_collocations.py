"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from oracle import connect, difference

from lodgeframe.llm import collocations
from lodgeframe.llm.queries import oracle_sql, queries

SCHEMA = "lang string, text string"


def plain_counts(rows):
    counts, n = {}, Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            own = counts.setdefault("und" if lang is None else lang, Counter())
            n["und" if lang is None else lang] += len(words)
            for k in range(1, 6):
                own.update(words[i : i + k] for i in range(len(words) - k + 1))
    return counts, n


def plain(rows, least, covered=100):
    counts, n = plain_counts(rows)
    out = []
    for lang, f in counts.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= least}
        for p in candidates:
            longer = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * f[q] >= covered * f[p] for q in longer):
                continue
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), f[p], f[p[:k]], f[p[k:]], n[lang], score))
    return sorted(out)


def found(df, **how):
    columns = ["lang", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, collocations.collocations(df, **how).select(*columns).collect()))


def texts(number, seed=3):
    drawn = random.Random(seed)
    words = ["the", "of", "A", "b", "É", "é", "new york city", "x", " ", "a-b", " "]
    ends = ["", " ", "  ", ". ", ",", "\n", "\t", "!? ", "\x0b", "\r\n"]
    for _ in range(number):
        text = "".join(drawn.choice(words) + drawn.choice([" ", " ", " ", *ends]) for _ in range(drawn.randrange(40)))
        yield drawn.choice(["en", "en", "en", None, "de", "und"]), text


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_against_plain_counts(many_parts):
    rows = [*texts(600), ("en", None), ("en", ""), (None, None), ("fr", " . ")]
    wide = many_parts.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", phrase string, f long, n long")
    for least, covered in [(3, 100), (20, 100), (5, 60)]:
        expected = plain(rows, least, covered)
        assert len(expected) > 20
        assert found(wide, least=least, covered=covered) == expected
    # repeated rows count each time
    assert found(wide.unionAll(wide), least=20) == plain(rows * 2, 20)


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([("en", "a b c"), (None, None)], SCHEMA)) == []


def test_partitions_begin_anywhere(many_parts):
    """All phrases begin and end with one word, so every partition but the first misses it."""
    rows = [("en", f"the {i} {j} the.") for i in range(30) for j in range(30) for _ in range(2)]
    assert found(many_parts.createDataFrame(rows, SCHEMA), least=2) == plain(rows, 2)


def test_stretches_of_text(monkeypatch):
    rows = [*texts(40), ("en", "word " * 400), ("en", "w. " * 300 + "z " * 300), ("en", "")]
    batch = pa.RecordBatch.from_pydict({"lang": [a or "und" for a, _ in rows], "text": [b for _, b in rows]})
    counts, n = plain_counts(rows)
    for chunk in (40, 500, 4 << 20):
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        for size in (1, 2, 5):
            got = Counter()
            for out in collocations._counter(size, None)([batch, batch.slice(0, 0), batch.slice(3)]):
                for r in out.to_pylist():
                    got[r["lang"], r["phrase"]] += r["f"]
            again = plain_counts(rows[3:])
            expected = Counter()
            for part, _ in ((counts, n), again):
                for lang, f in part.items():
                    expected.update({(lang, " ".join(p)): a for p, a in f.items() if len(p) == size})
            if size == 1:
                for total in (n, again[1]):
                    expected.update({(lang, ""): a for lang, a in total.items()})
            assert +got == +expected


def test_a_very_long_text(spark):
    text = "one two three four " * 200_000
    got = found(spark.createDataFrame([("en", text)], SCHEMA))
    assert got == plain([("en", text)], 100)


def test_top_and_ties(spark):
    rows = [("en", f"a{i} b{i}") for i in range(6) for _ in range(3)] + [("de", "x y")] * 3
    got = collocations.top_collocations(spark.createDataFrame(rows, SCHEMA), most=4, least=3).collect()
    ranks = sorted((r["lang"], r["rank"], r["phrase"]) for r in got)
    assert ranks == [("de", 1, "x y"), *[("en", i + 1, f"a{i} b{i}") for i in range(4)]]


def test_query(spark):
    name = "op12_collocations"
    sf = "/root/testdata/sf0.01"
    assert difference(queries()[name](spark, sf), connect(sf), oracle_sql()[name])[0] is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert found(docs, least=20) == plain(rows, 20)
