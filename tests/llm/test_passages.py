import random

import corpus_pipeline
import pytest
from plain_repeats import without_repeats
from pyspark.sql import functions as F

from lodgeframe.llm.queries import queries
from lodgeframe.llm.unit_dedup import remove_repeats

PASSAGE = " ".join(f"Sentence {i} has words a{i} b{i} c{i} d{i} e{i}." for i in range(7))  # 63 words
LINE = "one two three four five"


def cut(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = remove_repeats(df, passage=50).orderBy("doc_id").collect()
    return [r["text"] for r in got]


def test_passage_in_mid_line(spark):
    texts = [
        f"Begins so. {PASSAGE} Ends so.",
        f"Another start. {PASSAGE.upper()}  And end.\nnext",
        f"é first. {PASSAGE}\nlast",
        f"{PASSAGE}\nx",
        f"y. {PASSAGE}",
        f"{LINE}\nz\n{LINE}",
        f"Twice. {PASSAGE.replace('words', 'terms')} Mid. {PASSAGE.replace('words', 'terms')} End.",
        PASSAGE[:200],
    ]
    assert cut(spark, *texts) == [
        texts[0], "Another start. And end.\nnext", "é first. \nlast", "x", "y. ", f"{LINE}\nz",
        f"Twice. {PASSAGE.replace('words', 'terms')} Mid. End.", texts[7],
    ]


def test_lines_as_before(spark):
    rows = [f"x\n\n  {LINE}\n", f"{LINE}\nother\n{LINE}", f"a\n{LINE}", LINE, "", f"\n\n{LINE}", f"{LINE}\n\n"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert cut(spark, *rows) == [r["text"] for r in remove_repeats(df).orderBy("doc_id").collect()]


def test_stage(spark):
    rows = [(1, f"Begins. {PASSAGE} Ends."), (2, f"Elsewhere. {PASSAGE} Done.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.substring_dedup(spark, docs, "").orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [(rows[0][1], len(rows[0][1])), ("Elsewhere. Done.", 16)]


def test_lines_without_spaces(spark):
    line, short = "这一行文字没有空格但是重复出现", "版权所有"
    rows = [(1, f"{line}\n{short}"), (2, f"a\n{line}\n{short}"), (3, f"{line}\nb")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [rows[0][1], f"a\n{short}", "b"]


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, **how).collect()
    return {r["doc_id"]: (r["text"], [tuple(s) for s in r["removed_spans"]]) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_by_definition(spark, seed):
    drawn = random.Random(seed)
    pool = [" ".join(drawn.choices("abcdef", k=drawn.randrange(1, 9))) + drawn.choice([".", "!", "?", ""]) for _ in range(12)]
    rows = []
    for doc_id in range(80):
        text = "".join(drawn.choice(pool) + drawn.choice([" ", " ", "  ", "\n", "\n\n"]) for _ in range(drawn.randrange(12)))
        rows.append((doc_id, text))
    expected = without_repeats(rows, 4, 10)
    assert sum(bool(spans) for _, spans in expected.values()) > 30
    assert found(spark, rows, min_words=4, passage=10) == expected


def test_query_by_definition(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {
        d: (text, len(spans), ",".join(f"{a}-{b}" for a, b in spans))
        for d, (text, spans) in without_repeats(rows, 50, 50).items()
    }
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["removed"]) for r in queries()["op1_substring_dedup"](spark, sf).collect()}
    assert got == expected
    assert 100 < sum(n > 0 for _, n, _ in got.values()) < 200


def test_columns_of_any_name(spark):
    rows = [(1, LINE, 1, 2, 3, 4, 5, "x"), (2, f"y\n{LINE}", 1, 2, 3, 4, 5, "x")]
    names = ["_removed", "_of_id", "_of_version", "_length", "repeats 0", "removed_spans"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` {'string' if n == names[-1] else 'int'}" for n in names)
    got = remove_repeats(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [LINE, "y"] and got[0]["_length"] == 4 and got[1]["repeats 0"] == 5
