"""CSV files that are split where records are not."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from lodgeframe.sources import csv, records, tables


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def whole_files(spark, path):
    return spark.read.options(**csv.DIALECT).csv(path)


def table(drawn, lines, end):
    """Fields with separators, line breaks and quotes, quoted where they must be and sometimes where not."""
    words = ["", "x", "é", "two words", "a,b", "line\nbreak", "cr\r\nlf", 'say ""hi""', "\n\n", ",", '""', "0", "5'"]

    def field():
        text = "".join(drawn.choices(words, k=drawn.randrange(4)))
        if any(c in text for c in ',\n\r"') or drawn.random() < 0.2:
            return f'"{text}"'
        # a quote inside an unquoted field is one of its characters
        return text + drawn.choice(["", "", "", ' 5"', 'a"b"c']) if text else text

    return end.join(["k,a,b", *(f"{i},{field()},{field()}" for i in range(lines))]) + drawn.choice(["", end, end * 3])


@pytest.mark.parametrize("seed", range(12))
def test_as_whole_files(small_blocks, tmp_path, seed):
    drawn = random.Random(seed)
    end = drawn.choice(["\n", "\r\n"])
    for number in range(3):
        text = table(drawn, drawn.randrange(60), end)
        (tmp_path / f"{number}.csv").write_bytes(text.encode())
    # in files of such line ends the other reader takes a carriage return out of fields too
    plain = lambda found: sorted([tuple(v and v.replace(end, "\n") for v in r) for r in found], key=repr)
    got = rows(csv.scan_csv(small_blocks, str(tmp_path)))
    assert plain(got) == plain(rows(whole_files(small_blocks, str(tmp_path))))


def test_one_file_is_read_by_several_tasks(small_blocks, tmp_path):
    lines = [f'{i},"first\nsecond {i}, ""quoted""\n\nlast"' for i in range(60)]
    # a field over many blocks
    lines.insert(30, '1000,"' + "long\n" * 300 + '"')
    (tmp_path / "a.csv").write_text("\n".join(["i,t", *lines]) + "\n")
    found = records.read_lines(small_blocks, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 8
    got = csv.scan_csv(small_blocks, str(tmp_path))
    assert rows(got) == rows(whole_files(small_blocks, str(tmp_path)))
    assert dict(rows(got))["1000"] == "long\n" * 300


def test_a_quote_left_open(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text("i,t\n" + "1,x\n" * 50 + '2,"never closed\n' + "3,y\n" * 50)
    with pytest.raises(ValueError, match="never closed"):
        csv.scan_csv(small_blocks, str(tmp_path))


def test_splits_that_change_are_noticed(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text("i,t\n" + '1,"x\ny"\n' * 100)
    got = csv.scan_csv(small_blocks, str(tmp_path))
    small_blocks.conf.set("spark.sql.files.maxPartitionBytes", "77")
    with pytest.raises(Exception, match="split elsewhere"):
        got.collect()


def test_headers(spark, tmp_path):
    for name, text in {
        "a.csv": "\n\na,b\n1,2\n", "b.csv": "﻿b,a\n4,3\n", "c.csv": "c\n5,6\n\n7\n", "d.csv": "", "e.csv": "a,b\n",
        "f.csv": '"x\ny",,A,a\n1,2,3,4\n',
    }.items():
        (tmp_path / name).write_text(text)
    got = tables.read_files(spark, str(tmp_path), "[a-e].csv").select("file_name", "a", "b", "c")
    assert rows(got) == [("a.csv", "1", "2", None), ("b.csv", "3", "4", None), ("c.csv", None, None, "5"), ("c.csv", None, None, "7")]
    assert csv.scan_csv(spark, str(tmp_path / "f.csv")).columns == ["x\ny", "_c1", "A2", "a3"]
    with pytest.raises(ValueError, match="headers"):
        csv.scan_csv(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no file"):
        csv.scan_csv(spark, str(tmp_path / "d.csv"))


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    jobs = []
    for number in (3, 300):
        folder = tmp_path / str(number)
        folder.mkdir()
        for i in range(number):
            (folder / f"{i}.csv").write_text(f"a,{'bc'[i % 2]}\n{i},x\n")
        found = []
        jobs.append(jobs_of(spark, f"headers-{number}", lambda: found.append(tables.read_files(spark, str(folder)))))
        assert found[0].count() == number and sorted(found[0].columns) == ["a", "b", "c", "file_name"]
    assert max(jobs) <= min(jobs) + 1 < 10


def test_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a|b\n"1|\n2"|3,4\n')
    assert rows(tables.read_files(spark, str(tmp_path), sep="|").select("a", "b")) == [("1|\n2", "3,4")]


def test_states_against_one_step_at_a_time():
    drawn = random.Random(1)
    for _ in range(300):
        n = drawn.randrange(1, 12)
        outside, inside = (np.array([drawn.random() < 0.5 for _ in range(n)]) for _ in range(2))
        for start in (False, True):
            at, expected = start, []
            for a, b in zip(outside, inside):
                at = bool(b if at else a)
                expected.append(at)
            assert records.states(outside, inside, start).tolist() == expected


def test_lines_with_quotes():
    lines = ['a,b', 'a,"b', 'x","y', '"a""b",c', 'a 5",b', 'b"', '"",""\r', '"']
    outside, inside = records.Quotes(",").after(pa.array(lines))
    assert outside.tolist() == [False, True, True, False, False, False, False, True]
    assert inside.tolist()[:3] == [True, True, True] and inside.tolist()[5:] == [False, True, False]
