"""The manifest's roots and proofs against trees built whole."""

import zlib
from hashlib import sha256

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from lodgeframe.llm import merkle
from lodgeframe.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def whole_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def steps(levels, at):
    """For each level: the run's nodes before and behind the node."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        out.append((run[: at % 2], run[at % 2 + 1 :]))
        at //= 2
    return out


def plain(rows):
    """Rows as (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        leaf = h(*map(field, row))
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf, row))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda t: t[:3])
        built[lang] = whole_tree([t[2] for t in trees[lang]])
    top = whole_tree([built[lang][-1][0] for lang in order])
    out = []
    for number, lang in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(trees[lang]):
            path = steps(built[lang], at) + steps(top, number)
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                folded = h(*map(field, (*row[:3], row[3] + 1, row[4])))
            for before, behind in path:
                folded = h(*before, folded, *behind)
            proof = h(*[d for before, behind in path for d in (*before, *behind)])
            root = top[-1][0]
            out.append((row[0], leaf, built[lang][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def found(df, levels=10):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = merkle.leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    out = merkle.verified_rows(df, FIELDS, "lang", "doc_id", F.when(changed, other), levels)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_small_trees(spark, levels):
    rows = [(i, "s", "ab"[i % 2], i, f"text {i}") for i in range(27)]
    rows += [(i, None, None, None, None) for i in range(5)] + [(40, "é", "é", 1, "ü" * 9), (None, "s", "a", 2, ""), (None, None, "a", 2, None)]
    rows += [(7, "s", "z", 7, "same")] * 6
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", tree string, digest string, place int")
    got = found(df, levels)
    assert got == plain(rows)
    # repeated rows are leaves of their own, a changed row without a count stays as it is
    assert sum(r[0] == 7 for r in got) == 7 and {r[6] for r in got} == {True, False}
    assert all(r[6] for r in got if r[0] is not None and r[0] < 5 and r[1] in {h(*map(field, (i, None, None, None, None))) for i in range(5)})


def test_one_tree_one_row_no_row(spark):
    rows = [(i, "s", "a", i, "t") for i in range(9)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert found(spark.createDataFrame(rows[:1], SCHEMA)) == plain(rows[:1])
    empty = merkle.verified_rows(spark.createDataFrame([], SCHEMA), FIELDS, "lang", "doc_id")
    assert empty.count() == 0 and "verified" in empty.columns


def test_every_other_level_is_made_again(spark):
    rows = [(i, "s", "a", i, "t") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    lower, upper = merkle.manifest(df, FIELDS, "lang", "doc_id")
    assert [level.count() for level in lower.kept] == [3000, 3, 1]
    # of the tree of trees, which has one leaf
    assert [level.count() for level in upper.kept] == [1, 1]


def test_a_changed_digest_is_found(spark):
    levels = whole_tree([h(str(i)) for i in range(11)])
    for at in range(11):
        path = merkle.siblings(merkle.levels_above(levels[0], 11, 10), at)
        assert merkle.fold(levels[0][at], path) == levels[-1][0]
        assert merkle.fold(h("other"), path) != levels[-1][0]


def test_query(spark):
    query = queries()["op13_merkle"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()
    assert sorted((tuple(r) for r in query.collect()), key=repr) == plain([tuple(r) for r in docs])
    assert difference(query, connect(SF), oracle_sql()["op13_merkle"])[0] is None
