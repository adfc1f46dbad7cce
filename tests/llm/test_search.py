import numpy as np
import pytest

from lodgeframe.llm import exact_search, sharding
from lodgeframe.llm.queries import queries

SF = "/root/testdata/sf0.001"


def test_jump_is_consistent():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).view(np.uint64)
    for n in (1, 2, 16, 17, 100):
        at, grown = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert at.min() >= 0 and at.max() < n
        assert set(grown[grown != at]) <= {n}
        assert abs((grown != at).mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(at, minlength=n).max() < 1.3 * len(keys) / n + 30


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_against_plain_integers():
    keys = np.random.default_rng(2).integers(0, 2**63, 500).view(np.uint64)
    assert sharding.jump(keys, 23).tolist() == [plain_jump(int(k), 23) for k in keys]


def test_shards(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op7_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = {}
    for r in got:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_shards(spark):
    rows = [(1, None, 7), (1, "é", 8), (1, "é", 8), (None, "a", 9), (None, "", 9), (5, "x" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shard_documents(df, 4).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 3, 3, 100_001]
    assert len({(r["shard"], r["slot"]) for r in got}) == 6
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.shard_documents(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(df, 0)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<long>, score int")


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, [1, 1, 1, 1, 1, 1], 0) for i in range(100)]  # ties
    df = vectors(spark, rows)
    asked = df.where("id % 10 = 0")
    got = exact_search.exact_top_k(df, asked, 7, tile_rows=64, tile_queries=8).collect()
    want = set()
    for q, v, _ in rows:
        if q % 10 == 0:
            scored = sorted((-int(np.dot(v, w)), c) for c, w, _ in rows if c != q)[:7]
            want |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)}
    assert {tuple(r) for r in got} == want


def test_odd_vectors(spark):
    rows = [
        (1, [1, 2], 0), (2, None, 0), (3, [], 0), (4, [None, 1], 0), (None, [1, 1], 0),
        (5, [2**40, 2**20], 0), (6, [2**20, 1], 0), (7, [1, 2, 3], 0), (1, [1, 2], 0),
    ]
    df = vectors(spark, rows)
    got = {tuple(r) for r in exact_search.exact_top_k(df, df, 3).collect()}
    big = 2**60 + 2**20
    assert got == {
        (1, 1, 5, 2**40 + 2**21), (1, 2, 6, 2**20 + 2),
        (5, 1, 6, big), (5, 2, 1, 2**40 + 2**21), (5, 3, 1, 2**40 + 2**21),
        (6, 1, 5, big), (6, 2, 1, 2**20 + 2), (6, 3, 1, 2**20 + 2),
    }
    assert exact_search.exact_top_k(df.limit(0), df, 3).count() == 0
    assert exact_search.exact_top_k(df, df.limit(0), 3).count() == 0


def test_usable(spark):
    rows = [([1.0],), ([float("nan")],), ([float("-inf"), 1.0],), ([None],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert df.where(exact_search.usable(df["v"])).count() == 1
    got = spark.createDataFrame([([-0.001, 0.5],)], "v array<float>")
    assert got.select(exact_search.scaled(got["v"], 256)).first()[0] == [-1, 128]
