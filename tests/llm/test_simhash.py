import numpy as np
import pytest
import xxhash

from lodgeframe.llm import simhash
from lodgeframe.llm.components import components
from lodgeframe.llm.queries import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        own = [r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None]
        found.append((doc_id, f"{fps[i]:016x}", min(own, default=None)))
    return sorted(found, key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries()["op2_simhash"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == plain_components([tuple(d) for d in docs])


def test_odd_rows(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(100_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (5, "One two"), (6, "ONE TWO"),
        (7, "É one two three"), (8, "é one two three"), (None, "one two"), (None, "alone here now"),
        (9, long_text), (10, long_text + " end"), (11, "a b c"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == plain_components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [1, 2, 4])
def test_crowded_cells_lose_no_link(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    fps = {0}
    while len(fps) < 600:  # a cloud around one value: every cell is crowded
        base = list(fps)[rng.integers(len(fps))]
        fps.add(base ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    fps |= {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "TILE", 50)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = components(simhash.links(df, 3, width)).collect()
    values = np.array(fps, np.int64)
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= 3
    root = values.copy()
    while True:
        least = np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == root).all():
            break
        root = least
    want = {(int(v), int(r)) for v, r, n in zip(values, root, near.sum(axis=1)) if n > 1}
    assert {tuple(r) for r in found} == want


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(5, 5), (None, 3), (90, 91), (91, 90)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {(i, 0) for i in range(41)} | {(90, 90), (91, 90)}
    assert {tuple(r) for r in found} == want
