"""Classifiers, approximate search and the pipeline."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plain_repeats import without_repeats
from test_shingle_dedup import plain_groups

from lodgeframe.llm import ann_search, language, quality
from lodgeframe.llm.common import numbered
from lodgeframe.llm.queries import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def left(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


# -- language


def test_language_query(spark, documents):
    got = queries()["op9_language"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    apart = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in apart} == {d for d in documents if left(d, 4, 2)}
    right = [documents[r["doc_id"]]["lang"] == r["lang_pred"] for r in apart]
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("classes", [1, 2, 3, 4, 7, 8, 30])
def test_codewords_are_apart(classes):
    codes = language.codewords(classes)
    assert len(codes) == classes and set(np.unique(codes)) <= {-1.0, 1.0}
    apart = [(codes[i] != codes[j]).sum() for i in range(classes) for j in range(i)]
    assert min(apart, default=1) >= max(1, codes.shape[1] // 4)


def test_decoding_corrects_a_wrong_bit():
    names = ["a", "b", "c", "d"]
    codes = language.codewords(4)
    bits = codes.shape[1]
    model = language.LanguageModel(
        names, codes, np.eye(bits), np.zeros(bits), np.full(codes.shape, 1 / bits), 4.0
    )
    for k, wrong in product(range(4), range(bits)):
        said = codes[k].copy()
        said[wrong] *= -1
        assert model.losses(said[None]).argmin() == k


def test_odd_language_rows(spark):
    rows = [(i, f"der die das und nicht {i}", "de", 0.5) for i in range(40)]
    rows += [(100 + i, f"the and with from what {i}", "en", 0.5) for i in range(40)]
    rows += [(200, None, "de", 0.1), (201, "", "en", 0.1), (202, "12 ... ²", "en", 0.1), (None, "the", "en", 0.1)]
    rows += [(203, "das und der die " * 20_000, None, 0.1), (203, "das und der die " * 20_000, None, 0.1), (204, "ж", "de", 0.2)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.learn_languages(df, F.lit(True))
    assert model.languages == ["de", "en"]
    got = df.where("doc_id >= 200 or doc_id is null").select(
        "doc_id", language.identify(model, F.col("text")).alias("f")
    ).select("doc_id", "f.*").collect()
    found = Counter((r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] != 204)
    assert found == Counter(
        {(200, "und"): 1, (201, "und"): 1, (202, "und"): 1, (None, "en"): 1, (203, "de"): 2}
    )
    assert all(r["ambiguous"] and r["score"] == 0 for r in got if r["lang_pred"] == "und")
    # nothing to learn from
    for none in (df.limit(0), df.withColumn("lang", F.lit(None).cast("string"))):
        model = language.learn_languages(none, F.lit(True))
        got = df.select(language.identify(model, F.col("text")).alias("f")).select("f.*").distinct()
        assert [r["lang_pred"] for r in got.collect()] == ["und"]
    one = language.learn_languages(df.where("lang = 'de'"), F.lit(True))
    assert one.predict(["und"])[0] == ["de"]


def test_clashing_names_sparse_languages_and_repeated_ids(spark):
    rows = [(i, f"{i} ... {i}", "xx", 0.1) for i in range(2000)]
    rows += [(5000 + i, f"ordo nulla quod est {i}", "xx", 0.1) for i in range(20)]
    rows += [(6000 + i, f"the and with from {i}", "en", 0.1) for i in range(40)]
    rows += [(7000, "the and with from", "en", 0.1)] * 500 + [(7000, "of other words", "en", 0.1)] * 500
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "hash", "chosen_id", "chosen_lang", "_share", "_place", "profile"):
        df = df.withColumn(name, F.lit("x"))
    seen = []
    fit = language.fit_model
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language, "fit_model", lambda p, names: seen.append(Counter(names)) or fit(p, names))
        model = language.learn_languages(df, F.lit(True), per_language=60)
        language.learn_languages(df.repartition(5), F.lit(True), per_language=60, fit_rows=30)
    assert model.languages == ["en", "xx"]
    assert seen[0] == {"en": 41, "xx": 20} and seen[1] == {"en": 15, "xx": 15}


def test_large_and_small_systems_agree(monkeypatch):
    rng = np.random.default_rng(4)
    profiles, names = rng.random((60, language.BUCKETS)), ["a", "b", "c"] * 20
    small = language.fit_model(profiles[:, :32], names)
    monkeypatch.setattr(language, "BUCKETS", 32)
    large = language.fit_model(profiles[:, :32], names)
    assert np.allclose(small.weights, large.weights) and np.allclose(small.bias, large.bias)


def test_language_by_plain_decoding(spark):
    """Every bit, its loss against each codeword and the belief, one number at a time."""
    words = {"de": "der die das und", "en": "the and with from", "fr": "les des une dans", "nl": "het een van ook"}
    rows = [(i, f"{text} {i}", lang, 0.0) for lang, text in words.items() for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.learn_languages(df, F.lit(True))
    texts = [*words.values(), "der and les van", "die DIE d\u00e9s!", "\u0436"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = asked.select("i", language.identify(model, F.col("t")).alias("f")).select("i", "f.*").collect()
    for row in got:
        profile = language.ngram_profile(texts[row["i"]])
        loss = []
        for k in range(len(model.languages)):
            total = 0.0
            for bit in range(model.codes.shape[1]):
                said = sum(float(p) * float(w) for p, w in zip(profile, model.weights[:, bit])) + model.bias[bit]
                total += model.trust[k][bit] * np.exp(-model.codes[k][bit] * min(4.0, max(-4.0, said)))
            loss.append(total)
        belief = sorted(((np.exp(-model.sharpness * x), k) for k, x in enumerate(loss)), reverse=True)
        share = belief[0][0] / sum(b for b, _ in belief)
        assert row["lang_pred"] == model.languages[belief[0][1]]
        assert abs(row["score"] - share) < 1e-9
        assert row["ambiguous"] == (belief[0][0] < 2 * belief[1][0])


def test_profile_counts_the_whole_text(monkeypatch):
    text = "Ab, é!" * 500
    whole = language.ngram_profile(text)
    monkeypatch.setattr(language, "CHUNK", 100)
    # n-grams over the edge of a chunk are counted in the next; shorter ones there twice
    assert np.abs(language.ngram_profile(text) - whole).max() < 0.03
    assert abs((whole**2).sum() - 1) < 1e-9


# -- quality


def test_quality_query(spark, documents):
    got = {r["doc_id"]: r for r in queries()["op6_quality"](spark, SF).collect()}
    assert sorted(got) == sorted(documents)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert {d for d, r in got.items() if r["held_out"]} == {d for d in documents if left(d, 5, 0)}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in labels if left(r["doc_id"], 5, 0)]
    assert np.mean(right) > 0.95


def plain_marginals(emit, trans):
    """By adding up all labellings."""
    n = len(emit)
    shares, pairs, total = np.zeros((n, 2)), np.zeros((2, 2)), 0.0
    for y in product((0, 1), repeat=n):
        p = np.exp(sum(emit[i][y[i]] for i in range(n)) + sum(trans[a][b] for a, b in zip(y, y[1:])))
        total += p
        for i in range(n):
            shares[i][y[i]] += p
        for a, b in zip(y, y[1:]):
            pairs[a][b] += p
    return shares / total, pairs / total, np.log(total)


def test_forward_backward():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 4, 2, 7])
    emit, trans = rng.normal(0, 2, (4, 7, 2)), rng.normal(0, 1, (2, 2))
    shares, pairs, partition = quality.marginals(emit, sizes, trans)
    for i, n in enumerate(sizes):
        want = plain_marginals(emit[i, :n], trans)
        assert np.allclose(shares[i, :n], want[0])
        assert np.allclose(pairs[i], want[1])
        assert np.isclose(partition[i], want[2])


def test_good_share_is_weighted_by_length(monkeypatch):
    model = quality.QualityModel(np.zeros(quality.FEATURES), np.zeros((2, 2)))
    model.weights[2] = -50.0  # share of upper case
    docs, lengths = zip(*(quality.document_features(t) for t in ("AAAA\nbbbbbbbbb", "b", "A\nA")))
    monkeypatch.setattr(quality, "ROUND", 2)
    shares = model.good_shares([d @ model.weights for d in docs], list(lengths))
    assert np.allclose(shares, [0.5 * 10 / 15, 0.5, 0.0], atol=1e-6)


def test_odd_quality_rows(spark):
    good = "The words of this line are all plain.\nAnd so are these words here."
    bad = "THESE!! WORDS!! ARE!! LOUD!!\nAND!! SO!! ARE!! THESE!!"
    rows = [(i, good if i % 2 else bad, "x", 0.0) for i in range(60)]
    rows += [(100, None, "x", 0.0), (101, "", "x", 0.0), (None, bad, "x", 0.0), (102, (good + "\n") * 5000, None, 0.0), (102, (good + "\n") * 5000, None, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(
        [(i, i % 2, None) for i in range(60)] + [(1, 1, 0), (None, 1, 0), (3, None, 0), (999, 1, 0)],
        "doc_id long, quality int, text string",
    )
    model = quality.learn_quality(df, labels, F.lit(True))
    got = df.select("doc_id", quality.quality_score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r["s"] <= 1 for r in got)
    assert all((r["s"] >= 0.3) == bool(r["doc_id"] % 2) for r in got if (r["doc_id"] or 100) < 100)
    assert [r["s"] > 0.5 for r in got if r["doc_id"] == 102] == [True, True]
    assert [r["s"] < 0.3 for r in got if r["doc_id"] is None] == [True]
    for none in (labels.limit(0), labels.where("quality = 1")):
        flat = quality.learn_quality(df, none, F.lit(True))
        assert df.select(quality.quality_score(flat, F.col("text"))).distinct().count() == 1
    assert df.limit(0).select(quality.quality_score(model, F.col("text"))).count() == 0


def test_long_marginals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 4095, 5000):
        score, trans = rng.normal(0, 3, n), rng.normal(0, 1, (2, 2))
        emit = np.stack([np.zeros(n), score], axis=1)[None]
        want = quality.marginals(emit, np.array([n]), trans)[0][0, :, 1]
        assert np.allclose(quality.long_marginals(score, trans), want)
    sure = quality.long_marginals(np.full(5000, 900.0), np.zeros((2, 2)))
    assert np.allclose(sure, 1.0)


def test_scores_by_all_labellings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    model = quality.QualityModel(rng.normal(0, 1, quality.FEATURES), rng.normal(0, 1, (2, 2)), 1.3, -0.2)
    texts = [None, "", "One line.", "A b\n\nA b\nLOUD!!! x x x\nend", "a\nB\nc c\nD.\n" * 2]
    monkeypatch.setattr(quality, "CHUNK", 2)
    monkeypatch.setattr(quality, "LONG", 4)
    for text, score in zip(texts, model.scores(texts)):
        features, lengths = quality.document_features(text)
        emit = np.stack([np.zeros(len(lengths)), features @ model.weights], axis=1)
        share = plain_marginals(emit, model.trans)[0][:, 1] @ lengths / lengths.sum()
        want = 1 / (1 + np.exp(-(1.3 * np.log(share / (1 - share)) - 0.2)))
        assert abs(score - want) < 1e-9
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", quality.quality_score(model, F.col("t")).alias("s")).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], model.scores(texts))


def test_quality_clashing_names_and_repeated_ids(spark, monkeypatch):
    rows = [(i, "Plain words here." if i % 2 else "LOUD!! WORDS!!", "x", 0.0) for i in range(60)]
    rows += [(1, "Plain words here.", "x", 0.0)] * 400 + [(1, "Other words.", "x", 0.0)] * 400
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for name in ("id", "good", "hash", "chosen_id", "_share", "_place", "features"):
        df, labels = df.withColumn(name, F.lit("x")), labels.withColumn(name, F.lit("x"))
    seen = []
    monkeypatch.setattr(quality, "fit_quality", lambda d, n, good: seen.append(Counter(good)))
    quality.learn_quality(df, labels, F.lit(True))
    assert seen == [{0.0: 30, 1.0: 30}]


# -- approximate search


def recall(got, ids, vectors, asked, k):
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q in asked:
        scores = vectors @ vectors[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        rows = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, min(k, len(ids) - 1) + 1))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        for r in rows:
            assert abs(r["score"] - scores[ids == r["vec_id"]][0]) < 1e-9 * (1 + abs(r["score"]))
        hits += len({r["vec_id"] for r in rows} & {int(ids[i]) for i in order}) / min(k, len(order))
    return hits / len(asked)


def test_ann_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    vectors = np.array([r["embedding"] for r in rows], float)
    got = queries()["op4_ann_search"](spark, SF).collect()
    assert recall(got, ids, vectors, ids[ids % 20 == 0], 20) >= 0.9


@pytest.mark.parametrize("norms", [False, True])
def test_ann_with_copies_and_norms(spark, norms):
    rng = np.random.default_rng(8)
    vectors = rng.normal(0, 1, (3000, 24)) + 2 * rng.normal(0, 1, (30, 24))[rng.integers(0, 30, 3000)]
    if norms:
        vectors *= rng.uniform(0.2, 3, (3000, 1))
    vectors[:900] = vectors[0]  # a hot vector
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "id long, vector array<double>")
    got = ann_search.approximate_top_k(
        df, df.where("id % 50 = 0"), 10, fit_rows=1000, list_rows=200, list_queries=16
    ).collect()
    assert recall(got, ids, vectors, ids[ids % 50 == 0], 10) >= 0.9


def test_scan_gives_up_only_far_pairs():
    rng = np.random.default_rng(9)
    rows, asked = rng.normal(0, 1, (2000, 96)), rng.normal(0, 1, (20, 96))
    far = ((asked[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    bound = np.sort(far, axis=1)[:, 50]
    a, b = ann_search.scan(rows, asked, bound, 16, 2.1)
    assert all(far[i, j] <= bound[i] + 1e-9 for i, j in zip(a, b))
    assert len(a) >= 0.97 * (far <= bound[:, None]).sum()
    exact = ann_search.scan(rows, asked, bound * (1 + 1e-12), 96, 2.1)
    assert len(exact[0]) == (far <= bound[:, None]).sum()


def test_odd_ann_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1),
        (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [2.0, 1.0], 1), (8, [2.0, 1.0], 2), (9, [-1.0, 3.0], 1),
    ]
    df = spark.createDataFrame(rows, "id long, vector array<float>, score int")
    got = [tuple(r) for r in ann_search.approximate_top_k(df, df, 3).orderBy("query_id", "rank").collect()]
    assert got == [
        (1, 1, 8, 2.0), (1, 2, 8, 2.0), (1, 3, 9, -1.0), (8, 1, 1, 2.0), (8, 2, 9, 1.0),
        (9, 1, 8, 1.0), (9, 2, 8, 1.0), (9, 3, 1, -1.0),
    ]
    assert ann_search.approximate_top_k(df.limit(0), df, 3).count() == 0
    assert ann_search.approximate_top_k(df, df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        ann_search.approximate_top_k(df.union(spark.createDataFrame([(10, [1.0], 1)], df.schema)), df, 3)


# -- helpers and pipeline


def test_numbered_spreads_one_group(spark):
    rows = [(0 if i < 500 else i % 3, i) for i in range(800)]
    got = numbered(spark.createDataFrame(rows, "g int, v int"), ["g"], ["v"], "n").collect()
    for g in (0, 1, 2):
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["v"])] == list(
            range(sum(a == g for a, _ in rows))
        )


def test_stages(spark, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language identification", "near-dedup", "substring dedup", "packing",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        before = after
    scored = {r["doc_id"]: r["predicted"] for r in queries()["op6_quality"](spark, SF).collect()}
    assert set(kept["quality classifier"]) == {d for d, p in scored.items() if p}
    assert len(kept["language identification"]) >= 0.99 * len(kept["quality classifier"])
    # one document of each group of near-duplicates stays: of texts that share 80 % of their five-word shingles
    left_over = sorted(kept["language identification"].items())
    assert set(kept["near-dedup"]) == {left_over[g][0] for g in plain_groups(left_over)}
    # one copy of each repeated line, and of sentences that repeat 50 words on end
    lines = {d: text for d, (text, _) in without_repeats(kept["near-dedup"].items()).items()}
    assert kept["substring dedup"] == lines
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == set(lines)
    assert Counter(r["length"] <= 4096 for r in packed) == {True: len(packed)}


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = documents_text = docs.where("lang = 'en'").first()["text"]
    odd = spark.createDataFrame(
        [(None, text, "en", "s", 1), (10**9, documents_text, "en", "s", 1), (10**9, text, "en", None, None),
         (10**9 + 1, None, None, None, None), (10**9 + 2, "", "en", "s", 0)], docs.schema,
    )
    before = docs.union(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, SF).cache()
        assert before.columns == docs.columns
    ids = Counter(r["doc_id"] for r in before.select("doc_id").collect())
    assert max(n for d, n in ids.items() if d is not None) == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
