"""Substring dedup, licence scan, tokens and packing."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodgeframe.llm import byte_bpe, licences, packing, unit_dedup
from lodgeframe.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, removed_spans string, ids string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_with_sql(spark, name):
    assert difference(queries()[name](spark, SF), connect(SF), oracle_sql()[name])[0] is None


# -- substring dedup

LINE = "one two three four five"


def test_repeats(spark):
    rows = [
        (2, f"{LINE}\nshort line\n{LINE}"), (1, f"head\n{LINE.upper()} \nshort line"), (3, None), (4, ""),
        (None, LINE), (5, LINE), (5, LINE), (6, "é " + LINE), (7, f"x\n\n  {LINE}\n"), (5, LINE + "\nother text"),
    ]
    got = unit_dedup.remove_repeats(docs(spark, rows))
    assert set(got.columns) == {"doc_id", "text", "removed_spans", "ids"}
    found = Counter((r["doc_id"], r["text"], tuple(map(tuple, r["removed_spans"]))) for r in got.collect())
    assert found == Counter(
        {
            (2, "short line", ((0, 23), (35, 58))): 1, (1, f"head\n{LINE.upper()} \nshort line", ()): 1,
            (3, None, ()): 1, (4, "", ()): 1, (None, LINE, ()): 1, (5, "", ((0, 23),)): 2,
            (6, "é " + LINE, ()): 1, (7, "x\n\n", ((3, 28),)): 1, (5, "other text", ((0, 23),)): 1,
        }
    )
    assert unit_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_repeats_in_a_long_text(spark):
    text = "\n".join(f"line {i % 5000} of a very long text" for i in range(20_000))
    got = unit_dedup.remove_repeats(docs(spark, [(1, text)])).first()
    assert got["text"] == "\n".join(f"line {i} of a very long text" for i in range(5000))
    assert [text[a:b] for a, b in got["removed_spans"]] == text.split("\n")[5000:]


def test_paragraphs(spark):
    rows = [(1, "a b c d e\nf\n\nother"), (2, "new\n\nA B  C d e f")]
    got = unit_dedup.remove_repeats(docs(spark, rows), separator="\n\n").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["a b c d e\nf\n\nother", "new"]


# -- licences


def found_licences(spark, *texts):
    df = docs(spark, list(enumerate(texts)))
    return [[tuple(h) for h in r["hits"]] for r in licences.scan_licences(df).orderBy("doc_id").collect()]


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of Some Company Ltd. nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission."""


def test_licences_with_names_and_tags(spark):
    texts = [
        BSD + NAMES, BSD, BSD + "3. Neither the name of this nor that.", "// SPDX-License-Identifier: MIT\ncode",
        "SPDX-License-Identifier: bsd-3-clause */", "SPDX-License-Identifier: Unheard-Of", "SPDX-License-Identifier:",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
        "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\n"
        "as published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.",
        "This is free and unencumbered software released into the public domain.", "Neither the name of anything.",
    ]
    got = [[h[0] for h in hits] for hits in found_licences(spark, *texts)]
    assert got == [
        ["BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-2-Clause"], ["MIT"], ["BSD-3-Clause"], [], [], ["MPL-2.0"],
        ["GPL-2.0-or-later"], ["Unlicense"], [],
    ]


def test_rules(spark):
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License");\n'
        "you may not use this file except in compliance with the License.\n"
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    )
    mit = "Released under the MIT License."
    text = f"Some words. {mit} More.\nALL RIGHTS RESERVED"
    end = apache.index("You may obtain") - 1
    assert found_licences(spark, apache, text, None, "", "the MIT", mit + " " + mit) == [
        [("Apache-2.0", 0, end)],
        [("MIT", 12, 43), ("LicenseRef-all-rights-reserved", 50, 69)],
        [], [], [],
        [("MIT", 0, 31), ("MIT", 32, 63)],
    ]


def test_wrapped_sentence(spark):
    sentence = licences.SENTENCES["mit-notice"][0]
    wrapped = sentence.replace(" and ", " and\n")
    assert found_licences(spark, wrapped, sentence.replace("copies", "some copies")) == [[], []]
    grant = licences.SENTENCES["mit-grant"][0].replace(" the ", "\nthe ")
    got = found_licences(spark, f"{grant}\n\n{wrapped}")
    assert got == [[("MIT", 0, len(grant) + 2 + len(wrapped))]]


def test_rules_in_all_orders():
    rules = [("long", ["a", "b", "c"]), ("short", ["a"]), ("tail", ["b", "c"])]
    seen = lambda s: [(c, 10 * i, 10 * i + 5) for i, c in enumerate(s)]
    names = lambda s: [m[0] for m in licences.matched(seen(s), rules, 100)]
    assert names("abc") == ["long"]
    assert names("abbc") == ["short", "tail"]
    assert names("cabcab") == ["long", "short"]
    assert licences.matched([("a", 0, 5), ("b", 500, 505), ("c", 510, 515)], rules, 100)[0][0] == "short"


def test_licence_query_by_plain_search(spark):
    got = {r["doc_id"]: r["licences"] for r in queries()["op3_licences"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        lines = {line.strip() for line in r["text"].split("\n")}
        assert ("CC-BY-NC-4.0" in got[r["doc_id"]]) == ("Licensed under CC BY-NC 4.0." in lines)
        assert ("MIT" in got[r["doc_id"]]) == ("Released under the MIT License." in lines)


def test_licences_of_no_rows(spark):
    assert licences.scan_licences(docs(spark, [])).count() == 0


# -- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(spark, texts, **more):
    df = docs(spark, list(enumerate(texts)))
    got = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, **more)
    got = got.withColumn("back", byte_bpe.decode(F.col("ids"), RANKS)).collect()
    by_id = {r["doc_id"]: r for r in got}
    return [
        (np.frombuffer(by_id[i]["ids"], "<u4").tolist(), bytes(by_id[i]["back"]), by_id[i]["n_tokens"])
        for i in range(len(texts))
    ]


def strange_texts():
    rng = random.Random(4)
    pools = [
        "abc ABC'st\n\t 019.,!?", "éüßñçø ", "日本語テキスト、。", "🙂👩‍👩‍👧‍ ", "\x00\x01\x1c\x1f\x85\xa0 　 a",
        "٣४½²ⅷ ", "ﬁǅאבجد̀́ ", "=-_*#/\\",
    ]
    texts = ["", " ", "\n\n\n", "a", "a" * 5000, " " * 3000, "=" * 999 + "a", "don't I'll it's"]
    texts += ["".join(rng.choice(p) for _ in range(60)) for p in pools for _ in range(6)]
    texts += ["".join(rng.choice("".join(pools)) for _ in range(200)) for _ in range(30)]
    texts.append("".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(1500)))
    return texts


def test_encoding_and_decoding(spark, encoding):
    texts = strange_texts()
    for text, (ids, back, n) in zip(texts, encoded(spark, texts, block_bytes=700)):
        assert ids == encoding.encode_ordinary(text) and n == len(ids)
        assert back == text.encode()


@pytest.mark.parametrize("frequent", [0, 1, 7, 1000])
def test_frequent_words_change_no_result(spark, encoding, frequent, monkeypatch):
    monkeypatch.setattr(byte_bpe, "FREQUENT_PART", 3)
    texts = ["the one the two", "the \x00 the \x00 日本 日本", "", "one " * 40, "x" * 90 + " " + "x" * 90, " "]
    got = encoded(spark, texts, block_bytes=20, frequent=frequent)
    assert [(ids, back) for ids, back, _ in got] == [(encoding.encode_ordinary(t), t.encode()) for t in texts]


def test_frequent_words(spark):
    df = docs(spark, [(1, "b a b a b d"), (2, "a c a d"), (3, None), (4, "y" * 65 + "\n" + "y" * 65)])
    df = df.select("doc_id", "text")
    for most, words in [(10, ["a", "b", "d"]), (2, ["a", "b"]), (1, ["a"]), (0, [])]:
        assert byte_bpe.frequent_words(df, r"[a-z]+", most, 100) == words
    assert byte_bpe.frequent_words(df.limit(0), r"[a-z]+", 1, 100) == []


def test_bpe_query(spark, encoding):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op10_byte_bpe"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = encoding.encode_ordinary(r["text"])
        hashes = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), r["text"].encode())]
        assert got[r["doc_id"]] == (len(ids), *hashes)


def test_bpe_of_odd_rows(spark):
    df = docs(spark, [(None, "a b"), (1, None), (1, None), (2, "a b")])
    got = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 0), ("1", 0), ("2", 2), ("None", 2)]
    assert byte_bpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_vocabulary_that_does_not_merge_is_refused(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}  # no way from bytes to abc
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    with pytest.raises(ValueError):
        byte_bpe.merges(str(path))


# -- packing


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(WORDS)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def word_encoder():
    return packing.WordEncoder(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words_any_text(tokenizer, word_encoder, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert next(word_encoder.encode([text.encode()])) == np.array(ids, "<u4").tobytes()


def test_words_strange_texts(tokenizer, word_encoder):
    texts = [*strange_texts(), "a ~ b ~~ ~", "~", "x~ y", "<|endoftext|> don't ONE!! É. ÿ* Straße, |a|", "'s 't's it's."]
    got = list(word_encoder.encode([t.encode() for t in texts]))
    for text, ids in zip(texts, got):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_memory_of_words_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    encoder = packing.WordEncoder(WORDS)
    for i in range(20):
        text = " ".join(f"word{chr(97 + i)}{chr(97 + j)}x" for j in range(6))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert next(encoder.encode([text.encode()])) == np.array(ids, "<u4").tobytes()
        assert len(encoder.known) < 40


def total(plan):
    held = Counter()
    for lengths, n in plan:
        for x in lengths:
            held[x] += n
    return dict(held), sum(n for _, n in plan)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
def test_plan_holds_every_piece_once(histogram):
    plan = packing.packing_plan(histogram, 64, stride=1)
    held, sequences = total(plan)
    assert held == histogram
    assert all(0 < sum(lengths) <= 64 for lengths, _ in plan)
    least = -(-sum(x * n for x, n in histogram.items()) // 64)
    halves = sum(n for x, n in histogram.items() if x > 32)
    assert sequences >= max(least, halves)
    # first fit decreasing is never worse than 11/9 of the best plus 1; so is best fit
    assert sum(n for _, n in packing.best_fit(histogram, 64)) <= 2 * least + 1


def test_plan_is_tight_for_many_documents():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(6.6, 1.0, 50_000).astype(int) + 1, 4096)
    histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    _, sequences = total(packing.packing_plan(histogram, 4096))
    least = -(-int(lengths.sum()) // 4096)
    assert sequences <= 1.01 * least


def test_fit_recovers_counts():
    rows = np.array([[5, 3, 0], [4, 4, 0], [8, 0, 0], [4, 2, 2]])
    histogram = np.zeros(9)
    for row, n in zip(rows, (7, 5, 3, 2)):
        for x in row[row > 0]:
            histogram[x] += n
    assert np.allclose(packing.fit(histogram, rows, 3000), [7, 5, 3, 2], atol=0.05)


def test_packed_documents(spark, tokenizer):
    import zlib

    got = queries()["op5_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = set()
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.add((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(w[3] for w in want) // 4096)
    assert least <= len(sequences) <= least + 2


def test_packing_odd_rows(spark):
    rows = [(None, "a b c"), (1, None), (1, None), (2, ""), (3, "word " * 10_000)]
    pieces = packing.token_pieces(docs(spark, rows), WORDS).drop("ids").cache()
    got = packing.pack(pieces).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in got) == [
        ("1", 0, 1), ("1", 0, 1), ("2", 0, 1), ("3", 0, 4096), ("3", 1, 4096), ("3", 2, 1809), ("None", 0, 4),
    ]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 7
    assert packing.pack(pieces.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces, capacity=100)


