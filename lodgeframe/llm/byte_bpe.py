"""Byte-level BPE: ranked merges folded over distinct words by higher-order functions."""

from __future__ import annotations

import base64
import json
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.llm.common import written
from lodgeframe.sources import scratch

#: Buckets of the rank map, a power of two: a literal map is searched from its start, so each is a short one.
BUCKETS = 1 << 16
#: Bytes of text whose distinct words are encoded together.
BLOCK_BYTES = 4 << 20
#: Most words that are merged once for the whole corpus, and the texts that they are counted in: about so many rows, none
#: of them longer than that. Only the time that is needed depends on these.
FREQUENT = 1 << 18
SAMPLE_ROWS = 20_000
SAMPLE_LENGTH = 20_000
#: Longer words are never among them.
FREQUENT_LENGTH = 64
#: Words of the corpus that are merged in one task.
FREQUENT_PART = 1 << 13
#: Merges of lowest rank that are made in all words of a block at once.
COMMON = 96
#: Stands between words; no token is written so.
BETWEEN = "\0"
#: A token is written as one character: its id and this, to leave out character 0.
SHIFT = 1
#: Ids from here on would meet the code points of surrogates.
MOST_IDS = 0xD800 - SHIFT


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that a token's own bytes come to under merges of lower rank; none if they do not."""
    parts = [token[i : i + 1] for i in range(len(token))]
    most = ranks[token]
    while len(parts) > 2:
        rank, at = min(
            (ranks.get(a + b, most), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
        )
        if rank >= most:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def merges(path: str) -> dict[str, str]:
    """For each pair of tokens that merges, the token it becomes; all written as characters.

    Every token must arise from its own bytes by merges of lower rank. Then it arises so in
    any text, always from the same last pair, and no merge makes a pair of lower rank than its own: all
    places of the lowest pair can be merged at once.
    """
    ranks = read_ranks(path)
    if len(ranks) > MOST_IDS or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not a byte-level vocabulary of at most {MOST_IDS} ids")
    found = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            pair = last_merge(token, ranks)
            if pair is None:
                raise ValueError(f"{path}: token {rank} does not arise from its bytes")
            found[_char(ranks[pair[0]]) + _char(ranks[pair[1]])] = _char(rank)
    return found


def _char(rank: int) -> str:
    return chr(rank + SHIFT)


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for pair, token in merges(path).items():
        signed = xxhash.xxh64_intdigest(pair.encode(), 42)
        buckets[signed % BUCKETS][pair] = token
    return json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))


def common_merges(words: Column, path: str) -> Column:
    """Fold the merges of lowest rank, in order, over all words of a block, written as one text.

    No merge makes a pair of lower rank than its own, so each is made once, wherever its pair stands.
    """
    lowest = sorted(merges(path).items(), key=lambda pair_token: pair_token[1])[:COMMON]
    listed = json.dumps([{"pair": p, "token": t} for p, t in lowest], ensure_ascii=False)
    ranked = F.from_json(F.lit(listed), "array<struct<pair: string, token: string>>")
    return F.aggregate(ranked, words, lambda text, m: F.replace(text, m["pair"], m["token"]))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged_word(word: Column, buckets: Column) -> Column:
    """Fold a word, one character a token, to the tokens that no merge is left for.

    Each step looks every neighbouring pair up in the rank map and replaces the pair of lowest rank (ranks
    order as characters do) wherever it stands, from the left.
    """

    def lookup(pair: Column) -> Column:
        bucket = F.xxhash64(pair).bitwiseAND(BUCKETS - 1).cast("int")
        return F.get(buckets, bucket)[pair]

    def step(state: Column) -> Column:
        chars = F.split(state["left"], "")
        pairs = lambda c: F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.concat(a, b))
        ended = F.struct(state["left"].alias("left"), F.lit(True).alias("ended"))

        def with_ranks(found: Column, ranks: Column) -> Column:
            def merged(low: Column) -> Column:
                pair = F.element_at(found, F.array_position(ranks, low).cast("int"))
                after = F.replace(state["left"], pair, low)
                return F.when(low.isNull(), ended).otherwise(
                    F.struct(after.alias("left"), F.lit(False).alias("ended"))
                )

            return _bound(F.array_min(ranks), merged)

        return F.when(state["ended"], state).otherwise(
            _bound(
                _bound(chars, pairs),
                lambda found: _bound(
                    F.transform(found, lookup), lambda ranks: with_ranks(found, ranks)
                ),
            )
        )

    start = F.struct(word.alias("left"), (F.length(word) < 2).alias("ended"))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
        start,
        lambda state, _: step(state),
        lambda state: state["left"],
    )


def _finder(pattern: str):
    """All matches of a pattern in a text; in texts of Latin-1 through the same pattern with its classes
    spelled out, if that finds the same in a trial."""
    find = regex.compile(pattern).findall
    latin = "".join(map(chr, range(256)))
    classes = {c: "".join(re.escape(x) for x in latin if regex.match(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    plain = pattern
    for name, inside in classes.items():
        # within brackets first, then by itself
        plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, inside), plain)  # noqa: B023
        plain = plain.replace(name, f"[{inside}]")
    plain = plain.replace(r"\S", f"[^{classes[r'\s']}]")
    rng = random.Random(0)
    trial = ["".join(rng.choices(latin, k=40)) for _ in range(300)]
    trial += ["".join(rng.choices(" \n\xa0a\xe9Z1\xb2'st.,=", k=40)) for _ in range(300)]
    try:
        quick = re.compile(plain).findall
        same = all(quick(t) == find(t) for t in trial)
    except re.error:
        same = False
    if not same:
        return find

    def either(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return find(text)
        return quick(text)

    return either


def _numbered(first: dict[str, int]) -> dict[str, int]:
    """Numbers words as they are asked for; those of ``first`` have theirs."""
    known: defaultdict[str, int] = defaultdict(None, first)
    known.default_factory = known.__len__
    return known


def _as_tokens(words: Iterator[str], path: str) -> str:
    """Words one after another, each byte written as the character of its token."""
    ranks = read_ranks(path)
    of_byte = {b: _char(ranks[bytes([b])]) for b in range(256)}
    return BETWEEN.join(w.encode(errors="replace").decode("latin-1").translate(of_byte) for w in words)


def _folded(words: Column, path: str) -> Column:
    """Words written by ``_as_tokens``, each folded to its tokens."""
    buckets = F.from_json(F.lit(_rank_json(path)), "array<map<string, string>>")
    listed = F.split(common_merges(words, path), BETWEEN)
    return F.array_join(F.transform(listed, lambda w: merged_word(w, buckets)), BETWEEN)


def _counted(pattern: str):
    """The words of each 500 texts and how often they occur."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                counts: Counter[str] = Counter()
                for text in batch.column("text").slice(start, 500):
                    counts.update(w for w in find(text.as_py()) if len(w) <= FREQUENT_LENGTH)
                yield pa.RecordBatch.from_pydict(
                    {"word": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())}
                )

    return emit


def frequent_words(docs: DataFrame, pattern: str, most: int, sample_rows: int) -> list[str]:
    """Words that occur more than once in a sample of the ``text`` of ``docs``: all from the least count on at which they
    are at most ``most``."""
    rows = docs.count()
    if not rows:
        return []
    texts = docs.select("text").sample(min(1.0, sample_rows / rows), 7)
    counts = texts.where(F.length("text") <= SAMPLE_LENGTH).mapInArrow(_counted(pattern), "word string, n long")
    with scratch.scope():
        words = written(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word-counts")
        left = least = 0
        for n, of_count in words.groupBy("n").count().orderBy(F.desc("n")).collect():
            left += of_count
            if left > most:
                break
            least = n
        return sorted(words.where(F.col("n") >= least).select("word").toArrow()["word"].to_pylist()) if least else []


def fold_words(spark: SparkSession, words: list[str], path: str) -> str:
    """The tokens of a bounded list of words, in its order, as ``_joined`` takes them."""
    parts = [
        (at, _as_tokens(islice(words, at, at + FREQUENT_PART), path)) for at in range(0, len(words), FREQUENT_PART)
    ]
    if not parts:
        return ""
    listed = spark.createDataFrame(parts, "at long, words string").repartition(len(parts))
    folded = listed.select("at", _folded(F.col("words"), path).alias("words")).collect()
    return BETWEEN.join(r["words"] for r in sorted(folded))


def _split(path: str, pattern: str, block_bytes: int, frequent: list[str]):
    """Texts of a partition as blocks: their distinct words but for the frequent ones, and for each text the
    numbers of its words, which go on from those of the frequent ones."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(pattern)
        first = {w: n for n, w in enumerate(frequent)}
        known = _numbered(first)
        ids: list[int | None] = []
        places: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([places], pa.list_(pa.binary())),
                    pa.array([_as_tokens(islice(known, len(first), None), path)]),
                ],
                names=["ids", "places", "words"],
            )

        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column("text")[at].as_py() or ""
                number = list(map(known.__getitem__, find(text)))
                ids.append(batch.column("doc_id")[at].as_py())
                places.append(np.array(number, "<u4").tobytes())
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    known, ids, places, size = _numbered(first), [], [], 0
        if ids:
            yield block()

    return emit


def _lengths_and_tokens(words: str) -> tuple[np.ndarray, np.ndarray]:
    listed = words.split(BETWEEN)
    tokens = np.frombuffer("".join(listed).encode("utf-16-le"), "<u2").astype("<u4") - SHIFT
    return np.fromiter(map(len, listed), np.int64, len(listed)), tokens


def _joined(path: str, with_bytes: bool, frequent: str, n_frequent: int):
    """Tokens of each text, from those of the frequent words and of its block's."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path) if with_bytes else None
        first_lengths, first_tokens = _lengths_and_tokens(frequent)
        first_lengths = first_lengths[:n_frequent]
        for batch in batches:
            for row in range(batch.num_rows):
                own_lengths, own_tokens = _lengths_and_tokens(batch.column("words")[row].as_py())
                lengths = np.concatenate([first_lengths, own_lengths])
                tokens = np.concatenate([first_tokens, own_tokens])
                starts = np.cumsum(lengths) - lengths
                doc_ids, places = batch.column("ids")[row].values, batch.column("places")[row].values
                for a in range(0, len(places), 200):
                    out = []
                    for raw in places.slice(a, 200).to_pylist():
                        place = np.frombuffer(raw, "<u4")
                        n = lengths[place]
                        at = np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        out.append(tokens[at])
                    columns = {
                        "doc_id": doc_ids.slice(a, 200),
                        "n_tokens": pa.array(list(map(len, out)), pa.int64()),
                        "ids": pa.array([x.tobytes() for x in out], pa.binary()),
                    }
                    if pieces:
                        texts = [b"".join(map(pieces, x.tolist())) for x in out]
                        columns["decoded"] = pa.array(texts, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    return emit


def _pieces(path: str):
    return {rank: token for token, rank in read_ranks(path).items()}.__getitem__


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    with_bytes: bool = False,
    frequent: int = FREQUENT,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit numbers) of every whole text.

    ``with_bytes`` adds ``decoded``, the bytes that the ids decode to, made in the same step.

    ``ranks`` is the path of a vocabulary of base64 tokens and ranks, ``pattern`` parts a text into words;
    each word is merged by itself. A missing text is an empty one and has no tokens. Repeated rows
    and missing ids are kept; other columns are ignored. A word of any length is merged as a whole.

    At most ``frequent`` words, the most frequent ones of about ``sample_rows`` texts, are merged once for all
    texts and sent to all tasks. All other distinct words of about ``block_bytes`` characters of text are merged together,
    whatever their number, in the task that read them; no text is shuffled. Which words were found frequent makes no
    difference to any result. ``docs`` is read twice, so it should be written.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    listed = frequent_words(texts, pattern, frequent, sample_rows)
    merged_once = fold_words(docs.sparkSession, listed, ranks)
    blocks = texts.mapInArrow(
        _split(ranks, pattern, block_bytes, listed), "ids array<long>, places array<binary>, words string"
    )
    merged = blocks.select("ids", "places", _folded(F.col("words"), ranks).alias("words"))
    more = ", decoded binary" if with_bytes else ""
    return merged.mapInArrow(
        _joined(ranks, with_bytes, merged_once, len(listed)), f"doc_id long, n_tokens long, ids binary{more}"
    )


def decode(ids: Column, ranks: str) -> Column:
    """The bytes that ids stand for: their pieces one after another. Missing ids stay missing."""

    @F.arrow_udf("binary")
    def pieces(column: pa.Array) -> pa.Array:
        table = _pieces(ranks)
        joined = [
            None if raw is None else b"".join(map(table, np.frombuffer(raw, "<u4").tolist())) for raw in column.to_pylist()
        ]
        return pa.array(joined, pa.binary())

    return pieces(ids)
