"""Phrases whose words stand together more often than apart, by counts kept in prefix and in suffix order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.llm.common import written

#: Bytes of text that are looked at together.
CHUNK = 4 << 20
#: Bits of the filter of frequent phrases, whatever their number. It only spares work: what passes is counted exactly.
FILTER_BITS = 1 << 26
COUNTS = "lang string, phrase string, f long"

WORD, SPACE, BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def pieces(kinds: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``CHUNK`` bytes that end where a text or a piece does. A longer piece is one stretch."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = end
        if end - at > CHUNK:
            stop = int(offsets[np.searchsorted(offsets, at + CHUNK, "right") - 1])
            if stop <= at:
                breaks = np.flatnonzero(kinds[at + 1 : at + CHUNK] == BREAK)
                stop = at + 1 + int(breaks[-1]) if len(breaks) else 0
            if not stop:
                stop = int(offsets[np.searchsorted(offsets, at, "right")])
                later = np.argmax(kinds[at + CHUNK : stop] == BREAK) if stop > at + CHUNK else 0
                stop = at + CHUNK + int(later) if later else stop
        yield at, stop
        at = stop


class Words:
    """The words of a stretch of texts: numbers into ``names``, the piece and the language each stands in."""

    def __init__(self, data: np.ndarray, kinds: np.ndarray, first: np.ndarray, lang: np.ndarray):
        inside = kinds == WORD
        begins = np.zeros(len(data) + 1, bool)
        begins[first] = True
        before = np.r_[False, inside[:-1]] & ~begins[:-1]
        starts = np.flatnonzero(inside & ~before)
        behind = np.r_[inside[1:], False] & ~begins[1:]
        ends = np.flatnonzero(inside & ~behind) + 1
        self.piece = np.cumsum((kinds == BREAK) | begins[:-1], dtype=np.int32)[starts]
        self.lang = lang[np.searchsorted(first, starts, "right") - 1]
        offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
        text = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
        )
        found = text.dictionary_encode()
        self.names = found.dictionary
        self.numbers = found.indices.to_numpy().astype(np.int64)

    def together(self, size: int) -> np.ndarray:
        """Places where ``size`` words stand in one piece."""
        total = len(self.piece) - size + 1
        return np.flatnonzero(self.piece[:total] == self.piece[size - 1 :]) if total > 0 else np.zeros(0, int)


def mixed(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A number for a phrase of a language, of the hashes of both."""
    value = lang
    with np.errstate(over="ignore"):
        for word in words:
            value = (value ^ word) * _MIX[0]
            value ^= value >> np.uint64(29)
            value *= _MIX[1]
            value ^= value >> np.uint64(32)
    return value


def hashes(names: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n) for n in names.to_pylist()], np.uint64)


def places(values: np.ndarray) -> list[np.ndarray]:
    return [values % np.uint64(FILTER_BITS), (values >> np.uint64(37)) % np.uint64(FILTER_BITS)]


def _counter(size: int, frequent: Broadcast | None):
    """Counts of phrases of ``size`` words in each stretch of text; those with a part that is not frequent are left out."""

    def known(values: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(frequent.value, np.uint8)
        return np.logical_and.reduce(
            [(bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in places(values)]
        )

    def counted(words: Words, langs: pa.Array) -> pa.RecordBatch:
        at = words.together(size)
        if frequent is not None and len(at):
            hashed, of_lang = hashes(words.names)[words.numbers], hashes(langs.cast(pa.binary()))[words.lang]
            short = np.zeros(len(words.numbers), bool)
            begin = words.together(size - 1)
            short[begin] = known(mixed(of_lang[begin], [hashed[begin + i] for i in range(size - 1)]))
            at = at[short[at] & short[at + 1]]
        code, wide = words.lang[at].astype(np.int64), len(words.names)
        most = len(langs)
        for i in range(size):
            if most * wide >= 1 << 62:
                distinct, code = np.unique(code, return_inverse=True)
                most = len(distinct)
            code, most = code * wide + words.numbers[at + i], most * wide
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        at = at[first]
        parts = [words.names.take(pa.array(words.numbers[at + i])).cast(pa.large_string()) for i in range(size)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
        return batch(langs.take(pa.array(words.lang[at])), phrase, counts)

    def totals(words: Words, langs: pa.Array) -> pa.RecordBatch:
        """All words of a language, as the count of the phrase of none."""
        counts = np.bincount(words.lang, minlength=len(langs))
        return batch(langs, pa.array([""] * len(langs), pa.large_string()), counts)

    def batch(lang: pa.Array, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [lang, phrase.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"]
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, named = rows.column("text").cast(pa.large_binary()), rows.column("lang").dictionary_encode()
            if not len(texts):
                continue
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            whole = texts.buffers()[2]
            data = np.frombuffer(whole.to_pybytes().translate(_LOWER) if whole else b"", np.uint8)
            kinds, lang = _KIND[data], named.indices.to_numpy()
            for a, b in pieces(kinds, offsets):
                low = np.searchsorted(offsets, a, "right") - 1
                high = np.searchsorted(offsets, b, "left")
                first = np.maximum(offsets[low:high], a) - a
                words = Words(data[a:b], kinds[a:b], first, lang[low:high])
                yield counted(words, named.dictionary)
                if size == 1:
                    yield totals(words, named.dictionary)

    return emit


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of phrases in the filter, as bits of 64-bit words."""
    for rows in batches:
        lang, phrases = hashes(rows.column("lang").cast(pa.binary())), rows.column("phrase").to_pylist()
        if not phrases:
            continue
        split = [p.encode().split(b" ") for p in phrases]
        words = [hashes(pa.array([s[i] for s in split], pa.binary())) for i in range(len(split[0]))]
        at = np.concatenate(places(mixed(lang, words)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((at >> np.uint64(6)).astype(np.int32)),
                pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64)),
            ],
            names=["at", "bits"],
        )


def frequent_filter(phrases: DataFrame) -> Broadcast:
    """A filter of ``FILTER_BITS`` bits that lets all of these phrases through, of one length in words each.

    Built in the tasks; the driver gets its 64-bit words that are not zero, at most ``FILTER_BITS`` / 64 rows.
    """
    found = phrases.mapInArrow(_bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, lang: str, text: str, longest: int, least: int) -> list[DataFrame]:
    """For 0 to ``longest`` words, ``lang``, ``phrase`` and ``f`` of all phrases counted ``least`` times or more.

    A phrase is counted only where both its parts of one word less are frequent, which loses none. The phrase of no
    words is counted once for each word.
    """
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")
    )
    levels = []
    for size in range(1, longest + 1):
        passing = frequent_filter(levels[-1]) if levels else None
        found = rows.mapInArrow(_counter(size, passing), COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found = written(found.where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{size}")
        if not levels:
            levels.append(found.where("phrase = ''"))
        levels.append(found.where("phrase <> ''"))
        if passing is not None:
            passing.destroy()
    return levels


def _heads(longest: int):
    """For each phrase the counts of the phrases that it begins with, as far as they stand in the same partition."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, path, first = None, [], True
        kind = pa.list_(pa.int64())
        for rows in batches:
            out, heads = [], []
            for own, words, f in zip(*[rows.column(c).to_pylist() for c in ("lang", "words", "f")]):
                if own != lang:
                    lang, path = own, []
                # what is left of the path are the phrases that this one begins with
                while path and (len(path[-1][0]) >= len(words) or words[: len(path[-1][0])] != path[-1][0]):
                    path.pop()
                counts = [None] * longest
                for earlier, count in path:
                    counts[len(earlier) - 1] = count
                out.append(counts)
                heads.append(first)
                first = False
                path.append((words, f))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(out, kind), pa.array(heads, pa.bool_())],
                names=[*rows.schema.names, "counts", "head"],
            )

    return emit


def counts_of_heads(stream: DataFrame, longest: int) -> DataFrame:
    """``stream`` (``lang``, ``words``, ``f``) with ``counts``: f of the first word, the first two, and so on below its length.

    The stream is put in order of its words, where a phrase comes after the phrases it begins with and before all
    that do not begin so: one pass with those on the way is enough, and no partition has to hold all phrases of a word. What a
    partition misses of them begins its first phrase, so it is looked up for that one only.
    """
    placed = written(
        stream.repartitionByRange("lang", "words")
        .sortWithinPartitions("lang", "words")
        .mapInArrow(
            _heads(longest), "lang string, words array<string>, f long, counts array<long>, head boolean"
        )
        .withColumn("part", F.spark_partition_id()),
        "in-order",
    )
    # at most ``longest`` rows a partition
    wanted = placed.where("head and size(words) > 1").select(
        "part", "lang", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> slice(words, 1, k))")).alias("words")
    )
    missing = (
        placed.select("lang", "words", "f")
        .join(F.broadcast(wanted), ["lang", "words"])
        .groupBy("part")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.size("words"), "f"))).alias("before"))
    )
    looked_up = lambda c, i: F.coalesce(c, F.when(i + 1 < F.size("words"), F.col("before")[i + 1]))
    return placed.join(F.broadcast(missing), "part", "left").select(
        "lang", "words", "f", F.transform("counts", looked_up).alias("counts")
    )


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = 5,
    least: int = 100,
    covered: int = 100,
) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``n`` and ``score`` of all phrases of 2 to ``longest`` words that count.

    Texts are lower-cased in A-Z and cut at ``. , ; : ! ?`` and line ends into pieces, these at spaces and tabs into words. Everything is
    per language (a missing one is ``und``): ``n`` words, ``a`` occurrences of the phrase, ``l`` and ``r`` of its first and its
    remaining words at the cut where ``score`` = floor(1000 a n / (l r)) is least, of equal ones the earliest. Phrases need ``a`` of at least
    ``least``, and go where a longer one of these around them has ``covered`` percent of their count. Exact: sums are
    of whole numbers, products decimals of 38 digits (beyond that an error). Missing and empty texts and empty tables have no
    phrases; repeated rows count each time; other columns are ignored, whatever their names.

    One pass over the texts for each length. The counts are then put in prefix order, where each phrase meets the counts of
    what it begins with, and in suffix order for what it ends with; the two streams are merged by phrase. A phrase of one more
    word has the count of each shorter one in it as an upper bound, so only those of one word more need to be looked at: they
    meet the phrase in these streams too.
    """
    if not 2 <= longest:
        raise ValueError("phrases have two words at least")
    levels = phrase_counts(docs, lang, text, longest, least)
    words = F.split("phrase", " ")
    stream = reduce(DataFrame.unionByName, levels[1:]).select("lang", words.alias("words"), "f")
    prefixes = written(counts_of_heads(stream, longest), "prefix-order")
    backwards = stream.withColumn("words", F.reverse("words"))
    suffixes = counts_of_heads(backwards, longest).select("lang", F.reverse("words").alias("words"), "f", "counts")
    suffixes = written(suffixes, "suffix-order")

    def extended(counts: DataFrame, skipped: int) -> DataFrame:
        """Phrases that one of one word more covers."""
        size = F.size("words")
        held = F.element_at("counts", F.greatest(size - 1, F.lit(1)))
        return counts.where((size > 2) & (F.col("f") * 100 >= held * covered)).select(
            "lang", F.slice("words", F.lit(1 + skipped), size - 1).alias("words")
        )

    gone = extended(prefixes, 0).unionByName(extended(suffixes, 1)).distinct()
    candidates = (
        prefixes.where("size(words) > 1")
        .join(suffixes.select("lang", "words", F.col("counts").alias("rights")).hint("merge"), ["lang", "words"])
        .join(gone.hint("merge"), ["lang", "words"], "left_anti")
        # one row a language
        .join(levels[0].select("lang", F.col("f").alias("n")), "lang")
    )
    cuts = F.expr(
        "transform(sequence(1, size(words) - 1), k -> struct("
        " cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0))"
        "   div (cast(counts[k - 1] as decimal(19,0)) * cast(rights[size(words) - k - 1] as decimal(19,0))) as score,"
        " k, counts[k - 1] as l, rights[size(words) - k - 1] as r))"
    )
    best = candidates.withColumn("cut", F.array_min(cuts))
    return best.select(
        "lang", F.array_join("words", " ").alias("phrase"), "words", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"
    )


def top_collocations(docs: DataFrame, most: int = 2000, **how) -> DataFrame:
    """The first ``most`` phrases of each language, by score, then count (both falling), then phrase; ``rank`` from 1."""
    found = collocations(docs, **how)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
