"""Exact substring dedup: repeated lines or paragraphs, by hashes of normalised units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.common import written
from lodgeframe.llm.membership import filter_of, holds
from lodgeframe.sources import scratch

#: Units that are passed on at once.
CHUNK = 1 << 16
#: Of a run of words: it begins where a line does, it ends where one does.
STARTS, ENDS = 1, 2
#: A sentence of a line, from its first letter or mark to its last; passages do not depend on it.
SENTENCE = re.compile(r"""\S.*?(?:[.!?…]+["')\]»”]*(?=\s)|[。！？]+|$)""", re.DOTALL)
#: A letter of Thai, Lao, Burmese, Khmer, Japanese or Chinese.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
#: Where a sentence ends although no space follows.
UNSPACED_END = re.compile("[。！？]+")
#: A word of a line; the end of such a sentence ends a word as well.
WORD = re.compile(r"[^\s。！？]*[。！？]+|[^\s。！？]+")
UNIT_SCHEMA = "doc_id long, version long, place int, start int, stop int, again boolean, high long, low long"


def split_units(text: str, separator: str) -> Iterator[tuple[int, int]]:
    """Offsets in characters of each unit, without the separator."""
    at = 0
    for unit in text.split(separator):
        yield at, at + len(unit)
        at += len(unit) + len(separator)


def is_long(unit: str, words: list[str], min_words: int) -> bool:
    """Whether a unit has words enough; in scripts without spaces two letters count as a word."""
    return len(words) >= min_words or len(UNSPACED.findall(unit)) >= 2 * min_words


class WordHashes(dict):
    """Hashes of words, of which a bounded number is remembered."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 1 << 18:
            self[word] = value
        return value


class Words:
    """Hashes of words, and sums of them from which 128 bits of any run of words follow at once.

    Runs of the same words have the same bits, whatever lines and sentences they are cut into.
    """

    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

    def __init__(self):
        self.known = WordHashes()
        self.powers = np.ones((2, 1), np.uint64)
        self.inverses = np.ones((2, 1), np.uint64)

    def hashed(self, words: list[str]) -> np.ndarray:
        """Two rows of numbers, the second mixed from the first."""
        one = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            other = (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.stack([one, other ^ (other >> np.uint64(32))])

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Of the first 0, 1, 2, ... words."""
        n = hashes.shape[1]
        if self.powers.shape[1] <= n:
            self.powers = self._powers(self.FACTORS.tolist(), 2 * n)
            self.inverses = self._powers([pow(f, -1, 1 << 64) for f in self.FACTORS.tolist()], 2 * n)
        with np.errstate(over="ignore"):
            total = np.cumsum(hashes * self.powers[:, :n], axis=1)
        return np.concatenate([np.zeros((2, 1), np.uint64), total], axis=1)

    @staticmethod
    def _powers(factors: list[int], size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            rows = [np.cumprod(np.full(size, f, np.uint64)) for f in factors]
        return np.concatenate([np.ones((2, 1), np.uint64), np.array(rows)], axis=1)

    def digests(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two rows of numbers for the runs of words from ``first`` to before ``end``."""
        with np.errstate(over="ignore"):
            return (sums[:, end] - sums[:, first]) * self.inverses[:, first] + (end - first).astype(np.uint64)


def marks(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place where ``least`` words begin: a number that depends on these words alone, the least hash of the few words on
    end among them, and the place of those. Texts that share that many words on end share such a number, however their sentences and
    lines are cut; neighbouring places mostly have one place in common."""
    width = max(1, min(8, least // 2))
    if len(words) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(grams)]
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        grams ^= grams >> np.uint64(29)
    among = least - width + 1
    at = np.arange(len(grams) - among + 1)
    for some in range(0, len(at), CHUNK):
        stretch = grams[some : some + CHUNK + among - 1]
        at[some : some + CHUNK] += np.lib.stride_tricks.sliding_window_view(stretch, among).argmin(axis=1)
    return grams[at], at


class Text:
    """A text's lines and words, and what tells whether any of them may occur elsewhere."""

    def __init__(self, text: str, separator: str, min_words: int, passage: int | None, words: Words):
        self.text, self.words, self.passage = text, words, passage
        #: offsets and first word of each line, and the end of its words; those that are long enough
        self.lines, self.long = [], []
        every = []
        for number, (a, b) in enumerate(split_units(text, separator)):
            unit = text[a:b].lower()
            found = unit.split()
            if is_long(unit, found, min_words):
                self.long.append(number)
            if UNSPACED_END.search(unit):
                # sentences end there, and so do their words
                found = UNSPACED_END.sub(r"\g<0> ", unit).split()
            self.lines.append((a, b, len(every), len(every) + len(found)))
            every += found
        self.hashes = words.hashed(every)
        self.sums = words.sums(self.hashes)
        first, end = (np.array([self.lines[n][i] for n in self.long], np.int64) for i in (2, 3))
        self.of_lines = words.digests(self.sums, first, end)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.marks, self.marked = marks(self.hashes[0], passage) if passage else none

    def short_digests(self) -> np.ndarray:
        """One number for each long line, and one for each place of marks."""
        apart = np.r_[True, self.marked[1:] != self.marked[:-1]] if len(self.marked) else np.zeros(0, bool)
        return np.concatenate([self.of_lines[0], self.marks[apart]])

    def repeated(self, filter_: Broadcast) -> tuple[np.ndarray, np.ndarray]:
        """Units that may occur elsewhere: rows of place, start and stop, and their digests in two rows.

        Lines, and with ``passage`` each that many words on end, so every word of a longer repeated passage is in some that
        are repeated too. They start at the first word, or where its line does, and stop where the line's next word begins,
        or at its end.
        """
        wanted = holds(filter_, self.marks)
        begins = np.array([self.lines[n][2] for n in self.long], np.int64)
        known = holds(filter_, self.of_lines[0])
        if len(wanted):
            # a line may also be what is a run elsewhere
            inside = begins < len(wanted)
            known[inside] |= wanted[begins[inside]]
        whole = STARTS + ENDS if self.passage else None
        lines = [
            (n if whole is None else whole, *self.lines[n][:2]) for n, again in zip(self.long, known) if again
        ]
        units = np.array(lines, np.int64).reshape(-1, 3).T
        found = [units], [self.of_lines[:, known]]
        if wanted.any():
            units, digests = self._windows(np.flatnonzero(wanted))
            found[0].append(units)
            found[1].append(digests)
        return np.concatenate(found[0], axis=1), np.concatenate(found[1], axis=1)

    def _windows(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``passage`` words from each of these on."""
        starts = [a for a, _, begin, end in self.lines if begin < end]
        begins = np.array([begin for _, _, begin, end in self.lines if begin < end])
        stops, ends = np.array([(b, end) for _, b, begin, end in self.lines if begin < end]).T
        begin_of = np.array([a + m.start() for a, b, *_ in self.lines for m in WORD.finditer(self.text[a:b])])
        last = first + self.passage - 1
        line, last_line = (np.searchsorted(begins, at, "right") - 1 for at in (first, last))
        opens, closes = begins[line] == first, ends[last_line] == last + 1
        begin = np.where(opens, np.array(starts)[line], begin_of[first])
        stop = np.where(closes, stops[last_line], begin_of[np.minimum(last + 1, len(begin_of) - 1)])
        place = opens * STARTS + closes * ENDS
        return np.stack([place, begin, stop]), self.words.digests(self.sums, first, last + 1)

    def whole(self) -> np.ndarray:
        """The units of repeated() of a text all of which occurs elsewhere, as few as will do."""
        spans = [self.lines[n][:2] for n in self.long]
        if len(self.marks):
            filled = [(a, b) for a, b, first, end in self.lines if first < end]
            spans.append((filled[0][0], filled[-1][1]))
        return np.array([(STARTS + ENDS, a, b) for a, b in spans], np.int64).reshape(-1, 3).T


def _not_copies(batch: pa.RecordBatch, holders: Broadcast | None) -> np.ndarray:
    """Which rows may be the first of equal texts: all that are, and few others."""
    if holders is None:
        return np.ones(batch.num_rows, bool)
    return holds(holders, batch.column("row").to_numpy().view(np.uint64))


def _short_digests(separator: str, min_words: int, passage: int | None, holders: Broadcast | None):
    """How often each short digest of a line or mark of a passage occurs in some of the texts, copies left out."""

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["digest", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found, held = [], 0
            for text in batch.column("text").filter(pa.array(_not_copies(batch, holders))):
                found.append(Text(text.as_py(), separator, min_words, passage, words).short_digests())
                held += len(found[-1])
                if held >= CHUNK:
                    yield packed(found)
                    found, held = [], 0
            if found:
                yield packed(found)

    return emit


def _units(separator: str, min_words: int, passage: int | None, repeated: Broadcast, holders: Broadcast | None):
    def packed(batch: pa.RecordBatch, rows: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        owner = np.repeat(rows, [u.shape[1] for u, _ in found]).astype(np.int64)
        units = np.concatenate([u for u, _ in found], axis=1)
        digests = np.concatenate([d for _, d in found], axis=1)
        # of equal units of a row the first is told from the others; what overlaps it is no copy of it
        order = np.lexsort((units[1], digests[1], digests[0], owner))
        same = np.zeros(len(order), bool)
        for values in (owner, digests[0], digests[1]):
            ordered = values[order]
            same[1:] |= ordered[1:] != ordered[:-1]
        same[:1] = True
        first = np.flatnonzero(same)[np.cumsum(same) - 1]
        again = np.zeros(len(order), bool)
        again[order] = units[1][order] >= units[2][order][first]
        again[order[same]] = units[1][order[same]] >= units[2][order[same]]
        # without a digest: of a copy, gone as a whole
        again |= (digests == 0).all(axis=0)
        rows = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows),
                batch.column("version").take(rows),
                *[pa.array(u.astype(np.int32)) for u in units],
                pa.array(again),
                *[pa.array(d.view(np.int64)) for d in digests],
            ],
            names=["doc_id", "version", "place", "start", "stop", "again", "high", "low"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows, found, held = [], [], 0
            for row, (text, other) in enumerate(zip(batch.column("text"), _not_copies(batch, holders).tolist())):
                parts = Text(text.as_py(), separator, min_words, passage, words)
                if other:
                    own = parts.repeated(repeated)
                else:
                    units = parts.whole()
                    own = units, np.zeros((2, units.shape[1]), np.uint64)
                if own[0].shape[1]:
                    rows.append(row)
                    found.append(own)
                    held += own[0].shape[1]
                if held >= CHUNK:
                    yield packed(batch, rows, found)
                    rows, found, held = [], [], 0
            if found:
                yield packed(batch, rows, found)

    return emit


def _merged(more: int):
    """Spans in order, those that touch or overlap made one; from the start of a line to the end of one,
    a span takes the separator of ``more`` characters along."""

    def of_text(spans: list[dict]) -> list[dict]:
        runs = []
        for s in spans:
            a, b, starts, ends = s["start"], s["stop"], s["place"] & STARTS, s["place"] & ENDS
            if runs and a <= runs[-1][1] + (more if runs[-1][2] and runs[-1][3] else 0):
                if b >= runs[-1][1]:
                    runs[-1][1], runs[-1][3] = b, ends
            else:
                runs.append([a, b, starts, ends])
        return [{"start": a, "stop": b + (more if starts and ends else 0)} for a, b, starts, ends in runs]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            out = [of_text(spans) for spans in batch.column("removed").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(out, kind)],
                names=["doc_id", "version", "removed"],
            )

    return emit


def repeated_units(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    separator: str = "\n",
    min_words: int = 5,
    passage: int | None = None,
) -> DataFrame:
    """Units to remove: ``doc_id``, ``version`` (hash of the text) and ``removed``, an ordered array of
    ``place`` (number of the unit from 0), ``start`` and ``stop``, offsets in characters of the original text.

    Of equal units the one in the document with the smallest ``doc_id`` stays, there its first
    occurrence. Units are equal if their words are, whatever their case and white space;
    units of fewer than ``min_words`` words (is_long()) are left alone, for a short line is no copied passage.
    Rows without an id or a text take no part. Rows that share an id are
    versions of one document: none of them makes a unit of another one repeated.

    With ``passage``, each that many words on end are a unit as well, wherever in a line they
    begin and end. Spans then reach to the next word, or past the separator, and
    are merged: ``removed`` has ``start`` and ``stop`` only, of the text with one separator behind it.
    Of equal texts only the first is looked through for them: the others are gone as a whole.

    Digests, not texts, are grouped. A first pass counts short digests of lines and marks() of passages; what occurs once, nearly all
    of it, is then left out by a filter of bounded size, and only what may repeat becomes a row. The number of rows per
    long digest and its smallest id combine before the shuffle; the join back to the units is a plain
    inner join whose large partitions can be split. The result is a written table; what it was made from is deleted.
    """
    with scratch.scope() as made:
        return made.keep(written(_repeated_units(docs, key, text, separator, min_words, passage), "spans"))


def _repeated_units(docs: DataFrame, key: str, text: str, separator: str, min_words: int, passage: int | None) -> DataFrame:
    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("version"),
        F.col(text).alias("text"),
    )
    holders = None
    if passage is not None:
        # a row is told by its id and text
        known = known.withColumn("row", F.xxhash64("doc_id", "version"))
        texts = known.groupBy("version", F.xxhash64(F.lit(1), "text").alias("other")).agg(F.min("doc_id").alias("first_id"))
        holders = filter_of(written(texts.select(F.xxhash64("first_id", "version").alias("row")), "holders"))
    counts = known.mapInArrow(_short_digests(separator, min_words, passage, holders), "digest long, n long")
    often = counts.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    repeated = filter_of(written(often, "repeated"))
    units = written(known.mapInArrow(_units(separator, min_words, passage, repeated, holders), UNIT_SCHEMA), "units")
    repeated.destroy()
    if holders is not None:
        holders.destroy()
    # written, so that the join below has a shuffle of its own, whose large partitions can be split
    firsts = (
        units.where(~F.col("again"))
        .groupBy("high", "low")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where("first_id < last_id")
        .drop("last_id")
    )
    firsts = written(firsts, "firsts")
    across = units.where(~F.col("again")).join(firsts, ["high", "low"]).where("doc_id > first_id")
    order = ["start", "stop", "place"] if passage else ["place", "start", "stop"]
    spans = ["doc_id", "version", *order]
    found = (
        across.select(*spans)
        .unionByName(units.where("again").select(*spans))
        .groupBy("doc_id", "version")
        .agg(F.sort_array(F.collect_set(F.struct(*order))).alias("removed"))
    )
    if passage is None:
        return found
    merged = "doc_id long, version long, removed array<struct<start: int, stop: int>>"
    return found.mapInArrow(_merged(len(separator)), merged)


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    separator: str = "\n",
    min_words: int = 5,
    passage: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated units, and ``removed_spans``.

    ``removed_spans`` is the ``removed`` of repeated_units(), an empty array where nothing
    goes; a column of this name in the input is replaced. Every row is kept, also one whose text becomes empty; a missing text
    or id leaves the row as it is. Repeated rows lose the same units.
    """
    found = repeated_units(docs, key, text, separator, min_words, passage)
    # names that no column of the input has
    spare = (f"repeats {i}" for i in count())
    of_id, of_version, removed, length = islice((n for n in spare if n not in docs.columns), 4)
    found = found.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "version", "removed"), (of_id, of_version, removed))])
    own, spans = F.col(f"`{text}`"), F.col(f"`{removed}`")
    # texts and spans meet by a shuffle at every size
    marked = docs.join(
        found.hint("merge"), (F.col(f"`{key}`") == F.col(f"`{of_id}`")) & (F.xxhash64(own) == F.col(f"`{of_version}`")), "left"
    ).withColumn(length, F.length(own))
    none = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    kept = [c for c in docs.columns if c != "removed_spans"]
    if passage is None:
        gone = spans["place"]
        units = F.split(own, f"\\Q{separator}\\E")
        left = F.array_join(F.filter(units, lambda unit, place: ~F.array_contains(gone, place)), separator)
    else:
        ended = F.concat(own, F.lit(separator))
        stops = F.concat(F.array(F.lit(0)), spans["stop"])
        starts = F.concat(spans["start"], F.array(F.length(ended)))
        gaps = F.arrays_zip(stops.alias("a"), starts.alias("b"))
        pieces = F.transform(gaps, lambda g: F.substring(ended, g["a"] + 1, g["b"] - g["a"]))
        joined = F.array_join(pieces, "")
        left = F.substring(joined, F.lit(1), F.greatest(F.length(joined) - len(separator), F.lit(0)))
    changed = F.when(spans.isNull(), own).otherwise(left)
    within = F.transform(spans, lambda s: F.struct(s["start"], F.least(s["stop"], F.col(f"`{length}`")).alias("stop")))
    return marked.select(
        *[changed.alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        F.coalesce(within, none).alias("removed_spans"),
    )
