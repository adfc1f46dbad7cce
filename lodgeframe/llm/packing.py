"""Packing of tokenised documents: patterns of a few lengths fitted to the histogram of lengths."""

from __future__ import annotations

import os
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.common import numbered

#: Beyond so many words a worker's memory starts anew, with as many of the time before at hand.
REMEMBERED = 300_000
#: Texts whose pieces leave a worker together.
TEXTS = 512

_FORMATS = [struct.Struct(f"<{n}I") for n in range(32)]
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of text by a tokenizer that drops white space, word by word.

    White space ends every token of such a vocabulary, so the ids of a text are those of
    its words one after another, and words repeat far more than texts do. New words of letters with
    marks behind them go straight to the tokenizer's model; others go through the whole tokenizer.
    """

    MARK = "~"
    #: Words of one run of letters and one of other marks: they need no normalisation but lower case.
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@[-`{-~]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are text
        mark = self._ids(self.MARK)
        if len(mark) != 1 or self._ids(f" a\n{self.MARK} b") != self._ids("a") + mark + self._ids("b"):
            raise ValueError(f"{path} does not tokenise word by word")
        self.known = Known(self, {})
        # what the pre-tokenizer writes for a character, if simple words are two pieces to it
        marks = "".join(chr(c) for c in range(33, 127) if self.SIMPLE.fullmatch(chr(c)))
        self.marks = "".join(c for c in marks if not c.isalpha()).encode()
        letters = marks + "".join(map(chr, range(0xC0, 0x100))).replace("×", "").replace("÷", "")
        before = self.tokenizer.pre_tokenizer
        self.spelled = {ord(c): before.pre_tokenize_str(c)[0][0] for c in letters}
        self.simple = all(
            self._simple(self.SIMPLE.fullmatch(w)) == self._packed(self._ids(w))
            for w in ("Hello", "Çà.", "ÿ", "ONE!!", "***", "a|", "Straße,", "(", "Ünïcödé?!")
        )

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return _FORMATS[len(ids)].pack(*ids) if len(ids) < len(_FORMATS) else struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        """Ids of a run of letters or marks; it is a word too, so other words with it find it known."""
        run = run.lower()
        key = run.encode()
        ids = self.known.get(key) or self.known.older.get(key)
        if ids is None:
            pieces = self.tokenizer.model.tokenize(run.translate(self.spelled))
            ids = self.known[key] = self._packed([p.id for p in pieces])
        return ids

    def _simple(self, match: re.Match) -> bytes:
        return b"".join(map(self._run, filter(None, match.groups())))

    def learned(self, word: bytes) -> bytes:
        """Ids of a word that is not known."""
        if self.simple:
            letters = word.rstrip(self.marks)
            if letters.isalpha():  # the common case, without a pattern: ASCII letters with marks behind them
                marks = word[len(letters) :]
                return self._run(letters.decode()) + (self._run(marks.decode()) if marks else b"")
        text = word.decode(errors="replace")
        match = self.simple and self.SIMPLE.fullmatch(text)
        return self._simple(match) if match else self._packed(self._ids(text))

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit numbers."""
        for text in texts:
            if len(self.known) > REMEMBERED:
                self.known = Known(self, self.known)
            # a tokenizer that takes simple words in lower case does so with all, so A-Z may be lowered before
            words = (text.lower() if self.simple else text).split()  # ASCII white space, which every tokenizer counts as such
            yield b"".join(map(self.known.__getitem__, words))


class Known(dict):
    """Ids of words: those met since the memory was last full, and those of the time before, which come back when met."""

    def __init__(self, encoder: WordEncoder, older: dict[bytes, bytes]) -> None:
        self.encoder, self.older = encoder, dict(older)  # without what was older still

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoder.learned(word)
        self[word] = ids
        return ids


def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces(path: str, end_id: int, capacity: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [t or b"" for t in part.column("text").to_pylist()]
                owner, piece, start, ids = [], [], [], []
                for row, raw in enumerate(encoder.encode(texts)):
                    raw += end
                    for number, a in enumerate(range(0, len(raw), 4 * capacity)):
                        owner.append(row)
                        piece.append(number)
                        start.append(a // 4)
                        ids.append(raw[a : a + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(owner, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return emit


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``piece`` (from 0), ``start``, ``length``, ``ids`` of every document.

    A document is its text's ids and ``end_id``; only one longer than ``capacity`` is cut. ``ids``
    are little-endian unsigned 32-bit numbers. A missing text is an empty one: one piece of
    length 1. Repeated rows and missing ids give pieces of their own; other columns are ignored.
    """
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
    ).mapInArrow(
        _pieces(tokenizer, end_id, capacity),
        "doc_id long, piece int, start long, length long, ids binary",
    )


# -- the plan, on the histogram alone: as many counts as there are lengths, whatever the input


def patterns(capacity: int, stride: int) -> np.ndarray:
    """Full sequences of one, two and three lengths, descending; unused places are 0.

    All pairs; of the triples those whose two smaller lengths differ by a multiple of ``stride``.
    """
    one = np.array([[capacity, 0, 0]])
    half = np.arange(1, capacity // 2 + 1)
    two = np.stack([capacity - half, half, np.zeros_like(half)], axis=1)
    three = []
    for least in range(1, capacity // 3 + 1):
        middle = np.arange(least, (capacity - least) // 2 + 1, stride)
        three.append(np.stack([capacity - least - middle, middle, np.full_like(middle, least)], axis=1))
    return np.concatenate([one, two, *three])


def fit(histogram: np.ndarray, rows: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative repeat counts of patterns, by least squares on the histogram.

    Multiplicative updates: they keep counts non-negative and need one pass over the patterns each.
    """
    places = len(histogram)
    used = rows > 0
    cells = np.where(used, rows, 0)

    def made(x: np.ndarray) -> np.ndarray:
        out = np.zeros(places)
        for c in range(rows.shape[1]):
            out += np.bincount(cells[:, c], weights=x * used[:, c], minlength=places)
        return out

    def seen(h: np.ndarray) -> np.ndarray:
        return (h[cells] * used).sum(axis=1)

    target = seen(histogram)
    x = np.where(target > 0, np.minimum.reduce(np.where(used, histogram[cells], np.inf), axis=1), 0.0)
    x = x * min(1.0, histogram.sum() / max(1.0, made(x).sum()))
    for _ in range(rounds):
        x *= target / np.maximum(seen(made(x)), 1e-12)
    return x


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that takes it; equal sequences are handled together."""
    groups: dict[int, list[list]] = {}  # free space: [lengths, how many]
    free = 0  # bit r: there are sequences with r places left

    def put(space: int, lengths: tuple[int, ...], n: int) -> None:
        nonlocal free
        groups.setdefault(space, []).append([lengths, n])
        free |= 1 << space

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = free >> length
            if not fits:
                each = capacity // length
                for k, n in ((each, left // each), (left % each, 1)):
                    if k and n:
                        put(capacity - k * length, (length,) * k, n)
                break
            space = length + (fits & -fits).bit_length() - 1
            group = groups[space][-1]
            took = min(left, group[1])
            group[1] -= took
            if not group[1]:
                groups[space].pop()
                if not groups[space]:
                    free &= ~(1 << space)
            put(space - length, (*group[0], length), took)
            left -= took
    merged: Counter = Counter()
    for found in groups.values():
        for lengths, n in found:
            merged[lengths] += n
    return list(merged.items())


def packing_plan(
    histogram: dict[int, int], capacity: int, stride: int = 16, rounds: int = 60
) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they hold every piece once."""
    counts = np.zeros(capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    rows = patterns(capacity, stride)
    rows = rows[((counts[rows] > 0) | (rows == 0)).all(axis=1)]
    plan, left = [], {length: int(n) for length, n in histogram.items()}
    repeats = np.floor(fit(counts, rows, rounds)).astype(np.int64)
    for at in np.argsort(-repeats, kind="stable"):
        if repeats[at] < 1:
            break
        lengths = tuple(int(x) for x in rows[at] if x)
        n = min(int(repeats[at]), *(left[x] // k for x, k in Counter(lengths).items()))
        if n:
            plan.append((lengths, n))
            for x in lengths:
                left[x] -= n
    plan += best_fit({x: n for x, n in left.items() if n}, capacity)
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, which of its pieces (by number) go where: one row for each place of a pattern."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(
        ["length", "first"]
    )


def pack(
    pieces: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece"), stride: int = 16
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, packed into sequences of ``capacity``.

    ``pieces`` has ``length`` (1 to ``capacity``) and should be narrow and written already, for it is read three
    times. Only the histogram of lengths comes to the driver: at most ``capacity`` counts. Patterns
    of up to three lengths that fill a sequence are fitted to it by non-negative least squares and rounded
    down; what is left is packed best fit, still as counts. Pieces are then numbered within their
    length, over many tasks even where all have the same, and take the place of that number. Equal rows are
    packed each. An empty table gives no rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"pieces must have a length of 1 to {capacity}")
    places = _places(packing_plan(counts, capacity, stride))
    # length and number in one sorted key
    starts = (places["length"].to_numpy("int64") << 46) + places["first"].to_numpy("int64")
    first = places["first"].to_numpy("int64")
    sequence, offset = places["sequence"].to_numpy("int64"), places["offset"].to_numpy("int64")

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        wanted = (length.to_numpy("int64") << 46) + number.to_numpy("int64")
        at = np.searchsorted(starts, wanted, "right") - 1
        return pd.DataFrame(
            {"sequence_id": sequence[at] + number.to_numpy("int64") - first[at], "offset": offset[at]}
        )

    ordered = numbered(pieces, ["length"], list(order), "_number")
    return ordered.withColumn("_place", place("length", "_number")).select(
        *pieces.columns, "_place.sequence_id", "_place.offset"
    )
