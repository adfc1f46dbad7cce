"""CSV records of files of any size, read in parallel although line breaks may stand inside quoted fields.

Files are read as lines, which lets large ones be split. Whether a line begins inside a quoted field depends on all before it, so
a first pass finds for each block of a file how it would end, begun outside and begun inside of a quoted field. From these
two answers a block, the state in which every block begins follows by a window over blocks. A second pass puts lines together
to records; what a block boundary cuts is put together by way of a shuffle of those pieces only.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgeframe.sources.scratch import written

BLOCKS = "path string, block long, length long, outside boolean, inside boolean, header string"
PIECES = "path string, file_name string, block long, opens boolean, closes boolean, record string"
MOST_HEADERS = 1000


def read_lines(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    reader = spark.read.options(lineSep="\n", encoding=encoding, recursiveFileLookup=True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    about = F.col("_metadata")
    return reader.text(path).select(
        about["file_path"].alias("path"),
        about["file_name"].alias("file_name"),
        about["file_block_start"].alias("block"),
        about["file_block_length"].alias("length"),
        F.col("value").alias("line"),
    )


class Quotes:
    """For lines, whether they end inside a quoted field if they begin outside of one, and if they begin inside.

    A quote opens a field only as its first character; a doubled quote inside a quoted field is one of its characters.
    """

    def __init__(self, sep: str):
        s = re.escape(sep)
        field = rf'(?:"(?:[^"]|"")*"|[^"{s}][^{s}]*|)'
        self.whole = rf"^{field}(?:{s}{field})*\r?$"
        self.rest = rf'^(?:[^"]|"")*"(?:{s}{field})*\r?$'

    def after(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
        quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        if len(quoted):
            some = lines.take(pa.array(quoted))
            outside[quoted] = ~pc.match_substring_regex(some, self.whole).to_numpy(zero_copy_only=False)
            inside[quoted] = ~pc.match_substring_regex(some, self.rest).to_numpy(zero_copy_only=False)
        return outside, inside


def states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """Whether one is inside after each line, begun in the state ``start``: the last line that ends in one
    state whatever came before decides, and each line since that changes the state."""
    turns = np.cumsum(outside & ~inside)
    fixed = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    known = fixed >= 0
    base = np.where(known, outside[fixed], start)
    return base ^ ((turns - np.where(known, turns[fixed], 0)) % 2 == 1)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int, int], pa.RecordBatch]]:
    """Stretches of a batch that come from one block of one file."""
    block, length = batch.column("block").to_numpy(), batch.column("length").to_numpy()
    path = batch.column("path").dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(path) != 0) | (np.diff(length) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield (batch.column("path")[int(a)].as_py(), int(block[a]), int(length[a])), batch.slice(a, b - a)


def _summaries(sep: str):
    quotes = Quotes(sep)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key = [], None
        for batch in batches:
            for own, run in runs(batch):
                if own != key:
                    key = own
                    out.append([*key, False, True, None])
                    header = [] if key[1] == 0 else None
                outside, inside = quotes.after(run.column("line"))
                if header is not None:
                    # the lines of the first record that is not empty
                    for line, end in zip(run.column("line").to_pylist(), states(outside, inside, out[-1][3])):
                        if header or line.strip("\r"):
                            header.append(line)
                        if header and not end:
                            out[-1][5], header = "\n".join(header).removesuffix("\r"), None
                            break
                out[-1][3] = bool(states(outside, inside, out[-1][3])[-1])
                out[-1][4] = bool(states(outside, inside, out[-1][4])[-1])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        columns = zip(*out) if out else [[]] * 6
        names = ["path", "block", "length", "outside", "inside", "header"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return emit


@dataclass(frozen=True)
class Files:
    """What the first pass finds: for each block but a file's first whether it begins inside a quoted field, by file and place;
    the distinct headers, and each file's."""

    begun_inside: dict[str, dict[int, bool]]
    headers: list[str]
    header_of: DataFrame


def survey(lines: DataFrame, sep: str) -> Files:
    """The first pass. Collected are one row for each block but a file's first (eight a GB), and the distinct headers.

    A file that ends inside a quoted field is an error.
    """
    blocks = written(lines.mapInArrow(_summaries(sep), BLOCKS), "csv-blocks")
    earlier = Window.partitionBy("path").orderBy("block")
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("long")).over(earlier)
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "turns"))
    base = F.last(fixed, ignorenulls=True).over(earlier)
    turned = (F.col("turns") - F.coalesce(F.col("base.turns"), F.lit(0))) % 2 == 1
    after = F.coalesce(F.col("base.outside"), F.lit(False)) != turned
    known = (
        blocks.withColumn("turns", turns)
        .withColumn("base", base)
        .withColumn("after", after)
        .withColumn("before", F.lag("after", 1, False).over(earlier))
        .withColumn("last", F.lead("block").over(earlier).isNull())
        .where((F.col("block") > 0) | (F.col("last") & F.col("after")))
        .select("path", "block", "before", (F.col("last") & F.col("after")).alias("open"))
        .collect()
    )
    left_open = sorted(r["path"] for r in known if r["open"])
    if left_open:
        raise ValueError(f"a quoted field is never closed in {left_open[:5]}")
    named = blocks.where(F.col("header").isNotNull()).select("path", "header")
    headers = [r["header"] for r in named.select("header").distinct().orderBy("header").limit(MOST_HEADERS + 1).collect()]
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    begun_inside: dict[str, dict[int, bool]] = {}
    for r in known:
        begun_inside.setdefault(r["path"], {})[r["block"]] = r["before"]
    return Files(begun_inside, headers, named)


def _records(sep: str, begun_inside: dict[str, dict[int, bool]]):
    quotes = Quotes(sep)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = ["path", "file_name", "block", "opens", "closes", "record"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, state, opens, pending, header = None, None, False, True, [], False

        def rows(records: pa.Array, opens: bool, closes: bool) -> pa.RecordBatch:
            own = [key[0], name, key[1], opens, closes]
            columns = [pa.repeat(pa.scalar(v, k), len(records)) for v, k in zip(own, kinds)]
            return pa.RecordBatch.from_arrays([*columns, records.cast(pa.string())], names=names)

        def unfinished() -> list[pa.RecordBatch]:
            return [rows(pa.array(["\n".join(pending)]), opens, False)] if pending else []

        for batch in batches:
            for own, run in runs(batch):
                if own != key:
                    yield from unfinished()
                    key, name, pending = own, run.column("file_name")[0].as_py(), []
                    state = key[1] > 0 and begun_inside.get(key[0], {}).get(key[1])
                    if state is None:
                        raise ValueError(f"{key[0]} is split elsewhere than before: read it again")
                    opens, header = not state, key[1] == 0
                lines = run.column("line")
                after = states(*quotes.after(lines), state)
                begins = np.flatnonzero(~np.r_[state, after[:-1]])
                state = bool(after[-1])
                first = int(begins[0]) if len(begins) else len(lines)
                pending += lines.slice(0, first).to_pylist()
                done = []
                if pending and (len(begins) or not state):
                    done.append(rows(pa.array(["\n".join(pending)]), opens, True))
                    pending, opens = [], True
                if len(begins):
                    if state:
                        pending, opens = lines.slice(int(begins[-1])).to_pylist(), True
                        begins, end = begins[:-1], int(begins[-1])
                    else:
                        end = len(lines)
                    if len(begins) == end - first:
                        whole = lines.slice(first, end - first)
                    else:
                        offsets = pa.array(np.r_[begins, end].astype(np.int32))
                        whole = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
                    done.append(rows(whole, True, True))
                for made in done:
                    if header:
                        # the first record that is not empty
                        kept = pc.not_equal(pc.utf8_rtrim(made.column("record"), "\r"), "")
                        made = made.filter(kept)
                        if made.num_rows:
                            made, header = made.slice(1), False
                    if made.num_rows:
                        yield made
        yield from unfinished()

    return emit


def records(lines: DataFrame, sep: str, files: Files) -> DataFrame:
    """``path``, ``file_name`` and ``record`` of all records but the headers; empty ones are left out."""
    pieces = lines.mapInArrow(_records(sep, files.begun_inside), PIECES)
    whole = pieces.where("opens and closes").select("path", "file_name", "record")
    if any(inside for blocks in files.begun_inside.values() for inside in blocks.values()):
        number = F.sum(F.col("opens").cast("long")).over(Window.partitionBy("path").orderBy("block", "opens"))
        parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
        joined = (
            pieces.where("not (opens and closes)")
            .withColumn("number", number)
            .groupBy("path", "number")
            .agg(F.first("file_name").alias("file_name"), F.array_join(parts, "\n").alias("record"))
        )
        whole = whole.unionByName(joined.select("path", "file_name", "record"))
    record = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return whole.withColumn("record", record).where("record <> ''")


def column_names(header: str, sep: str) -> list[str]:
    """Names in a header; one without a name, and each of several of one name, is told by its place."""
    found = next(csv.reader([header.removeprefix("﻿")], delimiter=sep))
    lower = [n.lower() for n in found]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(found)]


def parsed(lines: DataFrame, options: Mapping[str, object], one_header: bool) -> DataFrame:
    """The rows of CSV files with ``file_name``, columns by their headers, all as text.

    With ``one_header`` files whose headers differ are an error; otherwise a column that a file lacks is missing there.
    """
    sep = str(options.get("sep", ","))
    files = survey(lines, sep)
    if not files.headers:
        raise ValueError("no file with a header")
    if one_header and len(files.headers) > 1:
        raise ValueError(f"the headers of the files differ: {files.headers[:2]}")
    named = [column_names(h, sep) for h in files.headers]
    width = max(map(len, named))
    found = records(lines, sep, files)
    if len(named) > 1:
        codes = F.create_map(*[F.lit(x) for i, h in enumerate(files.headers) for x in (h, i)])
        found = found.join(files.header_of.select("path", codes[F.col("header")].alias("of")), "path")
    schema = ", ".join(f"`{i}` string" for i in range(width))
    known = {k: str(v) for k, v in options.items() if k not in ("header", "encoding", "enforceSchema")}
    found = found.withColumn("fields", F.from_csv("record", schema, known))
    columns = {}
    for name in dict.fromkeys(n for names in named for n in names):
        at = [(i, names.index(name)) for i, names in enumerate(named) if name in names]
        if len(named) == 1:
            columns[name] = F.col(f"fields.`{at[0][1]}`")
        else:
            columns[name] = F.coalesce(*[F.when(F.col("of") == i, F.col(f"fields.`{j}`")) for i, j in at])
    return found.select(*[c.alias(n) for n, c in columns.items()], "file_name")
