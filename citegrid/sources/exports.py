"""Quoted CSV files read by byte ranges.

A quoted field may span lines, so whether a line begins a record depends on all quotes before it, and Spark's reader of such
files gives a whole file to one task. Here lines are read by Spark's text reader, which cuts files into ranges. A line is a
function from one state (between records, or inside a quoted field) to another. Pass 1 composes the lines of a range for
both states at its beginning, with the numbers of records that end in it and what lies before the first and after the
last end. The driver chains the ranges of each file (a few numbers a range), which settles the state and the number of the
first record of every range. Pass 2 puts the records together; those that cross ranges come from the pieces of pass 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators.lineage import checkpointed

_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
#: A line that begins and ends between records, and one that begins inside a quoted field and ends between records.
_WHOLE, _CLOSES = re.compile(rf"{_FIELD}(?:,{_FIELD})*+"), re.compile(rf'(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+')
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _steps(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The state after each line (1: inside a quoted field) if it begins between records, and if it begins inside one."""
    quoted = np.asarray(pc.match_substring(lines, '"'))
    after0, after1 = np.zeros(len(lines), np.int8), np.ones(len(lines), np.int8)
    some = lines.filter(pa.array(quoted)).to_pylist()
    after0[quoted] = [_WHOLE.fullmatch(x) is None for x in some]
    after1[quoted] = [_CLOSES.fullmatch(x) is None for x in some]
    return after0, after1


def _states(after0: np.ndarray, after1: np.ndarray, start: int) -> np.ndarray:
    """The state after each line, beginning in `start`."""
    fixed = after0 == after1  # such a line forgets the state before it; of the others, most keep it and the rest turn it round
    turns = np.cumsum(~fixed & (after0 == 1))
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    base = np.where(last >= 0, after0[last] ^ (turns[last] & 1), start)
    return (base ^ (turns & 1)).astype(np.int8)


class Walk:
    """The records of one range, for one state at its beginning."""

    def __init__(self, start: int):
        self.state, self.headless = start, start == 1
        self.open: list[str] = []  # lines of a record that has not ended
        self.head: str | None = None  # what ends the record that an earlier range began
        self.ends = 0

    def feed(self, lines: pa.Array, after0: np.ndarray, after1: np.ndarray, keep: bool = False) -> pa.Array:
        """Go on over more lines; with `keep`, the records that begin in this range and end in these lines. Blank lines between
        records are none."""
        after = _states(after0, after1, self.state)
        self.state = int(after[-1])
        stops = np.flatnonzero(after == 0)
        if not len(stops):
            self.open += lines.to_pylist()
            return pa.array([], pa.string())
        first, last = int(stops[0]), int(stops[-1])
        text = "\n".join(self.open + lines.slice(0, first + 1).to_pylist())
        out = pa.array([], pa.string())
        if self.headless:
            self.head, self.headless = text, False
            self.ends += 1
        elif text:
            out = pa.array([text], pa.string())
            self.ends += 1
        alone = np.diff(stops) == 1
        blank = alone & (np.asarray(pc.binary_length(lines.take(pa.array(stops[1:])))) == 0)
        self.ends += len(blank) - int(blank.sum())
        if keep and len(blank):
            each = pa.ListArray.from_arrays(pa.array(stops - first, pa.int32()), lines.slice(first + 1, last - first))
            out = pa.concat_arrays([out, pc.binary_join(each, "\n").filter(pa.array(~blank))])
        self.open = lines.slice(last + 1).to_pylist()
        return out

    @property
    def tail(self) -> str | None:
        """What begins a record that a later range ends, or all of a range without an end."""
        return "\n".join(self.open) if self.state else None


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """(file, start of the range) and lines, without a carriage return at their end, in order; a range may come in parts."""
    for batch in batches:
        f, b = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero((f[1:] != f[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
        for s, e in zip([0, *edges], [*edges, len(batch)], strict=True):
            if e > s:
                lines = batch.column(0).slice(s, e - s)
                yield (int(f[s]), int(b[s])), pc.replace_substring_regex(lines, "\r$", "") if pc.any(pc.ends_with(lines, "\r")).as_py() else lines


_MEASURED = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("after", pa.list_(pa.int8())), ("ends", pa.list_(pa.int64())), ("head", pa.string()), ("tails", pa.list_(pa.string()))])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: one row per range, with the outcome for both states at its beginning."""

    def row(key: tuple[int, int], walks: tuple[Walk, Walk]) -> pa.RecordBatch:
        values = {"file": key[0], "at": key[1], "after": [w.state for w in walks], "ends": [w.ends for w in walks], "head": walks[1].head, "tails": [w.tail for w in walks]}
        return pa.RecordBatch.from_pylist([values], schema=_MEASURED)

    key, walks = None, (Walk(0), Walk(1))
    for here, lines in _ranges(batches):
        if here != key:
            if key is not None:
                yield row(key, walks)
            key, walks = here, (Walk(0), Walk(1))
        after = _steps(lines)
        for w in walks:
            w.feed(lines, *after)
    if key is not None:
        yield row(key, walks)


def _chain(ranges: list, files: list[int]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """State, number of the first record, and the file's own first number, of every range. Files in the given order; of each,
    record 0 is the header and has number -1 of its data."""
    order = {f: i for i, f in enumerate(files)}
    out, base, last = {}, 0, None
    state, n = 0, 0
    for r in sorted(ranges, key=lambda r: (order.get(r["file"], len(order)), r["file"], r["at"])):
        if r["file"] != last:
            if last is not None:
                base += max(n + state - 1, 0)  # a file may end inside a quoted field
            state, n, last = 0, 0, r["file"]
        out[r["file"], r["at"]] = state, n, base
        state, n = r["after"][state], n + r["ends"][state]
    return out


def read_csv(spark: SparkSession, path: str | list[str], order: str = "row_order") -> DataFrame:
    """All columns of quoted CSV files with a header, as strings, and the number of each row in file order (files by name).

    Missing values are null, empty quoted ones are empty. Line ends inside fields become line feeds. Quotes inside fields
    are doubled; a quote in an unquoted field is a character like others. Blank lines between records are skipped; an unfinished field ends with
    its file. The driver keeps a few numbers per range.
    """
    columns = spark.read.csv(path, header=True, multiLine=True, enforceSchema=False, **_OPTIONS).columns
    lines = spark.read.text(path, lineSep="\n").select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    spans = checkpointed(lines.mapInArrow(_measure, "file bigint, at bigint, after array<tinyint>, ends array<bigint>, head string, tails array<string>"))
    names = sorted(lines.inputFiles())
    spellings = [(i, x) for i, n in enumerate(names) for m in (re.sub("^file:/+", "file:/", n),) for x in {m, unquote(m)}]
    hashed = spark.createDataFrame(spellings, "i int, name string")
    files = [r["h"] for r in hashed.select("i", F.xxhash64("name").alias("h")).orderBy("i").collect()]
    chain = _chain(spans.select("file", "at", "after", "ends").collect(), files)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pass 2: the records that lie in one range."""
        key, walk, n = None, Walk(0), 0
        for here, part in _ranges(batches):
            if here != key:
                state, n, base = chain[here]
                key, walk, n = here, Walk(state), n + base - 1 + state
            texts = walk.feed(part, *_steps(part), keep=True)
            first = chain[here][1] == 0 and chain[here][0] == 0
            numbers = np.arange(n, n + len(texts))
            n += len(texts)
            skip = int(first and len(numbers) > 0 and numbers[0] == chain[here][2] - 1)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[skip:], pa.int64()), texts.slice(skip)], [order, "record"])

    known = F.broadcast(spark.createDataFrame([(f, a, *v) for (f, a), v in chain.items()], "file bigint, at bigint, state int, n bigint, base bigint"))
    settled = spans.join(known, ["file", "at"])
    tail = F.get("tails", F.col("state"))
    ends = F.get("ends", F.col("state"))
    pieces = settled.select("file", "at", "base", F.explode(F.array(
        F.struct(F.col("n").alias("n"), F.when(F.col("state") == 1, F.col("head")).alias("text")),
        F.struct((F.col("n") + ends).alias("n"), tail.alias("text")),
    )).alias("x")).select("file", "at", "base", "x.n", "x.text").filter("text is not null")
    crossing = pieces.groupBy("file", "base", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "\n").alias("record")).filter("n > 0")
    whole = lines.mapInArrow(records, f"`{order}` bigint, record string")
    both = whole.unionByName(crossing.select((F.col("base") + F.col("n") - 1).alias(order), "record"))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return both.select(F.from_csv("record", F.lit(schema), _OPTIONS).alias("__r"), order).select(*[F.col("__r")[c].alias(c) for c in columns], order)
