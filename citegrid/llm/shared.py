"""What the corpus operators share: cutting lineage, reading tables, and text kernels on Arrow buffers.

The kernels see a block of documents as one byte array in which each document is followed by one separator, so that
array operations run over a few megabytes at once. Hashes are 64-bit; a word's hash is a polynomial over a random
table of byte values, read from prefix sums, so it costs the same for words of any length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: Rows and bytes that Spark hands to Python at a time; texts and packed rows can be large.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: the default of 10,000 rows a batch can be gigabytes of text or packed arrays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, with one folder in it for this application; a temporary one only on a single
    machine whose session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}"
    return f"{found}/citegrid-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later passes start there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uncut(*tables: DataFrame) -> None:
    """Delete what cut() has written for these tables; nothing that is still to run may read them."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all that cut() has written for this application; results that still read it are gone too."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, least: int, *columns: str) -> DataFrame:
    """df dealt by columns, into `least` partitions where the session's number of them is smaller."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(least, *columns) if least > few else df.repartition(*columns)


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores in front until no column has that name (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in gone (one column of ids); rows with a null id stay."""
    key = free_name(docs.columns, "gone_id")
    ids = gone.toDF(key).filter(F.col(key).isNotNull()).distinct()
    return docs.join(ids.hint("shuffle_hash"), F.col(f"`{id_col}`") == F.col(key), "left_anti")


#: Most groups that join_counted() broadcasts.
HOT_GROUPS = 50_000


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows joined with groups, which has one row per key and is materialised; n: how many of the rows have the key.

    A key with more than 1/HOT_GROUPS of the joined rows is hot; there are HOT_GROUPS of those at most, so they are
    broadcast, and no task gathers a hot key. The others are joined by a shuffle.
    """
    total, most = groups.agg(F.sum(n), F.max(n)).first()
    edge = max(int(total or 0) // HOT_GROUPS, 1000)
    if (most or 0) <= edge:
        return rows.join(groups, on)
    hot = F.col(n) > F.lit(edge)
    known = F.broadcast(groups.filter(hot))
    rest = rows.join(F.broadcast(groups.filter(hot).select(*on)), on, "left_anti")
    return rows.join(known, on).unionByName(rest.join(groups.filter(~hot), on))


def release() -> None:
    """Give freed memory back to the system: Python workers stay for later stages and would keep it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


@dataclass
class Block:
    """Documents of one block: buf holds each text followed by one separator byte (a blank)."""

    rows: pa.RecordBatch
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def text_blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most `limit` bytes, or of one longer document. Null texts count as empty."""
    for batch in batches:
        column = batch.column(text)
        if column.type != pa.string():
            column = column.cast(pa.string())
        n = len(column)
        if not n:
            continue
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        view = memoryview(raw)
        if column.null_count:
            valid = np.asarray(column.is_valid())
        else:
            valid = None
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(n, max(at + 1, to))
            lens = np.diff(offsets[at : to + 1])
            if valid is not None:
                lens = np.where(valid[at:to], lens, 0)
            parts = [view[a : a + m] for a, m in zip(offsets[at:to].tolist(), lens.tolist(), strict=True)]
            parts.append(b"")
            ends = np.cumsum(lens + 1) - 1
            yield Block(batch.slice(at, to - at), np.frombuffer(b" ".join(parts), np.uint8), ends - lens, ends)
            at = to
    release()


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64), dtype=np.uint64)))
        _inverses = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _INVERSE, np.uint64), dtype=np.uint64)))
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the byte strings buf[starts:ends]; with `lower`, A-Z count as a-z."""
    powers, inverses = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * powers[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without blank, tab, line feed, VT, FF, CR), and how many each document has."""
    word = ~_SPACE[block.buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    per = np.diff(np.concatenate(([0], np.searchsorted(starts, block.ends))))
    return starts, ends, per


def shingles(words: np.ndarray, per: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside each document, and their number per document.

    A document of fewer words has one run, the whole of it; one without words has none. words: hashes in document order.
    """
    n = len(words)
    counts = np.where(per == 0, 0, np.maximum(per - width + 1, 1))
    if not n:
        return np.zeros(0, np.uint64), counts
    first = np.cumsum(per) - per
    short = (per > 0) & (per < width)
    full = np.zeros(n + width, np.uint64)
    full[:n] = words
    acc = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        acc = acc * _BASE + full[k : k + n]
    acc = mix(acc)
    keep = np.ones(n, bool)
    tail = np.repeat(np.cumsum(per), per) - np.arange(n) < width  # the last width-1 starts of a document have no full run
    keep[tail] = False
    for d in np.flatnonzero(short):  # at most a few words each
        a = int(per[d])
        for w in words[first[d] : first[d] + per[d]].tolist():
            a = (a * int(_BASE) + w) & 0xFFFFFFFFFFFFFFFF
        acc[first[d]] = mix(np.array([a], np.uint64))[0]
        keep[first[d]] = True
    return acc[keep], counts
