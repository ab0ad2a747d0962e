"""Fingerprints of documents that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A sketch has three rows of cells. Each paragraph digest goes into one cell of each row; a cell holds how many digests it has,
their sum, and the sum of their check values. The difference of two texts' sketches holds only digests that one has and the other
has not: a cell with one digest gives it away, it is taken out of its other cells, and so on until nothing is left
(peeling). Where peeling stops early the sketches are too small for the difference; it is tried again with larger ones. A cell's place
is the low bits of a hash, so a large sketch folds into a smaller one and texts of unlike length can be compared.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm.shared import Block, mix, release, small_batches, span_hashes, text_blocks, word_spans

ROWS = 3
#: A paragraph ends with its line, and after a word whose hash is a multiple of FINE; longer words are cut every LONG_WORD bytes.
FINE, LONG_WORD = 3, 32
#: Cells of a row of a stored sketch: a power of two, about an eighth of the paragraphs, within these bounds.
LEAST, MOST = 4, 64
#: Bytes of texts that are compared at a time, and the most buckets of the order of documents.
STEP_BYTES, MOST_RANGES = 1 << 20, 20_000
_ROW = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_CHECK = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Digests:
    """Paragraph digests of several texts, text after text; the k-th occurrence of a paragraph has a digest of its own."""

    keys: np.ndarray
    per: np.ndarray

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per)), self.per)

    def take(self, texts: np.ndarray) -> Digests:
        """The digests of some of the texts, in the order given; a text may be taken more than once."""
        first, per = (np.cumsum(self.per) - self.per)[texts], self.per[texts]
        skip = np.repeat(first - (np.cumsum(per) - per), per)
        return Digests(self.keys[np.arange(len(skip)) + skip], per)


def paragraphs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the paragraphs of a block, and how many each document has. Blanks at their ends are left out."""
    starts, ends, per = word_spans(block)
    if not len(starts):
        return starts, ends, per
    hashes = span_hashes(block.buf, starts, ends, lower=False)
    lines = np.cumsum(block.buf == 10)
    of, line = np.repeat(np.arange(len(per)), per), lines[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (hashes[:-1] % np.uint64(FINE) == 0) | (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    long_ = ends - starts > LONG_WORD
    new[1:] |= long_[1:] | long_[:-1]
    heads = np.flatnonzero(new)
    last = np.concatenate((heads[1:], [len(starts)])) - 1
    a, b, of = starts[heads], ends[last], of[heads]
    parts = np.where(long_[heads], -(-(b - a) // LONG_WORD), 1)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = np.repeat(parts > 1, parts)
    a, b, of = np.repeat(a, parts), np.repeat(b, parts), np.repeat(of, parts)
    a = a + k * LONG_WORD
    return a, np.where(cut, np.minimum(a + LONG_WORD, b), b), np.bincount(of, minlength=len(per))


def digests(block: Block) -> Digests:
    a, b, per = paragraphs(block)
    keys = span_hashes(block.buf, a, b, lower=False) if len(a) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(per), dtype=np.uint64), per)
    order = np.lexsort((keys, of))  # stable: occurrences of one paragraph stay in the order of the text
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order[1:]] == keys[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    at = np.arange(len(keys))
    nth = np.zeros(len(keys), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return Digests(np.where(nth > 0, mix(keys + nth * _CHECK), keys), per)


def cells_of(keys: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The cell of each digest in each row; size: cells of a row, per digest."""
    low = (size - 1).astype(np.uint64)
    return [(mix(keys + r) & low).astype(np.int64) for r in _ROW]


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _CHECK)


@dataclass
class Sketches:
    """Sketches of several texts one after another; text i has size[i] cells a row, and its rows follow each other."""

    size: np.ndarray
    count: np.ndarray
    total: np.ndarray
    check: np.ndarray

    @classmethod
    def empty(cls, size: np.ndarray) -> Sketches:
        n = ROWS * int(size.sum())
        return cls(size, np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64))

    @property
    def base(self) -> np.ndarray:
        return np.cumsum(ROWS * self.size) - ROWS * self.size

    def add(self, keys: np.ndarray, of: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Put digests into (or, with sign -1, take them out of) the sketches of their texts."""
        size, base = self.size[of], self.base[of]
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        signed, checked = np.where(sign > 0, keys, -keys), np.where(sign > 0, check_of(keys), -check_of(keys))
        for r, cell in enumerate(cells_of(keys, size)):
            at = base + r * size + cell
            np.add.at(self.count, at, sign)
            np.add.at(self.total, at, signed)
            np.add.at(self.check, at, checked)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests of the differences, the text each is of, its sign, and whether each sketch was emptied. Uses the sketches up."""
        n = len(self.size)
        owner = np.repeat(np.arange(n), ROWS * self.size)
        keys, texts, signs = [], [], []
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[one]
            key = np.where(sign > 0, self.total[one], -self.total[one])
            pure = check_of(key) == np.where(sign > 0, self.check[one], -self.check[one])
            if not pure.any():
                break
            key, sign, of = key[pure], sign[pure], owner[one[pure]]
            order = np.lexsort((key, of))  # a digest shows in up to three cells at once
            key, sign, of = key[order], sign[order], of[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            key, sign, of = key[new], sign[new], of[new]
            self.add(key, of, -sign)
            keys.append(key), texts.append(of), signs.append(sign)
        left = (self.count != 0) | (self.total != 0) | (self.check != 0)
        done = np.bincount(owner[left], minlength=n) == 0
        return (*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, texts, signs)), done)


def stored_size(per: np.ndarray) -> np.ndarray:
    """Cells of a row of the stored sketches of texts with so many paragraphs."""
    wanted = np.clip(per // 8, LEAST, MOST)
    return np.int64(1) << np.ceil(np.log2(wanted)).astype(np.int64)


def difference(a: Digests, b: Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests that only one text of each pair has, the pair of each, and its sign (1: only in a, -1: only in b).

    Each pair starts with the smaller of its two stored sizes; those that do not peel are tried again with twice as many cells.
    A pair whose sketch has eight times as many cells as digests and still does not peel is settled by its sorted digests.
    """
    size, pairs = np.minimum(stored_size(a.per), stored_size(b.per)), np.arange(len(a.per))
    found: list[tuple] = []
    while len(pairs):
        x, y, s = a.take(pairs), b.take(pairs), Sketches.empty(size)
        s.add(x.keys, x.of)
        s.add(y.keys, y.of, -1)
        keys, of, sign, done = s.peel()
        good = done[of] if len(of) else np.zeros(0, bool)
        found.append((keys[good], pairs[of[good]] if len(of) else of, sign[good]))
        hopeless = ~done & (ROWS * size > 8 * (x.per + y.per))
        for i in np.flatnonzero(hopeless):
            p = x.take(np.array([i])).keys, y.take(np.array([i])).keys
            for only, other, sgn in ((p[0], p[1], 1), (p[1], p[0], -1)):
                rest = np.setdiff1d(only, other)
                found.append((rest, np.full(len(rest), pairs[i]), np.full(len(rest), sgn)))
        again = ~done & ~hopeless
        pairs, size = pairs[again], 2 * size[again]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """Shared paragraphs by all paragraphs of each pair of texts, from what peeling recovers; 1 if neither has any."""
    _, of, _ = difference(a, b)
    unlike = np.bincount(of.astype(np.int64), minlength=len(a.per))
    both = a.per + b.per
    return np.where(both > 0, (both - unlike) / np.maximum(both + unlike, 1), 1.0)


def written(d: Digests, texts: list[bytes]) -> list[str]:
    """The fingerprint of each text: number of paragraphs, 16 hex digits of the whole text's hash, and the stored sketch."""
    s = Sketches.empty(stored_size(d.per))
    s.add(d.keys, d.of)
    cells = np.zeros(len(s.count), np.dtype([("n", "<u4"), ("total", "<u8"), ("check", "<u4")]))
    cells["n"], cells["total"], cells["check"] = s.count, s.total, s.check & np.uint64(0xFFFFFFFF)
    whole = [hashlib.blake2b(t, digest_size=8).hexdigest() for t in texts]
    edges = np.concatenate((s.base, [len(cells)])).tolist()
    return [f"{n}.{w}.{base64.b85encode(cells[i:j].tobytes()).decode()}" for n, w, i, j in zip(d.per.tolist(), whole, edges, edges[1:], strict=False)]


def blocks_of(texts: list[bytes]) -> Digests:
    """The digests of a list of texts."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string())], ["t"])
    parts = [digests(b) for b in text_blocks(iter([batch]), 0, STEP_BYTES)]
    if not parts:
        return Digests(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Digests(np.concatenate([p.keys for p in parts]), np.concatenate([p.per for p in parts]))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, fingerprint; one row per input row.

    A null text is empty; null ids stay null. Equal texts have equal fingerprints, repeated rows equal results. An empty table gives no rows.
    Other columns are not read, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 1, STEP_BYTES):
            d = digests(block)
            texts = [t or b"" for t in block.rows.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(d.per, pa.int64()), pa.array(written(d, texts), pa.string())], ["doc_id", "n_paragraphs", "fingerprint"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return source.mapInArrow(run, f"doc_id {kind}, n_paragraphs bigint, fingerprint string")


def compare(versions: DataFrame, *, id_col: str = "doc_id", old: str = "old", new: str = "new") -> DataFrame:
    """doc_id, likeness, removed, added: the digests (hex, sorted) of the paragraphs that only one version has.

    Null texts are empty; two texts without paragraphs are alike (1). Rows do not affect each other; an empty table gives no rows; other
    columns are not read.
    """
    small_batches(versions.sparkSession)
    kind = versions.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [blocks_of([t or b"" for t in batch.column(c).cast(pa.binary()).to_pylist()]) for c in (1, 2)]
            keys, of, sign = difference(*sides)
            lists: dict[int, tuple[list, list]] = {i: ([], []) for i in range(len(batch))}
            for k, i, s in sorted(zip(keys.tolist(), of.tolist(), sign.tolist(), strict=True)):
                lists[i][0 if s > 0 else 1].append(f"{k:016x}")
            removed, added = ([lists[i][side] for i in range(len(batch))] for side in (0, 1))
            both = sides[0].per + sides[1].per
            unlike = np.array([len(a) + len(b) for a, b in lists.values()])
            alike = np.where(both > 0, (both - unlike) / np.maximum(both + unlike, 1), 1.0) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(alike, pa.float64()), pa.array(removed, pa.list_(pa.string())), pa.array(added, pa.list_(pa.string()))], ["doc_id", "likeness", "removed", "added"])

    source = versions.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((old, "old"), (new, "new"))])
    return source.mapInArrow(run, f"doc_id {kind}, likeness double, removed array<string>, added array<string>")


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tie, t) dealt by ranges of (doc_id, tie), each in falling order, with one guest before the others: the
    first document of the next range (of the first range, after the last).

    Columns: doc_id, tie, t, copies, guest. Where the ranges begin is known from the keys alone, one key per range; the texts move once.
    Equal rows of a batch move as one row with their number, so no range grows with the copies of one document.
    """
    spark = docs.sparkSession
    wanted = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()), MOST_RANGES)
    keys = docs.select("doc_id", "tie").repartitionByRange(wanted, F.asc_nulls_first("doc_id"), F.asc("tie"))
    least = keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "tie")).alias("k"))
    zero = "" if docs.schema["doc_id"].dataType.simpleString() == "string" else 0
    bounds = sorted((r["k"]["there"], r["k"]["doc_id"] if r["k"]["there"] else zero, r["k"]["tie"]) for r in least.collect())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {k: i for i, k in enumerate(bounds)}
        for batch in batches:
            seen: dict[tuple, int] = {}
            rows, copies = [], []
            for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                k = (d is not None, zero if d is None else d, t)
                at = seen.setdefault(k, len(rows))
                if at == len(rows):
                    rows.append((i, bisect_right(bounds, k) - 1, first.get(k, -1)))
                    copies.append(0)
                copies[at] += 1
            own, home, lead = np.array(rows, np.int64).reshape(-1, 3).T
            guests = lead >= 0
            take = np.concatenate((own, own[guests]))
            moved = batch.take(pa.array(take))
            ranges = np.concatenate((home, (lead[guests] - 1) % max(len(bounds), 1)))
            guest = np.concatenate((np.zeros(len(own), bool), np.ones(guests.sum(), bool)))
            yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(np.concatenate((copies, np.ones(guests.sum(), np.int64))), pa.int64()), pa.array(guest), pa.array(ranges, pa.int32())], [*batch.schema.names, "copies", "guest", "range"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "tie", "t").mapInArrow(deal, f"doc_id {kind}, tie bigint, t string, copies bigint, guest boolean, range int")
    return dealt.repartitionById(max(len(bounds), 1), F.col("range")).sortWithinPartitions(F.desc("guest"), F.desc_nulls_last("doc_id"), F.desc("tie")).drop("range")


def follow(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per input row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    The next document is that with the least id above; after the last comes the first. Null texts are empty. A null id stands
    before all others. Rows that share an id follow each other in the order of a hash of their texts; equal rows are
    one document, and each has its result. Likeness is shared paragraphs by all paragraphs, 1 between two texts without any. A single document
    is followed by itself; an empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("t"))

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        """rows: doc_id, own, next text, copies."""
        ids, own, after, copies = zip(*rows, strict=True)
        texts = [t.encode() for t in own]
        edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for t, n in zip(own, after, strict=True)]
        other = sorted({n for n in after}.difference(own))  # most texts that follow are rows of this list themselves
        place = {t: i for i, t in enumerate([*own, *other])}
        all_ = blocks_of(texts + [t.encode() for t in other])
        d = all_.take(np.arange(len(own)))
        e, n = blocks_of(edited), all_.take(np.array([place[t] for t in after]))
        columns = [
            pa.array(ids), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(written(d, texts)), pa.array(written(e, edited)),
            pa.array(likeness(d, e)), pa.array(likeness(d, n)),
        ]
        batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        return batch if max(copies) == 1 else batch.take(pa.array(np.repeat(np.arange(len(ids)), copies)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, here, after = None, "", ""  # rows come in falling order: the row before is the next document
        held, size = [], 0
        for batch in batches:
            for d, tie, t, copies, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, tie) != key:
                    after, here, key = here, t, (d, tie)
                if guest:
                    key = None  # the guest may be a row of this range too, where there is one range only
                    continue
                held.append((d, t, after, copies))
                size += len(t) + len(after)
                if size > STEP_BYTES:
                    yield judged(held)
                    held, size = [], 0
        if held:
            yield judged(held)
        release()

    return in_ranges(source).mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
