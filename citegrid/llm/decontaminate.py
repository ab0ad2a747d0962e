"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with the whole document, so the search is
partitioned by size: items go to classes by their number of distinct shingles (doubling limits), and for each class a
document is cut into windows of twice the class's limit that overlap by half. Any run as long as an item lies inside one
window, so containment c in the item becomes a Jaccard similarity of at least c*q / (q + 2*limit - c*q) with a window, a
bound that does not shrink with the document. Window signatures for all classes come from one pass: minima over blocks
of doubling length. A window that shares any of the VALUES minima with an item is a candidate; candidates are confirmed
by exact containment of the item's shingles in the document.

Items of up to SHORT shingles would have windows that are mostly foreign. They are looked up exactly: an item of q
shingles that needs n of them in the document has one of any q - n + 1, so its rarest q - n + 1 are its keys.

A benchmark of up to MOST_SHINGLES shingles is broadcast, and its documents need no exchange. A larger one is joined: items
and documents send the keys by which they would meet in the index (the same minima and shingles), documents only those
that a bit table of fixed size knows; distinct candidates are confirmed on the full sets. Both ways find the same leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm.shared import cut, mix, shingles, span_hashes, text_blocks, without_ids, word_spans

WIDTH, PER_CENT = 5, 75
VALUES = 40
#: Shingles of a benchmark that is broadcast, at 8 bytes each and as much again for their minima.
MOST_SHINGLES = 1 << 20
SHORT = 8
#: Bits of the table that tells which keys a large benchmark has.
KEY_BITS = 1 << 27

_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def item_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Distinct shingle hashes of each item; an item without words has none."""
    out: list[np.ndarray] = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    for block in text_blocks(iter([batch]), 0):
        starts, ends, per = word_spans(block)
        grams, counts = shingles(span_hashes(block.buf, starts, ends, True), per, width)
        upto = np.cumsum(counts)
        out += [np.unique(grams[b - n : b]) for b, n in zip(upto.tolist(), counts.tolist(), strict=True)]
    return out


class Index:
    """Items of one pass: sorted (key, item) pairs of short ones; by size class, sorted (value, item) pairs for each of the
    VALUES minima."""

    def __init__(self, sets: list[np.ndarray], per_cent: int = PER_CENT):
        self.sets = sets
        short = [m for m, s in enumerate(sets) if 0 < len(s) <= SHORT]
        grams, times = np.unique(np.concatenate([sets[m] for m in short] or [np.zeros(0, np.uint64)]), return_counts=True)
        keys = [s[np.argsort(times[np.searchsorted(grams, s)], kind="stable")][: len(s) - max(1, -(-per_cent * len(s) // 100)) + 1] for s in (sets[m] for m in short)]
        key, owner = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.repeat(np.array(short, np.int64), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        self.keys, self.owners = key[order], owner[order]
        self.classes: dict[int, tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]] = {}
        limits = np.array([1 << (len(s) - 1).bit_length() if len(s) > SHORT else 0 for s in sets])
        for limit in sorted(set(limits.tolist()) - {0}):
            members = np.flatnonzero(limits == limit)
            values, owners = [], []
            for p in range(VALUES):
                minima = np.array([(sets[m] * _MULTIPLIERS[p]).min() for m in members], np.uint64)
                order = np.argsort(minima, kind="stable")
                values.append(minima[order])
                owners.append(members[order])
            self.classes[limit] = (members, values, owners)

    def candidates(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct codes document * number of items + item. grams: shingles in text order, document after document."""
        found: list[int] = []
        n, items = len(grams), len(self.sets)
        if not n:
            return np.zeros(0, np.int64)
        if len(self.keys):
            at, to = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
            hit = np.flatnonzero(to > at)
            doc, many = np.repeat(np.arange(len(counts)), counts)[hit], (to - at)[hit]
            ends = np.cumsum(many)
            own = self.owners[np.repeat(at[hit] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]
            found += np.unique(np.repeat(doc, many) * items + own).tolist()
        if not self.classes:
            return np.unique(np.array(found, np.int64))
        pads = {limit: self._padding(limit, counts) for limit in self.classes}
        for p in range(VALUES):
            hashed = grams * _MULTIPLIERS[p]
            for limit, (_, values, owners) in self.classes.items():
                block_starts, block_doc = pads[limit]
                low = np.minimum.reduceat(hashed, block_starts)  # a block never crosses documents
                window = low.copy()
                same = block_doc[:-1] == block_doc[1:]
                window[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])  # two blocks of `limit` shingles
                v, o = values[p], owners[p]
                at = np.searchsorted(v, window)
                hit = np.flatnonzero(v[np.minimum(at, len(v) - 1)] == window)
                for h in hit.tolist():  # few
                    k = int(at[h])
                    while k < len(v) and v[k] == window[h]:
                        found.append(block_doc[h] * items + o[k])
                        k += 1
        return np.unique(np.array(found, np.int64)) if found else np.zeros(0, np.int64)

    @staticmethod
    def _padding(limit: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of blocks of `limit` shingles in each document (the last may be shorter), and their documents."""
        blocks = -(-counts // limit)
        doc = np.repeat(np.arange(len(counts)), blocks)
        first = np.cumsum(counts) - counts
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        return first[doc] + nth * limit, doc


def _item_keys(grams: np.ndarray, per_cent: int) -> np.ndarray:
    """Keys by which an item meets documents in a join: some of its shingles if it is short, else its minima by class."""
    q = len(grams)
    if q <= SHORT:
        return mix(grams[: q - max(1, -(-per_cent * q // 100)) + 1].copy())
    limit = 1 << (q - 1).bit_length()
    return np.array([_minimum_key((grams * m).min(keepdims=True), p, limit)[0] for p, m in enumerate(_MULTIPLIERS)], np.uint64)


def _minimum_key(minima: np.ndarray, p: int, limit: int) -> np.ndarray:
    return mix(minima ^ np.uint64((p + 1) * 0x9E3779B97F4A7C15 % 2**64) ^ np.uint64(limit))


def _document_keys(grams: np.ndarray, counts: np.ndarray, limits: list[int], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) for all keys of the documents of a block that the bit table `known` has."""
    docs, keys = [], []

    def add(doc: np.ndarray, key: np.ndarray) -> None:
        place = key % np.uint64(len(known) * 8)
        hit = np.flatnonzero(known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
        docs.append(doc[hit])
        keys.append(key[hit])

    if len(grams):
        add(np.repeat(np.arange(len(counts)), counts), mix(grams.copy()))
        pads = {limit: Index._padding(limit, counts) for limit in limits}
        for p, m in enumerate(_MULTIPLIERS):
            hashed = grams * m
            for limit, (starts, doc) in pads.items():
                low = np.minimum.reduceat(hashed, starts)
                low[:-1] = np.where(doc[:-1] == doc[1:], np.minimum(low[:-1], low[1:]), low[:-1])
                add(doc, _minimum_key(low, p, limit))
    both = np.unique(np.stack((np.concatenate(docs or [np.zeros(0, np.int64)]).astype(np.uint64), np.concatenate(keys or [np.zeros(0, np.uint64)]))), axis=1)
    return both[0].astype(np.int64), both[1]


def _stock(items: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """m (a number of its own), item_id, size, grams (packed) of the items that have words; materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = item_sets(batch.column(1).to_pylist(), width)
            some = pa.array([len(s) > 0 for s in sets], pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(range(number, number + len(sets)), pa.int64()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["m", "item_id", "size", "grams"])
            number += len(sets)
            yield made.filter(some)

    kind = items.schema[item_id].dataType.simpleString()
    return cut(items.select(F.col(item_id), F.col(item_text).cast("string")).mapInArrow(run, f"m bigint, item_id {kind}, size bigint, grams binary"), "items")


def _broadcast_leaks(source: DataFrame, stock: DataFrame, kind: str, item_kind: str, width: int, per_cent: int) -> DataFrame:
    rows = stock.orderBy("m").select("item_id", "grams").toArrow()
    names, names_kind = rows["item_id"].to_pylist(), rows["item_id"].type
    shared = source.sparkSession.sparkContext.broadcast((names, [np.frombuffer(g, np.uint64) for g in rows["grams"].to_pylist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, members = shared.value
        index = Index(members, per_cent)
        arrow = pa.list_(pa.struct([("item_id", names_kind), ("shared", pa.int64()), ("size", pa.int64())]))
        for block in text_blocks(batches, 1):
            starts, ends, per = word_spans(block)
            grams, counts = shingles(span_hashes(block.buf, starts, ends, True), per, width)
            upto = np.cumsum(counts)
            leaks: list[list[dict]] = [[] for _ in range(len(block))]
            last, have = -1, None
            for code in index.candidates(grams, counts).tolist():
                d, m = divmod(code, len(members))
                if d != last:
                    last, have = d, np.unique(grams[upto[d] - counts[d] : upto[d]])
                n = _shared(have, members[m])
                if 100 * n >= per_cent * len(members[m]):
                    leaks[d].append({"item_id": names[m], "shared": n, "size": len(members[m])})
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(leaks, arrow)], ["doc_id", "leaks"])

    found = source.mapInArrow(run, f"doc_id {kind}, leaks array<struct<item_id:{item_kind},shared:bigint,size:bigint>>")
    return found.select("doc_id", F.sort_array("leaks").alias("leaks"))


def _shared(have: np.ndarray, want: np.ndarray) -> int:
    """How many of `want` are in `have` (sorted, distinct)."""
    if not len(have):
        return 0
    return int((have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want).sum())


def _joined_leaks(source: DataFrame, stock: DataFrame, kind: str, width: int, per_cent: int, key_bits: int) -> DataFrame:
    rows = cut(source.withColumn("r", F.monotonically_increasing_id()), "numbered")

    def item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_item_keys(np.frombuffer(g, np.uint64), per_cent) for g in batch.column(1).to_pylist()]
            if keys:
                flat = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), [len(k) for k in keys])), pa.array((flat % np.uint64(key_bits)).astype(np.int64))], ["key", "m", "p"])

    keyed = cut(stock.select("m", "grams").mapInArrow(item_keys, "key bigint, m bigint, p bigint"), "keys")
    # one row per byte of the bit table: at most key_bits / 8 rows reach the driver
    bits = keyed.groupBy(F.expr("p div 8").alias("b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(8)).cast("int"))).alias("v")).toArrow()
    table = np.zeros(key_bits // 8, np.uint8)
    table[np.asarray(bits["b"])] = np.asarray(bits["v"])
    long = stock.filter(F.col("size") > SHORT)
    limits = [1 << len(r.c) for r in long.select(F.bin(F.col("size") - 1).alias("c")).groupBy(F.length("c").alias("n")).agg(F.first("c").alias("c")).collect()]
    shared = source.sparkSession.sparkContext.broadcast((table, sorted(limits)))

    def document_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        for block in text_blocks(batches, 1):
            starts, ends, per = word_spans(block)
            grams, counts = shingles(span_hashes(block.buf, starts, ends, True), per, width)
            doc, key = _document_keys(grams, counts, sizes, known)
            yield pa.RecordBatch.from_arrays([block.rows.column(0).take(pa.array(doc)), pa.array(key.view(np.int64))], ["r", "key"])

    sent = rows.select("r", "t").mapInArrow(document_keys, "r bigint, key bigint")
    pairs = cut(sent.join(keyed.select("key", "m"), "key").select("r", "m").distinct(), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 1):
            starts, ends, per = word_spans(block)
            grams, counts = shingles(span_hashes(block.buf, starts, ends, True), per, width)
            upto = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array([np.unique(grams[b - n : b]).tobytes() for b, n in zip(upto.tolist(), counts.tolist(), strict=True)], pa.binary())], ["r", "have"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [_shared(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.uint64)) for h, w in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["r", "m", "shared"])

    held = rows.select("r", "t").join(pairs.select("r").distinct().hint("shuffle_hash"), "r", "left_semi").mapInArrow(sets, "r bigint, have binary")
    sized = pairs.join(stock.select("m", F.col("grams").alias("want")), "m").join(held, "r").select("r", "m", "have", "want").mapInArrow(confirm, "r bigint, m bigint, shared bigint")
    leaks = sized.join(stock.select("m", "item_id", "size"), "m").filter(F.col("shared") * 100 >= F.col("size") * per_cent)
    listed = leaks.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("item_id", "shared", "size"))).alias("leaks"))
    none = F.array().cast(listed.schema["leaks"].dataType)
    return rows.select("doc_id", "r").join(listed, "r", "left").select("doc_id", F.coalesce("leaks", none).alias("leaks"))


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, per_cent: int = PER_CENT, most_shingles: int = MOST_SHINGLES, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, leaks: array<struct<item_id, shared, size>> in sorted order, one row per input row; empty where nothing leaks.

    An item leaks into a document when 100 * shared >= per_cent * size, with size its distinct 5-word shingles (fewer words:
    the whole item as one) and shared those of them that the document has. Candidates lie close together in the document:
    shingles of an item that are scattered over a long text find it only if a window holds enough of them. Null, empty or
    wordless texts leak nothing, nor do such items; null ids stay null; rows that repeat an id or a text, with or without
    others, are judged one by one, and items that share an id or a text are each reported. Texts are read in blocks, a long
    one is a block of its own. An empty table gives no rows, an empty benchmark empty lists. Other columns are not read,
    so their names cannot clash. The size of the benchmark decides how it is searched for (most_shingles), not what is found.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    stock = _stock(items, item_id, item_text, width)
    total = stock.agg(F.sum("size")).first()[0]
    if not total:
        return source.select("doc_id", F.array().cast(f"array<struct<item_id:{item_kind},shared:bigint,size:bigint>>").alias("leaks"))
    if total <= most_shingles:
        return _broadcast_leaks(source, stock, kind, item_kind, width, per_cent)
    return _joined_leaks(source, stock, kind, width, per_cent, key_bits)


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents into which an item leaks, with all their columns, whatever their names.

    Rows with a null id stay. Rows that share an id go together if an item leaks into any of them. Null and empty texts
    stay. Empty tables: nothing goes.
    """
    return without_ids(docs, find_leaks(docs, items, id_col=id_col, text_col=text_col).filter("size(leaks) > 0").select("doc_id"), id_col)
