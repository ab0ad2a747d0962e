"""Importance resampling: documents drawn so that their n-grams come close to those of a target.

Features are the runs of one to three words of a text, hashed to buckets. A task takes the words of a block of documents as
one sequence of word ids and sorts its suffixes by their first three words (no feature is longer, so their order beyond
that does not matter); a suffix ends with its document. Where a suffix shares fewer than n words with the one before it
(their longest common prefix), a run of equal n-grams begins. Each run is hashed once, from the hash of the run of one word
less, and its bucket goes back to all places of the run. A first pass counts buckets, a second one adds up the gains of
each document's places. Only the buckets' counts, whose number is a parameter, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm.shared import Block, cut, text_blocks

BUCKETS, LONGEST = 10_000, 3
#: Words whose suffixes are sorted together, and bytes of a block.
MOST_WORDS, BLOCK = 1 << 20, 4 << 20
#: Word bytes with A-Z as a-z, zero for all others: digits, letters, and every byte outside ASCII.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A], _FOLD[0x61:0x7B], _FOLD[0x41:0x5B], _FOLD[0x80:] = range(0x30, 0x3A), range(0x61, 0x7B), range(0x61, 0x7B), range(0x80, 0x100)


def words_of(block: Block) -> tuple[pa.BinaryArray, np.ndarray]:
    """The folded words of a block in order, and how many each document has."""
    folded = _FOLD[block.buf]
    word = folded != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[word])])
    return words, np.diff(np.concatenate(([0], np.searchsorted(starts, block.ends))))


def suffix_array(first: np.ndarray, second: np.ndarray, third: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first three word ids (0: the text has ended), and how many of them each shares with the
    suffix before it."""
    bits = int(most).bit_length()
    if 3 * bits < 64:
        order = np.argsort((first << (2 * bits)) | (second << bits) | third)
    else:
        order = np.lexsort((third, second, first))
    same = np.ones(len(first), bool)
    same[:1] = False
    shared = np.zeros(len(first), np.int8)
    for ids in (first, second, third):
        at = ids[order]
        same[1:] &= at[1:] == at[:-1]
        shared += same
    return order, shared


def runs(words: pa.BinaryArray, per: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of at most MOST_WORDS starting words and each length n: n, the places in order of their suffixes, the
    run of each of them, and the bucket of each run (-1 where the text ends before n words)."""
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    known = coded.dictionary.to_pylist()
    spaced, alone = [b"", *[b" " + w for w in known]], [0, *map(crc32, known)]
    left = np.repeat(np.cumsum(per), per) - np.arange(len(ids))  # words from here to the document's end, this one included
    ahead = [ids] + [np.where(left > k, np.concatenate((ids[k:], np.zeros(min(k, len(ids)), np.int64))), 0) for k in range(1, LONGEST)]
    for a in range(0, len(ids), MOST_WORDS):
        part = [x[a : a + MOST_WORDS] for x in ahead]
        order, shared = suffix_array(*part, len(known))
        before, run_before = None, None
        for n in range(1, LONGEST + 1):
            heads = shared < n
            run = np.cumsum(heads) - 1
            at = order[heads]
            last = part[n - 1][at]
            there = last > 0
            if n == 1:
                hashes = np.array(alone, np.uint32)[last]
            else:
                hashes = np.zeros(len(at), np.uint32)
                stems = before[run_before[heads]][there]
                hashes[there] = np.fromiter(map(crc32, map(spaced.__getitem__, last[there].tolist()), stems.tolist()), np.uint32, len(stems))
            yield n, order + a, run, np.where(there, (hashes % np.uint32(buckets)).astype(np.int64), -1)
            before, run_before = hashes, run


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks add up before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for block in text_blocks(batches, 0, BLOCK):
            for _, _, of, found in runs(*words_of(block), buckets):
                ok = found >= 0
                total += np.bincount(found[ok], np.bincount(of, minlength=len(found))[ok], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "bucket int, n bigint")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log odds of the target against the corpus in thousandths, each with one more feature a bucket."""
    b = len(own)
    odds = ((target + 1.0) * (own.sum() + float(b))) / ((own + 1.0) * (target.sum() + float(b)))
    return np.floor(1000.0 * np.log(odds)).astype(np.int64)


def weigh(docs: DataFrame, table: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the gains of its features); one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 1, BLOCK):
            words, per = words_of(block)
            value = np.zeros(len(words) + 1, np.int64)
            for _, order, of, found in runs(words, per, buckets):
                value[order + 1] += np.where(found >= 0, table[found], 0)[of]
            sums = np.cumsum(value)[np.concatenate(([0], np.cumsum(per)))]
            features = sum(np.maximum(per - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(per), pa.array(features), pa.array(np.diff(sums))], ["doc_id", "n_words", "n_features", "weight"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return source.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def draw(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, ... of the floor(share * N / 100) best of the N rows with enough words.

    Rows are dealt by ranges of the order and written once; what the ranges before a row's own hold is known from their
    counts, so no task sees more than a range, and only ranges with drawn rows are numbered.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    enough = F.col("n_words") >= least_words
    dealt = cut(scored.filter(enough).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    most, before, edges = share * sum(n for _, n in sizes) // 100, 0, []
    for at, n in sizes:
        edges.append((at, before))
        before += n
    few = [(at, b) for at, b in edges if b < most]
    placed = dealt.join(F.broadcast(spark.createDataFrame(few, "range int, before bigint")), "range", "left")
    number = F.row_number().over(Window.partitionBy("range").orderBy(*order)).cast("bigint") + F.col("before")
    head = placed.filter("before is not null").withColumn("rank", number).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    tail = placed.filter("before is null").unionByName(scored.filter(~enough), allowMissingColumns=True).withColumn("rank", F.lit(None).cast("bigint"))
    return head.unionByName(tail).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank; one row per input row.

    score is the weight plus Gumbel noise from the hash of `seed:doc_id`, so that the best scores are a draw without
    replacement in proportion to the weights' odds. rank numbers the floor(share * N / 100) best of the N rows with least_words words
    or more, ties by id; all other rows have none. Null texts have no words; a null id counts as an empty one in the
    hash and stands last among ties; repeated rows are drawn one by one, and which of equal rows has which rank is open. Of an
    empty target every bucket has no features; an empty table gives no rows. A long text is cut into parts of MOST_WORDS
    words for sorting, which changes nothing. Other columns are not read, so their names cannot clash.
    """
    table = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, table, id_col=id_col, text_col=text_col).withColumn("score", F.col("weight") + noise.cast("bigint"))
    return draw(cut(scored, "scored"), share, least_words)


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
