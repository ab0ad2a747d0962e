"""Similarity joins: pairs of strings of one block whose ratio reaches a threshold, without comparing all pairs of the block.

The ratio is 200 * LCS / (m + n). A pair at t or more has LCS >= t (m + n) / 200, so few characters are deleted and inserted
between the two; each deletion destroys at most q of the q-grams (with q - 1 characters added at both ends), each insertion
q - 1. That leaves a least number of common q-grams, which follows from the lengths. If the q-grams of every string stand in
one order, rare ones first, two strings with that many in common share one of their first few (the prefix). Rows are joined on
block, length class and q-gram of the prefix; a pair that meets more than once is kept where it meets first. The survivors are
verified by the LCS.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions.similarity import ratio
from citegrid.operators.lineage import checkpointed

#: Buckets of the table of q-gram frequencies, which is broadcast.
BUCKETS = 1 << 16
_LOW = (1 << 46) - 1


def gram_length(threshold: float) -> int:
    """The longest q-grams of which pairs at the threshold still have some in common, whatever their lengths."""
    return next(q for q in (3, 2, 1) if threshold * (2 * q - 1) > 200 * (q - 1) * 1.02)


def least_common(total: int, threshold: float, q: int) -> int:
    """q-grams that two strings of `total` characters together have in common at the threshold, at least."""
    lcs = math.ceil(threshold * total / 200 - 1e-9)
    return (q - 1) - (q - 1) * total + (2 * q - 1) * lcs


def grams(s: str, q: int) -> list[tuple[str, int]]:
    """The q-grams of s; the k-th occurrence of one counts as another."""
    padded, seen, out = "\x01" * (q - 1) + s + "\x02" * (q - 1), Counter(), []
    for i in range(len(padded) - q + 1):
        g = padded[i : i + q]
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def _hash(gram: tuple[str, int]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(gram[0], gram[1])


def prefix_length(m: int, threshold: float, q: int) -> int:
    """How many of the rarest q-grams of a string of m characters hold one that any partner has among its own."""
    nearest = range(math.ceil(m * threshold / (200 - threshold) - 1e-9), math.floor(m * (200 - threshold) / threshold + 1e-9) + 1)
    return (m + q - 1) - max(min(least_common(m + n, threshold, q) for n in nearest), 1) + 1


def _frequencies(strings: DataFrame, q: int) -> np.ndarray:
    """How often q-grams of each bucket occur. The table is of a fixed size; any order that all strings share is right."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for s in batch["s"]:
                for g in grams(s, q):
                    total[_hash(g) % BUCKETS] += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    out = np.zeros(BUCKETS, np.int64)
    for r in strings.select("s").mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def similar_pairs(rows: DataFrame, threshold: float, *, key: str = "key", text: str = "s", blocks: str = "blocks") -> DataFrame:
    """a, b (keys, a < b), ratio: the pairs of rows that share a block and whose texts have a ratio of at least threshold.

    rows: key (distinct), text (not null), blocks (array of distinct values; without one a row has no pairs). Two empty
    texts have ratio 100. The work grows with the pairs that share a rare q-gram in a block, not with the square of a block.
    """
    if threshold <= 0:
        raise ValueError("a similarity join needs a threshold above 0")
    q = gram_length(threshold)
    source = checkpointed(rows.select(F.col(key).alias("key"), F.col(text).alias("s"), F.col(blocks).alias("blocks")).filter(F.size("blocks") > 0))
    rank = np.empty(BUCKETS, np.int64)
    rank[np.argsort(_frequencies(source, q), kind="stable")] = np.arange(BUCKETS)
    ratio_of_lengths = math.log((200 - threshold) / threshold) if threshold < 100 else 0.0

    def prefixes(texts: pd.Series) -> pd.Series:
        out = []
        for s in texts:
            codes = sorted({(int(rank[h % BUCKETS]) << 46) | (h >> 18 & _LOW) for h in map(_hash, grams(s, q))})
            out.append(codes[: prefix_length(len(s), threshold, q)] if s else [0])
        return pd.Series(out)

    def lengths(texts: pd.Series) -> pd.Series:
        return pd.Series([(int(math.log(len(s)) / ratio_of_lengths) if ratio_of_lengths else len(s)) if s else -9 for s in texts], dtype="int32")

    signed = source.select("key", "s", "blocks", F.pandas_udf(prefixes, "array<bigint>")("s").alias("p"), F.pandas_udf(lengths, "int")("s").alias("c"))
    # a pair's lengths lie in one class or in two that follow each other: the longer string also looks one class down
    spread = signed.select("*", F.explode("blocks").alias("block")).select("*", F.explode("p").alias("g"))
    one = spread.select("key", "s", "blocks", "p", "block", "g", "c")
    low = spread.select("key", "s", "blocks", "p", "block", "g", F.explode(F.array("c", F.col("c") - 1)).alias("at"), "c")
    x, y = one.alias("x"), low.alias("y")
    meet = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.c") == F.col("y.at")))
    # within a class the lesser key stands left; between two classes the shorter string does
    ordered = (F.col("x.key") < F.col("y.key")) | (F.col("x.c") < F.col("y.c"))
    near = F.length("x.s").cast("double") * (200.0 - threshold) >= F.length("y.s") * threshold - 1e-6
    far = F.length("y.s").cast("double") * (200.0 - threshold) >= F.length("x.s") * threshold - 1e-6
    first = (F.array_min(F.array_intersect("x.p", "y.p")) == F.col("x.g")) & (F.array_min(F.array_intersect("x.blocks", "y.blocks")) == F.col("x.block"))
    found = meet.filter(ordered & (F.col("x.key") != F.col("y.key")) & near & far & first).select(F.col("x.key").alias("xk"), F.col("y.key").alias("yk"), F.col("x.s").alias("xs"), F.col("y.s").alias("ys"))
    scored = found.select("xk", "yk", ratio(F.col("xs"), F.col("ys")).alias("ratio")).filter(F.col("ratio") >= threshold)
    return scored.select(F.least("xk", "yk").alias("a"), F.greatest("xk", "yk").alias("b"), "ratio")


def word_blocks(words: Column) -> Column:
    """The first and the last word."""
    return F.array_distinct(F.filter(F.array(F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))), lambda w: w.isNotNull()))
