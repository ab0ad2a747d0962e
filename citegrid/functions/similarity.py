"""String and set similarities. The ratio is 200 * LCS / (m + n), the normalised insert-delete similarity in per cent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrid.functions.text import order_key


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine operation per character of b on a bit row for a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else (100.0 if x == y else 200.0 * lcs_length(x, y) / (len(x) + len(y))) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """0..100; two empty strings are equal. Equal strings do not reach the UDF's slow part."""
    return F.pandas_udf(_ratios, "double")(a, b)  # made here, as workers import this module without a session


def native_lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence in Spark's own functions, for short strings."""
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.transform(F.sequence(F.lit(0), F.size(x)), lambda _: F.lit(0))

    def row(prev: Column, ch: Column) -> Column:
        start = F.array(F.lit(0))

        def cell(acc: Column, i: Column) -> Column:
            up, left, diag = F.get(prev, i + 1), F.element_at(acc, -1), F.get(prev, i)
            return F.concat(acc, F.array(F.when(F.get(x, i) == ch, diag + 1).otherwise(F.greatest(up, left))))

        return F.when(F.size(x) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0))), start, cell))

    return F.element_at(F.aggregate(y, zero, row), -1)


def native_ratio(a: Column, b: Column) -> Column:
    n = F.length(a) + F.length(b)
    return F.when(n == 0, F.lit(100.0)).otherwise(200.0 * native_lcs(a, b) / n)


def token_sort_ratio(a_key: Column, b_key: Column) -> Column:
    """ratio of the sorted words of two keys."""
    return ratio(order_key(a_key), order_key(b_key))


def set_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(containment in the smaller set, Jaccard) of two arrays of distinct values; null where a set is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.try_divide(both, F.least(F.size(a), F.size(b))), F.try_divide(both, F.size(F.array_union(a, b)))


def author_relation(a: Column, b: Column) -> Column:
    """struct<status, score> of two author signatures (arrays of distinct keys)."""
    containment, jaccard = set_overlap(a, b)
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    strong = (containment >= 0.8) & (jaccard >= 0.5)
    status = F.when(empty, "unknown").when(jaccard == 1.0, "exact").when(strong, "strong").otherwise("different")
    score = F.when(empty, 0.0).when(jaccard == 1.0, 1.0).when(strong, F.round((containment + jaccard) / 2, 4)).otherwise(F.round(jaccard, 4))
    return F.struct(status.alias("status"), score.alias("score"))


def component_metrics(a_key: Column, b_key: Column, threshold: float, character_threshold: float = 94.0) -> Column:
    """struct<token_sort, characters, jaccard, containment, accepted, reason> of two component keys; the reason says which
    similarity reaches its threshold."""
    a, b = F.array_distinct(F.split(a_key, " ")), F.array_distinct(F.split(b_key, " "))
    containment, jaccard = set_overlap(a, b)
    t, c = token_sort_ratio(a_key, b_key), ratio(a_key, b_key)
    return F.struct(F.round(t, 2).alias("token_sort"), F.round(c, 2).alias("characters"), F.round(jaccard, 4).alias("jaccard"), F.round(containment, 4).alias("containment"), ((t >= threshold) | (c >= character_threshold)).alias("accepted"), F.concat(F.lit("STRICT_"), F.concat_ws("_AND_", F.when(t >= threshold, "TOKEN_SORT"), F.when(c >= character_threshold, "CHARACTER"))).alias("reason"))
