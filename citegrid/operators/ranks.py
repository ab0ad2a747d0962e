"""Ranks and exact quantiles without a task that sees all rows.

Rows are dealt by ranges of their order and written once. What lies before a range follows from the counts of the ranges
before it, so a task numbers only its own rows. Values are counted before they are dealt: a value that a third of all rows
have is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.operators.lineage import in_order


def _dealt(table: DataFrame, *order: Column) -> DataFrame:
    """table in ranges of its order, with the number of the range (__range) and growing numbers inside it (__at)."""
    cut = in_order(table.repartitionByRange(*order).sortWithinPartitions(*order))
    return cut.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})


def _offsets(dealt: DataFrame, size: Column) -> DataFrame:
    """Per range the least __at, and the sum of size over all ranges before it. The driver sees one row per range."""
    rows = sorted(tuple(r) for r in dealt.groupBy("__range").agg(size.cast("bigint").alias("n"), F.min("__at").alias("least")).collect())
    out, before = [], 0
    for at, n, least in rows:
        out.append((at, before, least))
        before += n
    return dealt.sparkSession.createDataFrame(out, "__range int, __before bigint, __least bigint")


def positions(table: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """table with the place of each row in a total order, from 1; the rows come in that order."""
    dealt = _dealt(table, *order)
    joined = dealt.join(F.broadcast(_offsets(dealt, F.count(F.lit(1)))), "__range")
    return joined.select(*table.columns, (F.col("__before") + F.col("__at") - F.col("__least") + 1).cast("int").alias(name))


def competition_ranks(table: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """table with 1, 1, 3, ... by falling value; null values come last and are equal. Only distinct values are ranked."""
    counted = table.groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    order = F.desc("__value")
    dealt = _dealt(counted, order)
    above = F.sum("__n").over(Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    ranked = dealt.join(F.broadcast(_offsets(dealt, F.sum("__n"))), "__range")
    ranked = ranked.select("__value", (F.col("__before") + F.coalesce(above, F.lit(0)) + 1).cast("int").alias(name))
    return table.join(ranked, F.col(value).eqNullSafe(F.col("__value"))).select(*table.columns, name)


def group_stats(table: DataFrame, groups: list[str], value: str, shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Per group with a value: n, mean, deviation (of a sample; null for one value), least, most, and the exact quantiles
    q_0, q_1, ... of the shares, interpolated between neighbours. Null values do not count; null groups are a group.

    The distinct values of all groups are dealt by (group, value), so the values of a large group lie in many tasks.
    """
    counted = table.select(*groups, F.col(value).cast("double").alias("__v")).filter("__v is not null").groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("__n"))
    dealt = _dealt(counted, *[F.col(g) for g in groups], F.col("__v"))
    v, n = F.col("__v"), F.col("__n")
    per = dealt.groupBy("__range", *groups).agg(F.sum(n).alias("n"), F.sum(n * v).alias("s"))
    own = Window.partitionBy(*groups)
    per = per.withColumns({"before": F.sum("n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), "total": F.sum("n").over(own), "mean": F.sum("s").over(own) / F.sum("n").over(own)})
    side = per.select(F.col("__range").alias("r"), *[F.col(g).alias(f"__{g}") for g in groups], F.coalesce("before", F.lit(0)).alias("before"), "total", "mean")
    same = F.col("__range") == F.col("r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    upto = F.col("before") + F.sum(n).over(Window.partitionBy("__range", *groups).orderBy("__v"))
    rows = dealt.join(side, same).withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - n)
    aggs = [F.first("total").alias("n"), F.first("mean").alias("mean"), F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("__squares"), F.min(v).alias("least"), F.max(v).alias("most")]
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("total") - 1)
        for side_, k in (("a", F.floor(place)), ("b", F.ceil(place))):
            aggs.append(F.max(F.when((F.col("__lo") <= k) & (k < F.col("__hi")), v)).alias(f"__{side_}{i}"))
    out = rows.groupBy(*groups).agg(*aggs)
    quantiles = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("n") - 1)
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        quantiles.append(F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b).alias(f"q_{i}"))
    deviation = F.sqrt(F.try_divide(F.col("__squares"), F.nullif(F.col("n") - 1, F.lit(0)))).alias("deviation")
    return out.select(*groups, "n", "mean", deviation, "least", "most", *quantiles)
