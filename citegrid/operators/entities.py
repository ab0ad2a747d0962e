"""Full counting of entities, citation rates, open-access comparisons and descriptive statistics.

A publication is a row with `year`, `cited` and arrays or columns of entities. Every operator is one grouped aggregation
over exploded rows, so Spark's partial aggregation bounds what is exchanged by the number of distinct entities per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.functions.text import plain
from citegrid.operators.ranks import competition_ranks, group_stats, positions


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b; null where either is null or b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def distinct_entities(c: Column) -> Column:
    """The cleaned entities of a row, each once, in order; blanks dropped."""
    return F.array_distinct(F.filter(F.transform(c, plain), lambda x: x != ""))


def annualized(papers: DataFrame, reference_year: int | None = None) -> DataFrame:
    """papers with citation_years and citation_rate.

    The reference year is the latest year unless given; one earlier than the latest year is an error. citation_years is
    reference - year + 1, null if that is not positive; the rate is citations per such year.
    """
    latest = papers.agg(F.max("year").cast("int").alias("latest"))
    if reference_year is None:
        joined = papers.join(F.broadcast(latest), how="cross")  # one row
    else:
        checked = latest.select(F.when(F.col("latest") > reference_year, F.raise_error(F.lit(f"reference year {reference_year} is before the latest year")).cast("int")).otherwise(F.lit(reference_year)).alias("latest"))
        joined = papers.join(F.broadcast(checked), how="cross")
    years = F.col("latest") - F.col("year").cast("int") + 1
    return joined.select(*papers.columns, F.when(years > 0, years).alias("citation_years"), F.when(years > 0, F.col("cited") / years).alias("citation_rate"))


def productivity(papers: DataFrame, entities: str, label: str) -> DataFrame:
    """Publications, citations, rated publications, total and mean annualised rate per entity; each entity counts once per row."""
    rows = papers.select(F.explode(distinct_entities(F.col(entities))).alias(label), "cited", "citation_rate")
    return _counted(rows, label)


def column_productivity(papers: DataFrame, column: str, label: str) -> DataFrame:
    """The same for a single-valued column; blanks are skipped."""
    rows = papers.select(plain(column).alias(label), "cited", "citation_rate").filter(F.col(label) != "")
    return _counted(rows, label)


def _counted(rows: DataFrame, label: str) -> DataFrame:
    return (
        rows.groupBy(label)
        .agg(F.count(F.lit(1)).alias("publications"), F.sum("cited").cast("bigint").alias("citations"), F.count("citation_rate").alias("rated"), F.coalesce(F.sum("citation_rate"), F.lit(0.0)).alias("total_rate"), mean_or_zero(F.col("citation_rate")).alias("mean_rate"))
        .orderBy(F.desc("publications"), F.desc("citations"), F.asc(label))
    )


def top_rows(table: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order (TakeOrderedAndProject)."""
    return table.orderBy(*order).limit(n)


def value_counts(papers: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """The n most frequent values of a column (all without n), blanks left out; ties by value."""
    counts = papers.select(plain(column).alias("label")).filter("label != ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else top_rows(counts, n, F.desc("n"), F.asc("label"))


def competition_rank(table: DataFrame, value: str, label: str) -> DataFrame:
    """rank 1, 1, 3 by value."""
    return competition_ranks(table, value).orderBy(F.desc(value), F.asc(label))


def position(table: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """1-based position in a total order."""
    return positions(table, *order, name=name)


def log_color(table: DataFrame, value: str) -> DataFrame:
    return table.withColumn("color_value", F.log10(F.col(value) + 1.0))


def tick_values(maximum: Column) -> Column:
    """0, 1 and the powers of ten below the maximum, then the maximum."""
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log10(F.greatest(maximum, F.lit(1)).cast("double"))).cast("int")), lambda k: F.pow(F.lit(10.0), k).cast("bigint"))
    below = F.filter(powers, lambda p: p < maximum)
    return F.when(maximum <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), below, F.array(maximum.cast("bigint")))))


def plot_value(value: Column, kind: str = "int") -> Column:
    """Text beside a bar: empty for null; integers rounded half to even, decimals to two places without closing zeros."""
    if kind == "float":
        return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), "\\.$", ""))
    return F.coalesce(F.bround(value, 0).cast("bigint").cast("string"), F.lit(""))


def annual_counts(papers: DataFrame) -> DataFrame:
    """Publications and citations per year; rows without a year are left out."""
    return papers.filter(F.col("year").isNotNull()).groupBy(F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("publications"), F.sum("cited").cast("bigint").alias("citations")).orderBy("year")


def annual_rates(papers: DataFrame) -> DataFrame:
    return papers.filter(F.col("year").isNotNull()).groupBy(F.col("year").cast("int").alias("year")).agg(F.coalesce(F.sum("citation_rate"), F.lit(0.0)).alias("total_rate"), F.avg("citation_rate").alias("mean_rate")).orderBy("year")


def zero_filled(table: DataFrame, year: str, values: list[str], until: int | None = None) -> DataFrame:
    """Every year from the first to the last (or `until`), missing values 0."""
    span = table.agg(F.min(year).alias("lo"), (F.lit(until) if until is not None else F.max(year)).cast("int").alias("hi"))
    years = span.filter("lo is not null and lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias(year))
    return years.join(table, year, "left").select(year, *[F.coalesce(v, F.lit(0)).alias(v) for v in values]).orderBy(year)


def year_comparison(first: DataFrame, second: DataFrame, values: list[str], names: tuple[str, str]) -> DataFrame:
    """Two annual tables side by side over the union of their years, missing values 0."""
    a = first.select("year", *[F.col(v).alias(f"{names[0]}_{v}") for v in values])
    b = second.select("year", *[F.col(v).alias(f"{names[1]}_{v}") for v in values])
    return a.join(b, "year", "full").select("year", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*a.columns[1:], *b.columns[1:]]]).orderBy("year")


# ---- open access -------------------------------------------------------------------------------------------------


def open_access_summary(papers: DataFrame) -> DataFrame:
    """Two rows, open and not, with zeros where a side is empty. papers: open (boolean), cited, citation_rate."""
    sides = papers.sparkSession.createDataFrame([("Open Access", True), ("Not Open Access", False)], "status string, open boolean")
    stats = papers.groupBy("open").agg(
        F.count(F.lit(1)).alias("publications"), F.sum("cited").cast("bigint").alias("citations"), F.avg("cited").alias("mean_citations"),
        F.count("citation_rate").alias("rated"), F.sum("citation_rate").alias("total_rate"), F.avg("citation_rate").alias("mean_rate"),
    )
    long = papers.select("open", F.col("cited").cast("double").alias("cited"), "citation_rate").unpivot("open", ["cited", "citation_rate"], "metric", "value")
    medians = group_stats(long, ["open", "metric"], "value").groupBy("open").agg(F.max(F.when(F.col("metric") == "cited", F.col("q_0"))).alias("median_citations"), F.max(F.when(F.col("metric") != "cited", F.col("q_0"))).alias("median_rate"))
    order = ["open", "publications", "citations", "mean_citations", "median_citations", "rated", "total_rate", "mean_rate", "median_rate"]
    stats = stats.join(F.broadcast(medians), "open", "left").select(*order)  # two rows
    joined = sides.join(stats, "open", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in stats.columns if c != "open"}
    total = F.sum(zero["publications"]).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.coalesce(F.try_divide(100.0 * zero["publications"], total), F.lit(0.0))
    return joined.select("status", zero["publications"].alias("publications"), share.alias("share"), *[v.alias(c) for c, v in zero.items() if c != "publications"])


def open_access_contrast(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric: both sides, their difference, and their ratio (null when the other side is 0)."""
    long = summary.unpivot("status", [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("status") == "Open Access", F.col("value"))).alias("open"), F.max(F.when(F.col("status") != "Open Access", F.col("value"))).alias("closed"))
    return wide.select("metric", "open", "closed", (F.col("open") - F.col("closed")).alias("difference"), ratio_or_null(F.col("open"), F.col("closed")).alias("ratio"))


def open_access_by_entity(papers: DataFrame, entities: str, label: str) -> DataFrame:
    """Conditional counts, sums and means per entity; differences and ratios are null where a side is empty."""
    rows = papers.select(F.explode(distinct_entities(F.col(entities))).alias(label), "open", "cited", "citation_rate")
    yes, no = F.col("open"), ~F.col("open")
    aggs = [F.count(F.lit(1)).alias("publications"), F.sum("cited").cast("bigint").alias("citations")]
    for name, side in (("oa", yes), ("closed", no)):
        aggs += [
            F.count_if(side).alias(f"{name}_publications"),
            F.coalesce(F.sum(F.when(side, F.col("cited"))), F.lit(0)).cast("bigint").alias(f"{name}_citations"),
            F.avg(F.when(side, F.col("cited"))).alias(f"{name}_mean_citations"),
            F.coalesce(F.sum(F.when(side, F.col("citation_rate"))), F.lit(0.0)).alias(f"{name}_total_rate"),
            F.avg(F.when(side, F.col("citation_rate"))).alias(f"{name}_mean_rate"),
        ]
    t = rows.groupBy(label).agg(*aggs)
    c = F.col
    return t.select(
        "*",
        (100.0 * c("oa_publications") / c("publications")).alias("oa_share"),
        (c("oa_mean_citations") - c("closed_mean_citations")).alias("mean_citations_difference"),
        ratio_or_null(c("oa_mean_citations"), c("closed_mean_citations")).alias("mean_citations_ratio"),
        (c("oa_mean_rate") - c("closed_mean_rate")).alias("mean_rate_difference"),
        ratio_or_null(c("oa_mean_rate"), c("closed_mean_rate")).alias("mean_rate_ratio"),
    ).orderBy(F.desc("publications"), F.desc("citations"), F.asc(label))


def open_access_charts(by_entity: DataFrame, publications: int = 5, each: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows that the share chart and the impact chart show."""
    share = by_entity.filter(F.col("publications") >= publications)
    impact = by_entity.filter((F.col("oa_publications") >= each) & (F.col("closed_publications") >= each) & F.col("mean_rate_ratio").isNotNull())
    return share, impact


def open_access_annual(papers: DataFrame) -> DataFrame:
    yes, no = F.col("open"), ~F.col("open")
    return (
        papers.filter(F.col("year").isNotNull())
        .groupBy(F.col("year").cast("int").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("publications"), F.count_if(yes).alias("oa_publications"), F.count_if(no).alias("closed_publications"), (100.0 * F.count_if(yes) / F.count(F.lit(1))).alias("oa_share"),
            mean_or_zero(F.when(yes, F.col("cited"))).alias("oa_mean_citations"), mean_or_zero(F.when(no, F.col("cited"))).alias("closed_mean_citations"),
            mean_or_zero(F.when(yes, F.col("citation_rate"))).alias("oa_mean_rate"), mean_or_zero(F.when(no, F.col("citation_rate"))).alias("closed_mean_rate"),
        )
        .orderBy("year")
    )


def open_access_counts(papers: DataFrame) -> DataFrame:
    """Rows of the two statuses in fixed order; an absent status is left out."""
    status = F.when(F.col("open"), "Open Access").otherwise("Not Open Access")
    return papers.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("publications")).orderBy(F.when(F.col("status") == "Open Access", 0).otherwise(1))


# ---- descriptive statistics --------------------------------------------------------------------------------------


def describe(table: DataFrame, metrics: list[str], labels: dict[str, str]) -> DataFrame:
    """count, mean, median, sample deviation (0 for one value), min and max per metric; infinite values and NaN are dropped.

    Metrics without a value have no row. labels: constant columns put in front.
    """
    values = table.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    values = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs(F.col("value")) < F.lit(float("inf"))))
    stats = group_stats(values, ["metric"], "value")
    return stats.select(*[F.lit(v).alias(k) for k, v in labels.items()], "metric", "n", "mean", F.col("q_0").alias("median"), F.coalesce("deviation", F.lit(0.0)).alias("deviation"), "least", "most")


def stacked(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distribution(table: DataFrame, groups: list[str], value: str, prefix: str) -> DataFrame:
    """Per group nine values: count, mean, median, deviation, min, Q1, Q3, IQR, max; zeros where there is none. Without groups
    one row."""
    by = groups or ["__all"]
    rows = table if groups else table.withColumn("__all", F.lit(0))
    stats = group_stats(rows, by, value, (0.25, 0.5, 0.75)).select(*[F.col(g).alias(f"__{g}") for g in by], "n", "mean", F.col("q_1").alias("median"), "deviation", "least", F.col("q_0").alias("q1"), F.col("q_2").alias("q3"), (F.col("q_2") - F.col("q_0")).alias("iqr"), "most")
    every = rows.select(*by).distinct() if groups else table.sparkSession.createDataFrame([(0,)], "__all int")
    same = F.lit(True)
    for g in by:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return every.join(stats, same, "left").select(*groups, *[F.coalesce(c, F.lit(0)).alias(f"{prefix}_{c}") for c in stats.columns if not c.startswith("__")])


def dataset_summary(papers: DataFrame, entities: dict[str, str]) -> DataFrame:
    """One row of totals: records, citations, years, and distinct entities of each array column."""
    base = papers.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("cited"), F.lit(0)).cast("bigint").alias("citations"), F.min("year").cast("int").alias("first_year"), F.max("year").cast("int").alias("last_year"), F.count_if(F.col("year").isNull()).alias("without_year"))
    for name, column in entities.items():
        n = papers.select(F.explode(distinct_entities(F.col(column))).alias("e")).agg(F.countDistinct("e").alias(f"unique_{name}"))
        base = base.join(F.broadcast(n), how="cross")  # one row each
    return base


def tagged_union(parts: dict[str, DataFrame], tag: str = "search_category") -> DataFrame:
    """All rows of tables with different columns, tagged; missing text is empty."""
    all_ = stacked([df.withColumn(tag, F.lit(name)) for name, df in parts.items()])
    return all_.na.fill("", [f.name for f in all_.schema.fields if f.dataType.simpleString() == "string"])


def first_per_key(table: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key, in the given order."""
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
