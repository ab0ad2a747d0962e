"""Writers: wide lists, tables, templates, the author cache, and the data behind charts and maps.

Charts themselves are not drawn here; each has its data as a DataFrame, so any tool can draw it.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators.ranks import positions
from citegrid.sources import files
from citegrid.sources.records import EXPORT, ensure_columns, numbered_columns, read_strings

#: Columns of the files that reviewers fill in.
COMPONENT_TEMPLATE = ("Variant", "Canonical", "Component_Type", "Decision", "Mentions", "Canonical Mentions", "Candidate Reason", "Token Sort Similarity", "Character Similarity", "Token Jaccard", "Token Containment", "Variant Full Affiliation")
AUTHOR_TEMPLATE = ("Variant", "Variant ID", "Canonical", "Canonical ID")


def widen(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """An array column as prefix_1 .. prefix_k, k the longest list; older columns of the prefix go."""
    k = df.agg(F.coalesce(F.max(F.size(name)), F.lit(0)).alias("k")).first()["k"]
    kept = df.drop(*numbered_columns(df, prefix))
    return kept.select(*[f"`{c}`" for c in kept.columns if c != name], *[F.coalesce(F.get(name, F.lit(i)), F.lit("")).alias(f"{prefix}_{i + 1}") for i in range(k)])


def assign_list(df: DataFrame, name: str, condition, values) -> DataFrame:
    """Replace the list of the rows that meet a condition."""
    return df.withColumn(name, F.when(condition, values).otherwise(F.col(name)))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; arrays are joined by '; '. Spark writes no byte-order mark."""
    flat = df.select(*[F.array_join(f.name, "; ").alias(f.name) if f.dataType.simpleString().startswith("array") else F.col(f"`{f.name}`") for f in df.schema.fields])
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_dataset(df: DataFrame, path: str, wide: bool = True) -> None:
    """A cleaned data set: Parquet with arrays at path, and with `wide` a CSV with numbered columns beside it."""
    df.write.mode("overwrite").parquet(path)
    if wide:
        out = df.withColumnsRenamed({new: old for old, new in EXPORT.items() if new in df.columns})
        for name, prefix in (("authors", "Author"), ("author_ids", "Author_ID"), ("countries", "Country")):
            if name in out.columns:
                out = widen(out, name, prefix)
        write_csv(out, f"{path}_csv")


def write_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One Parquet table per name (a workbook's sheets)."""
    made = []
    for name, df in tables.items():
        made.append(os.path.join(folder, safe_name(name)))
        df.write.mode("overwrite").parquet(made[-1])
    return made


def safe_name(value: str) -> str:
    """A file name: slashes to underscores, other odd characters dropped, underscores squeezed."""
    s = re.sub(r"[^A-Za-z0-9_. -]", "", re.sub(r"[\\/]", "_", str(value)))
    return re.sub(r"_+", "_", s.replace(" ", "_")).strip("_")


def cache_json(cache: DataFrame) -> DataFrame:
    """The author cache as one JSON object."""
    return cache.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("doi", F.struct("authors", "status"))))).alias("value"))


def make_template(spark: SparkSession, path: str, columns: tuple[str, ...], seed: str = "") -> DataFrame:
    """The rows of a template: the file's own, else those of the seed, with the fixed columns first."""
    source = path if files.exists(spark, path) else seed
    if not files.exists(spark, source):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    df = ensure_columns(read_strings(spark, source), list(columns))
    return df.select(*[f"`{c}`" for c in columns], *[f"`{c}`" for c in df.columns if c not in columns])


def remove_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Delete the files that exist; which they were. Folders stay."""
    gone = [p for p in paths if files.is_file(spark, p)]
    for p in gone:
        files.delete(spark, p)
    return gone


def bar_data(table: DataFrame, value: str, label: str, n: int = 30, sort: str | None = None, suffix: str | None = None) -> DataFrame:
    """The n bars of a chart with their labels, by (sort value, value, label)."""
    order = ([F.desc(sort)] if sort else []) + [F.desc(value), F.asc(label)]
    text = F.format_string("%s (%d papers)", F.col(label), F.col(suffix).cast("bigint")) if suffix else F.col(label)
    return table.orderBy(*order).limit(n).select(text.alias("label"), F.col(value).alias("value"))


def map_data(world: DataFrame, metrics: DataFrame, value: str) -> DataFrame:
    """Every territory with its value and colour log10(value + 1); null where there is none."""
    known = metrics.join(world.select("iso3"), "iso3", "left_semi").select("iso3", F.col(value).alias("value"))
    return world.join(known, "iso3", "left").withColumn("color_value", F.log10(F.col("value") + 1.0))


def marker_data(metrics: DataFrame, small: list[str]) -> DataFrame:
    """Rows of territories too small to be seen as areas."""
    return metrics.filter(F.col("iso3").isin(*small))


def ranked_lines(ranked: DataFrame, value: str, label: str, columns: int = 4) -> DataFrame:
    """Lines of a ranked list with the column each stands in."""
    numbered = ranked.select("rank", label, value).withColumn("line", F.format_string("%d. %s (%d)", F.col("rank").cast("bigint"), F.col(label), F.col(value).cast("bigint")))
    placed = positions(numbered, F.asc("rank"), F.asc(label), name="__n")
    total = placed.agg(F.count(F.lit(1)).alias("__total"))
    at, each, more = F.col("__n") - 1, F.floor(F.col("__total") / columns), F.col("__total") % columns  # the first columns take what is left over
    long_ = more * (each + 1)
    column = F.when(at < long_, F.floor(at / (each + 1))).otherwise(more + F.floor(F.try_divide((at - long_).cast("double"), each.cast("double"))))
    return placed.join(F.broadcast(total), how="cross").select("rank", label, value, "line", column.cast("int").alias("column"))  # one row
