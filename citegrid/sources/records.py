"""Readers of record exports, mappings, decisions, the author cache and term dictionaries."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from citegrid.functions import text as T
from citegrid.sources import files
from citegrid.sources.exports import read_csv

#: Columns of an export and their names here.
EXPORT = {
    "Author full names": "author_full_names", "Author(s) ID": "author_ids_raw", "Title": "title", "Year": "year", "Source title": "source_title", "Volume": "volume", "Issue": "issue",
    "Art. No.": "art_no", "Cited by": "cited_by", "DOI": "doi", "Affiliations": "affiliations", "Authors with affiliations": "authors_with_affiliations", "Abstract": "abstract",
    "Author Keywords": "author_keywords", "Index Keywords": "index_keywords", "Funding Texts": "funding_texts", "Editors": "editors", "Publisher": "publisher",
    "Language of Original Document": "language", "Document Type": "document_type", "Open Access": "open_access",
}
#: Columns whose white space is normalised on reading.
SQUEEZED = ("author_full_names", "affiliations", "source_title", "publisher", "title", "abstract", "author_keywords", "index_keywords", "authors_with_affiliations", "funding_texts", "editors", "language", "document_type", "open_access")
#: Subjects a record must name to be eligible.
ELIGIBLE_TERMS = ("inborn error of immunity", "inborn errors of immunity", "primary immunodeficiency", "primary immune deficiency", "primary immunodeficiencies", "primary immune deficiencies")
SEARCHED = ("title", "abstract", "author_keywords", "index_keywords")
VERDICTS = ("KEEP_BOTH", "REMOVE_RECORD_1", "REMOVE_RECORD_2")
FINAL_STATUS = ("http_404", "http_410")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file that people edit, as strings, with the spellings of a missing value made empty. Quoted fields may span
    lines, so each file is one task; exports are read by read_export()."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return raw.select(*[missing_to_empty(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of any size, in ranges, as strings like read_strings(), and row_order."""
    raw = read_csv(spark, path)
    return raw.select(*[missing_to_empty(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != "row_order"], "row_order")


def missing_to_empty(c: Column) -> Column:
    return F.when(c.isNull() | c.isin(*T.MISSING), "").otherwise(c)


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with an empty column for each name it lacks."""
    lacking = {n: F.lit("") for n in names if n not in df.columns}
    return df.withColumns(lacking) if lacking else df


def number_rows(df: DataFrame, name: str = "row_order", first: int = 0) -> DataFrame:
    """Consecutive numbers in file order: a row's place in its partition, and how many rows the partitions before hold.

    What is read twice is counted once; the offsets are one row per partition, and stay in the JVM.
    """
    local = df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    before = local.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__least"))
    offsets = before.select("__part", "__least", (F.sum("n").over(Window.orderBy("__part")) - F.col("n") + first).alias("__before"))
    out = local.join(F.broadcast(offsets), "__part")
    return out.select((F.col("__before") + F.col("__at") - F.col("__least")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A raw export: renamed columns, normalised text, cited_by bigint (0 if no number), year double, row_order, source_row."""
    df = ensure_columns(read_export(spark, path), list(EXPORT))
    named = df.select(*[F.col(f"`{old}`").alias(new) for old, new in EXPORT.items()], *[F.col(f"`{c}`") for c in df.columns if c not in EXPORT])
    clean = named.withColumns({c: T.squeeze(c) for c in SQUEEZED} | {"cited_by": F.coalesce(T.number("cited_by").cast("bigint"), F.lit(0)), "year": T.number("year")})
    return clean.withColumn("source_row", F.col("row_order") + 2)


def read_preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """A cleaned table: as above, with the original row numbers kept where they are there, and wide lists gathered."""
    df = read_records(spark, path)
    if "Original CSV Row" in df.columns:
        df = df.withColumn("original_row", F.col("`Original CSV Row`").cast("bigint")).drop("Original CSV Row")
    else:
        df = df.withColumn("original_row", F.col("source_row"))
    for prefix, name in (("Author", "authors"), ("Author_ID", "author_ids"), ("Country", "countries")):
        if numbered_columns(df, prefix):
            df = gather(df, prefix, name, keep_blanks=prefix == "Author_ID")
    return df


def numbered_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns prefix_1, prefix_2, ... by number."""
    found = [c for c in df.columns if re.fullmatch(rf"{re.escape(prefix)}_\d+", c)]
    return sorted(found, key=column_number)


def column_number(name: str) -> float:
    tail = name.rpartition("_")[2]
    return float(tail) if tail.isdigit() else float("inf")


def gather(df: DataFrame, prefix: str, name: str, keep_blanks: bool = False) -> DataFrame:
    """Wide columns to one array; blanks are dropped unless positions matter. No such column is an error."""
    wide = numbered_columns(df, prefix)
    if not wide:
        raise ValueError(f"no columns {prefix}_1, {prefix}_2, ...")
    values = F.transform(F.array(*[F.col(c) for c in wide]), lambda x: F.coalesce(T.plain(x), F.lit("")))
    return df.withColumn(name, values if keep_blanks else F.filter(values, lambda x: x != "")).drop(*wide)


def eligible(df: DataFrame, terms: tuple[str, ...] = ELIGIBLE_TERMS, columns: tuple[str, ...] = SEARCHED, ascii_only: bool = False) -> DataFrame:
    """Rows that name a term anywhere in the searched fields: a substring of their joined key, as the rule has it."""
    joined = F.regexp_replace(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), r"(?U)[^\w]+", " ")
    key = (T.ascii_key if ascii_only else T.lookup_key)(joined)
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(F.col("__key"), F.lit(re.sub("[^a-z0-9]+", " ", t.lower()).strip()))
    return df.withColumn("__key", key).filter(found).drop("__key")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, verdict; the last row of a pair counts. A missing file or missing columns give no decisions."""
    none = spark.createDataFrame([], "pair_id string, verdict string")
    if not files.exists(spark, path):
        return none
    df = read_strings(spark, path)
    if not {"Pair_ID", "Decision"} <= set(df.columns):
        return none
    rows = number_rows(df.select(T.squeeze("Pair_ID").alias("pair_id"), F.upper(T.squeeze("Decision")).alias("verdict"))).filter(F.col("verdict").isin(*VERDICTS) & (F.col("pair_id") != ""))
    return rows.groupBy("pair_id").agg(F.max_by("verdict", "row_order").alias("verdict"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The table of an author mapping; Variant and Canonical are required."""
    df = read_strings(spark, path)
    lacking = {"Variant", "Canonical"} - set(df.columns)
    if lacking:
        raise ValueError(f"{path} lacks {sorted(lacking)}")
    return df


def read_component_mapping(spark: SparkSession, path: str) -> DataFrame:
    df = read_strings(spark, path)
    lacking = {"Variant", "Canonical", "Component_Type", "Decision"} - set(df.columns)
    if lacking:
        raise ValueError(f"{path} lacks {sorted(lacking)}")
    return df


def mapping_rows(spark: SparkSession, path: str) -> int:
    """Rows with both names filled; -1 for a file that is missing or has other columns."""
    try:
        return read_mapping(spark, path).filter((T.squeeze("Variant") != "") & (T.squeeze("Canonical") != "")).count() if files.exists(spark, path) else -1
    except ValueError:
        return -1


def component_mapping_rows(spark: SparkSession, path: str) -> int:
    """Accepted rows with a valid type and both names; -1 as above."""
    try:
        if not files.exists(spark, path):
            return -1
        df = read_component_mapping(spark, path)
    except ValueError:
        return -1
    return df.filter((T.decision("Decision") == "accept") & (T.component_type("Component_Type") != "") & (T.squeeze("Variant") != "") & (T.squeeze("Canonical") != "")).count()


def fullest(paths: list[str], rows: Callable[[str], int], explicit: str = "") -> str:
    """The candidate file with most valid rows, the earlier one on ties; an explicit path wins; none if all are missing."""
    if explicit:
        return explicit
    counted = [(rows(p), -i, p) for i, p in enumerate(paths)]
    best = max(counted, default=(-1, 0, ""))
    return best[2] if best[0] >= 0 else ""


def combined_path(first: str, second: str, combined: str = "", name: str = "combined_preprocessed.csv") -> str:
    """The combined table beside two data sets; different folders need an explicit path."""
    if combined:
        return combined
    a, b = os.path.dirname(os.path.abspath(first)), os.path.dirname(os.path.abspath(second))
    if a != b:
        raise ValueError("the data sets lie in different folders; name the combined table")
    return os.path.join(a, name)


def read_author_cache(spark: SparkSession, path: str) -> DataFrame:
    """doi, authors, status of the entries that can be used again: a list of authors, or a final status."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "doi string, authors array<string>, status string")
    whole = spark.read.text(path, wholetext=True)
    return cache_entries(whole.select(F.col("value")))


def cache_entries(whole: DataFrame) -> DataFrame:
    entries = whole.select(F.explode(F.from_json("value", "map<string,struct<authors:array<string>,status:string>>")).alias("doi", "e")).select("doi", "e.authors", "e.status")
    return entries.filter((F.coalesce(F.size("authors"), F.lit(0)) > 0) | F.col("status").isin(*FINAL_STATUS))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """disease, position, term of a JSON object; the disease itself is its first term, values that are no list have no more."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("disease", "raw"))
    terms = F.coalesce(F.from_json("raw", "array<string>"), F.array().cast("array<string>"))
    return parsed.select("disease", F.posexplode(F.concat(F.array("disease"), terms)).alias("position", "term"))


def read_country_citations(spark: SparkSession, path: str) -> DataFrame:
    """Only the country columns and citations (0 or more) of a cleaned table; without country columns an error."""
    head = read_csv(spark, path)
    wide = numbered_columns(head, "Country")
    if not wide:
        raise ValueError("no country columns")
    cited = F.greatest(F.coalesce(T.number("`Cited by`"), F.lit(0.0)), F.lit(0.0)).alias("cited") if "Cited by" in head.columns else F.lit(0.0).alias("cited")
    return gather(head.select(*[F.col(c) for c in wide], cited), "Country", "countries")


def world(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """iso3, name of the territories of a map."""
    return spark.createDataFrame(sorted(names.items()), "iso3 string, name string")


def with_iso3(table: DataFrame, codes: DataFrame, country: str = "country") -> DataFrame:
    """table with iso3 from codes (name, iso3); a country without a code is an error."""
    joined = table.join(codes.select(F.col("name").alias(country), "iso3"), country, "left")
    return joined.withColumn("iso3", F.when(F.col("iso3").isNull(), F.raise_error(F.concat(F.lit("unknown country: "), F.col(country))).cast("string")).otherwise(F.col("iso3")))
