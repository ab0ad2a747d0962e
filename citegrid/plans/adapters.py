"""The test tables seen as a corpus of publications.

A paper is an order: its year, a citation count from its price, open access from its status, the priority as journal, the
customer's segment as publisher; its authors are the distinct suppliers of its lines and its countries their nations.
Documents are records of text for the keying, linkage and term operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators.entities import annualized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str, lists: bool = True) -> DataFrame:
    """id, year, cited, open, journal, publisher, ds, citation_years, citation_rate, and with `lists` authors and countries."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    base = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("cited"), (F.col("o_orderstatus") == "F").alias("open"), F.col("o_orderpriority").alias("journal"), F.col("c_mktsegment").alias("publisher"), (F.col("o_orderkey") % 2).alias("ds"))
    rated = annualized(base)
    if not lists:
        return rated
    line, s, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    who = line.select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    per = who.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("s_name")).alias("authors"), F.sort_array(F.collect_set("n_name")).alias("countries"))
    empty = F.array().cast("array<string>")
    return rated.join(per, "id", "left").withColumns({"authors": F.coalesce("authors", empty), "countries": F.coalesce("countries", empty)})


#: Common table expressions of the SQL counterparts: P papers with rates, A their authors, C their countries.
SQL = """WITH P0 AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cited, o_orderstatus = 'F' AS open, o_orderpriority AS journal, c_mktsegment AS publisher, o_orderkey % 2 AS ds FROM orders JOIN customer ON o_custkey = c_custkey),
P AS (SELECT *, (SELECT max(year) FROM P0) - year + 1 AS cy, CAST(cited AS DOUBLE) / ((SELECT max(year) FROM P0) - year + 1) AS rate FROM P0),
A AS (SELECT DISTINCT l_orderkey AS id, s_name AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
C AS (SELECT DISTINCT l_orderkey AS id, n_name AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bibliographic records: the first eight words as title, made-up years and identifiers."""
    d = table(spark, sf_dir, "documents")
    title = F.regexp_replace(F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*(\S+(?:\s+\S+){0,7})", 1), r"\s+", " ")  # reads no further than the eighth word
    year, doi = F.col("n_chars") % 2 + 2000, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), F.col("n_chars").cast("string"))).otherwise("")
    return d.select(
        F.col("doc_id").alias("row_order"), (F.col("doc_id") + 2).alias("source_row"), title.alias("title"), year.cast("string").alias("year"), F.col("source").alias("source_title"), F.lit("").alias("publisher"), doi.alias("doi"),
        F.when(F.col("lang") == "en", "Article").otherwise("Review").alias("document_type"), F.concat(F.lit("Author, "), F.col("lang")).alias("author_full_names"), (F.col("n_chars") % 50).cast("string").alias("cited_by"), F.col("text").alias("abstract"),
        F.concat(F.col("lang"), F.lit("; "), F.col("source")).alias("author_keywords"), F.when(F.col("doc_id") % 5 == 0, "Gold").otherwise("").alias("open_access"),
    )


#: The same in SQL: rows r with keys for joins. Accents go as in the key functions; the sharp s is dropped.
KEY = "trim(regexp_replace(lower(replace(strip_accents({0}), 'ß', '')), '[^a-z0-9]+', ' ', 'g'))"
RECORDS_SQL = f"""WITH T AS (SELECT doc_id, lang, source, n_chars, array_to_string(list_slice(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), 1, 8), ' ') AS title FROM documents),
K AS (SELECT doc_id AS k, {KEY.format("title")} AS title, CAST(n_chars % 2 + 2000 AS VARCHAR) AS year, {KEY.format("source")} AS venue, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || n_chars ELSE '' END AS doi, lang FROM T),
W AS (SELECT *, list_filter(string_split(title, ' '), lambda x: x <> '') AS w FROM K),
B AS (SELECT *, list_filter(w, lambda x: x NOT IN ('a','an','and','at','by','for','from','in','of','on','the','to','with')) AS good FROM W),
R AS (SELECT *, substr(array_to_string(list_slice(CASE WHEN len(good) > 0 THEN good ELSE w END, 1, 2), ' '), 1, 32) AS block FROM B)
"""

#: Terms that are looked up in the documents: group -> spellings. They are made of the corpus' own words.
TERMS = {
    "thanedble": ["attion to thanedble", "thanedble"],
    "license": ["mit license", "apache license", "general public license"],
    "token": ["token", "secret token"],
    "insult": ["stupid", "worthless", "ANEA"],
}


def dictionary(spark: SparkSession) -> DataFrame:
    rows = [(d, i, t) for d, ts in TERMS.items() for i, t in enumerate([d, *ts])]
    return spark.createDataFrame(rows, "disease string, position int, term string")
