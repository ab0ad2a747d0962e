"""The three stages as functions from inputs to DataFrames, and their command line.

    python -m citegrid.plans.stages preprocess --inputs A.csv B.csv --output out
    python -m citegrid.plans.stages analyze --inputs out/A out/B --combined out/combined --dictionary terms.json --output out
    python -m citegrid.plans.stages maps --input out/combined --codes codes.csv --output out
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.functions import text as T
from citegrid.operators import entities as E
from citegrid.operators import graph as G
from citegrid.operators import linkage as L
from citegrid.operators import mapping as M
from citegrid.operators import terms as D
from citegrid.operators.lineage import checkpointed
from citegrid.plans import curation as U
from citegrid.sources import files
from citegrid.sources import lookups as W
from citegrid.sources import records as R
from citegrid.sources import sinks as K


#: Folders of CSV parts that reviewers fill in.
AUTHORS, COMPONENTS, REVIEWS = "author_mapping_template", "component_mapping_template", "duplicate_review"
CACHE = "author_cache"


def preprocess(raw: DataFrame, dataset: str, *, cache: DataFrame | None = None, author_rules: DataFrame | None = None, component_rules: DataFrame | None = None, decisions: DataFrame | None = None, threshold: float = 95.0) -> dict[str, DataFrame]:
    """One raw export: eligible records, recovered and mapped authors, duplicates merged, countries extracted.

    Besides the tables of deduplicate(): summary, raw_mentions and mentions (name, aid; before and after mapping), entries
    (affiliations of the final records), and with component rules chained (the rules followed to their ends).
    """
    spark = raw.sparkSession
    kept = listed(R.eligible(raw))
    cache = cache if cache is not None else spark.createDataFrame([], "doi string, authors array<string>, status string")
    recovered = M.recovered_authors(kept, cache)
    align = F.udf(lambda l, i, a: None if l is None else M.align_to_recovered(l, i, a), "array<string>")  # greedy and sequential; other records reach it as nulls
    outside = F.col("author_source") == "external"
    recovered = recovered.withColumn("author_ids", F.when(outside, align(F.when(outside, F.col("listed")), F.when(outside, F.col("author_ids")), F.when(outside, F.col("authors")))).otherwise(T.align_ids(F.col("authors"), F.col("author_ids"))))
    recovered = checkpointed(recovered.withColumns({"raw_authors": F.col("authors"), "raw_author_ids": F.col("author_ids")}))
    if author_rules is not None:
        tables = M.lookups(M.chains(M.rules(author_rules)))
        mapped = M.apply_to_lists(recovered, "row_order", "authors", "author_ids", tables)
        recovered = recovered.drop("authors", "author_ids").join(mapped, "row_order")
    out = L.deduplicate(recovered, dataset, threshold=threshold, decisions=decisions, generic=[c for c in ("title", "year", "source_title", "volume", "issue", "art_no", "funding_texts", "editors", "publisher", "language", "document_type", "authors_with_affiliations", "author_source", "source_row") if c in recovered.columns])
    final = checkpointed(out["records"].withColumn("entries", T.affiliations("affiliations")))
    pairs = lambda a, i: final.select(F.explode(F.arrays_zip(F.col(a).alias("name"), F.col(i).alias("aid"))).alias("z")).select("z.name", F.coalesce("z.aid", F.lit("")).alias("aid"))
    out |= {"raw_mentions": pairs("raw_authors", "raw_author_ids"), "mentions": pairs("authors", "author_ids"), "entries": final.select("k_order", "entries")}
    if component_rules is not None:
        out["chained"] = checkpointed(M.component_chains(M.component_rules(component_rules)))
        final = final.join(M.countries(final, "k_order", "entries", out["chained"]), "k_order")
        out["components"] = M.component_records(final, "k_order", "entries", out["chained"])
    else:
        final = final.withColumn("countries", F.array().cast("array<string>"))
    out["records"] = final.drop("entries", "raw_authors", "raw_author_ids")
    out["summary"] = run_summary(raw, kept, recovered, final, dataset)
    return out


def listed(records: DataFrame) -> DataFrame:
    """records with the authors that the export lists, and their ids."""
    return records.withColumns({"listed": T.author_list("author_full_names"), "author_ids": T.author_id_list("author_ids_raw")})


def curate(spark: SparkSession, output: str, parts: list[dict[str, DataFrame]], author_rules: DataFrame | None, author_rows: DataFrame, component_rows: DataFrame, similarity: float = 90.0, component_similarity: float = 90.0) -> dict[str, DataFrame]:
    """What a reviewer gets after a run over all data sets: the extended component template (which is replaced), similar names,
    and the validation of both mappings. Returns the tables that are to be written."""
    union = lambda name: E.stacked([p[name] for p in parts])
    entries = checkpointed(E.stacked([p["entries"].withColumn("part", F.lit(i)) for i, p in enumerate(parts)]).withColumn("row", F.struct("part", "k_order")))
    named = U.named_components(component_rows).withColumnRenamed("component_key", "variant_key")
    records = M.component_records(entries, "row", "entries", named)
    U.save(spark, U.extended_components(component_rows, records, component_similarity), f"{output}/{COMPONENTS}")
    mapped = checkpointed(union("mentions"))
    known = author_rows.select(T.squeeze("Canonical").alias("name")).filter("name != ''").distinct()
    none = spark.createDataFrame([], "variant string, canonical string")
    resolved = M.chains(M.rules(author_rules)) if author_rules is not None else none
    chained = parts[0].get("chained")
    rules = U.country_rules(component_rows, chained) if chained is not None else spark.createDataFrame([], "variant_key string, variant string, canonical string")
    return {
        "author_similarity_candidates": M.author_candidates(mapped, similarity, known),
        "author_mapping_validation": M.validation(resolved, union("raw_mentions").select("name"), mapped.select("name")),
        "country_mapping_validation": U.country_validation(rules, entries, E.stacked([p["records"].select("countries") for p in parts])),
    }


def run_summary(raw: DataFrame, kept: DataFrame, recovered: DataFrame, final: DataFrame, dataset: str) -> DataFrame:
    """One row: records read, eligible and left, external author lists used, distinct countries."""
    parts = [raw.agg(F.count(F.lit(1)).alias("raw_records")), kept.agg(F.count(F.lit(1)).alias("eligible_records")), recovered.agg(F.count_if(F.col("author_source") == "external").alias("external_author_lists")), final.agg(F.count(F.lit(1)).alias("final_records")), final.select(F.explode("countries").alias("c")).agg(F.countDistinct("c").alias("unique_countries"))]
    row = parts[0].withColumn("dataset", F.lit(dataset))
    for p in parts[1:]:
        row = row.join(F.broadcast(p), how="cross")  # one row each
    return row


def combine(parts: dict[str, DataFrame], **options) -> dict[str, DataFrame]:
    """The tagged union of data sets, deduplicated again."""
    return L.deduplicate(R.number_rows(E.tagged_union(parts).drop("k_order", "cluster_size")), "combined", **options)


def papers(records: DataFrame, reference_year: int | None = None) -> DataFrame:
    """A cleaned table as publications with citation rates and open-access status."""
    base = records.withColumns({"cited": F.coalesce(F.col("cited_by").cast("bigint"), F.lit(0)), "year": F.col("year").cast("double"), "open_access_status": T.open_access_status("open_access")})
    return E.annualized(base.withColumn("open", F.col("open_access_status") == "Open Access"), reference_year)


def dataset_label(name: str, labels: dict[str, str] | None = None) -> str:
    """A fixed label of a data set, else its name in title case."""
    return (labels or {}).get(name, name.replace("_", " ").title())


def analyze_dataset(p: DataFrame, name: str, reference_year: int | None = None) -> dict[str, DataFrame]:
    """Rankings, annual tables, open-access tables and statistics of one data set. Years run to the reference year."""
    authors, lands = E.productivity(p, "authors", "author"), E.productivity(p, "countries", "country")
    journals, publishers = E.column_productivity(p, "source_title", "journal"), E.column_productivity(p, "publisher", "publisher")
    by_land = E.open_access_by_entity(p, "countries", "country")
    oa = E.open_access_summary(p)
    measures = ["publications", "citations", "total_rate", "mean_rate"]
    label = {"dataset": dataset_label(name)}
    stats = [E.describe(t, measures, label | {"unit": unit}) for t, unit in ((authors, "author"), (lands, "country"), (journals, "journal"), (publishers, "publisher"))]
    stats.append(E.describe(p, ["cited", "citation_years", "citation_rate"], label | {"unit": "record"}))
    by_year = E.zero_filled(E.annual_counts(p).join(E.annual_rates(p), "year", "left"), "year", ["publications", "citations", "total_rate", "mean_rate"], reference_year)
    stats.append(E.describe(by_year, ["publications", "citations", "total_rate", "mean_rate"], label | {"unit": "year"}))
    for unit, column in (("language", "language"), ("document type", "document_type")):
        stats.append(E.describe(E.value_counts(p, column), ["n"], label | {"unit": unit}))
    sizes = p.select(F.col("open").cast("int").alias("open_access"), F.size(E.distinct_entities(F.col("authors"))).alias("authors"), F.size(E.distinct_entities(F.col("countries"))).alias("countries"))
    stats.append(E.describe(sizes, ["open_access", "authors", "countries"], label | {"unit": "record"}))
    return {
        "authors": authors, "countries": lands, "journals": journals, "publishers": publishers,
        "languages": E.value_counts(p, "language", 10), "document_types": E.value_counts(p, "document_type", 10),
        "annual": E.annual_counts(p), "annual_rates": E.annual_rates(p),
        "open_access": oa, "open_access_contrast": E.open_access_contrast(oa, ["mean_citations", "median_citations", "mean_rate", "median_rate"]), "open_access_countries": by_land, "open_access_annual": E.open_access_annual(p),
        "statistics": E.stacked(stats), "summary": E.dataset_summary(p, {"authors": "authors", "countries": "countries"}),
    }


def analyze_networks(p: DataFrame, row_id: str = "original_row", top: int = 100) -> dict[str, dict[str, DataFrame]]:
    """Networks of the most cited authors, the most productive authors, and all countries."""
    authors, lands = E.productivity(p, "authors", "author"), E.productivity(p, "countries", "country")
    by_citations = E.position(E.top_rows(authors, top, F.desc("citations"), F.desc("publications"), F.asc("author")), F.desc("citations"), F.desc("publications"), F.asc("author"), name="selection_rank")
    by_papers = E.position(E.top_rows(authors, top, F.desc("publications"), F.desc("citations"), F.asc("author")), F.desc("publications"), F.desc("citations"), F.asc("author"), name="selection_rank")
    all_lands = E.position(lands, F.desc("publications"), F.desc("citations"), F.asc("country"), name="selection_rank")
    pick = lambda t, c: t.select(F.col(c).alias("entity"), "selection_rank")
    return {
        "most_cited_authors": G.ranked_network(p, row_id, "authors", authors, "author", pick(by_citations, "author"), 3),
        "most_productive_authors": G.ranked_network(p, row_id, "authors", authors, "author", pick(by_papers, "author"), 3),
        "countries": G.ranked_network(p, row_id, "countries", lands, "country", pick(all_lands, "country"), 4),
    }


def analyze_terms(p: DataFrame, dictionary: DataFrame, row_id: str = "original_row") -> dict[str, DataFrame]:
    """Dictionary terms: vocabulary, assignments, summary, trends, and statistics over diseases with papers."""
    vocab = D.vocabulary(dictionary)
    texts = p.select(F.col(row_id).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in D.FIELDS])).alias("x")).select("row_id", "x.field", "x.text")
    assigned = D.assign(D.matches(texts, D.term_index(vocab)))
    rows = D.papers_of(assigned, p.withColumnRenamed(row_id, "row_id"))
    annual = D.trends(rows)
    summary = D.summary(rows, dictionary, annual)
    some = summary.filter("papers > 0")
    per_disease = ["papers", "citations", "cited_share", "total_rate", "publication_window", "active_years", "papers_per_active_year", "papers_per_year", "strict_papers", "strict_share"]
    stats = E.stacked([E.describe(some, per_disease, {"unit": "disease"}), E.describe(rows.dropDuplicates(["row_id"]), ["cited", "citation_rate"], {"unit": "record"}), E.describe(rows, ["cited", "citation_rate"], {"unit": "assignment"})])
    return {"vocabulary": vocab, "assignments": assigned, "summary": summary, "trends": annual, "statistics": stats, "top": E.top_rows(summary, 20, F.desc("papers"), F.asc("disease"))}


def country_maps(counts: DataFrame, codes: DataFrame, territories: DataFrame) -> dict[str, DataFrame]:
    """Publications and citations per country with ranks, codes and map colours. counts: countries, cited."""
    rows = counts.select(F.explode(E.distinct_entities(F.col("countries"))).alias("country"), "cited")
    metrics = rows.groupBy("country").agg(F.count(F.lit(1)).alias("publications"), F.bround(F.sum("cited"), 0).cast("bigint").alias("citations"))
    coded = R.with_iso3(metrics, codes)
    out = {"metrics": coded.orderBy("country")}
    for value in ("publications", "citations"):
        ranked = E.competition_rank(coded, value, "country")
        out |= {f"{value}_ranked": ranked, f"{value}_map": K.map_data(territories, coded, value), f"{value}_list": K.ranked_lines(ranked, value, "country")}
    return out


def run_preprocess(spark: SparkSession, args, name) -> None:
    """The first stage from files to files. The templates and the review table in the output folder are the reviewer's: they
    are read first and replaced with their rows kept."""
    for path in (args.author_mapping, args.component_mapping):
        if path and not files.exists(spark, path):
            raise FileNotFoundError(path)
    at = lambda x: f"{args.output}/{x}"
    raws = {name(p): checkpointed(R.read_records(spark, p)) for p in args.inputs}
    component_rows = U.start_component_template(spark, at(COMPONENTS), args.component_mapping)
    listed_ = [listed(r).select(F.explode(F.arrays_zip(F.col("listed").alias("name"), T.align_ids(F.col("listed"), F.col("author_ids")).alias("aid"))).alias("z")).select("z.name", "z.aid") for r in raws.values()]
    if args.author_mapping and files.absolute(spark, args.author_mapping) != files.absolute(spark, at(AUTHORS)):
        U.save(spark, K.make_template(spark, args.author_mapping, K.AUTHOR_TEMPLATE), at(AUTHORS))
    author_rows = U.author_template(spark, at(AUTHORS), E.stacked(listed_))
    author_rules = author_rows if args.author_mapping else None
    decisions = checkpointed(R.read_decisions(spark, args.decisions or at(REVIEWS)))
    fetch = None if args.skip_lookups else W.http_fetch(args.lookup_url, args.lookup_mailto, args.lookup_timeout)
    wanted = E.stacked([listed(R.eligible(r)).select("doi", "listed") for r in raws.values()])
    cache = W.look_up(spark, wanted, args.author_cache or at(CACHE), fetch, lanes=args.lookup_lanes, retries=args.lookup_retries, delay=args.lookup_delay)
    options = {"author_rules": author_rules, "component_rules": component_rows, "cache": cache, "decisions": decisions, "threshold": args.threshold}
    parts, made, reviews = {}, [], []
    for n, raw in raws.items():
        out = preprocess(raw, n, **options)
        K.write_dataset(out["records"], at(n))
        K.write_tables({f"{n}_{k}": out[k] for k in ("removals", "reviews", "summary")}, args.output)
        parts[n] = spark.read.parquet(at(n))
        reviews.append(out["reviews"])
        made.append(out)
    K.write_tables(curate(spark, args.output, made, author_rules, author_rows, component_rows, args.similarity_threshold, args.component_similarity_threshold), args.output)
    if len(parts) > 1:
        both = combine(parts, threshold=args.threshold, decisions=decisions)
        K.write_dataset(both["records"], at("combined"))
        K.write_tables({"combined_removals": both["removals"], "combined_reviews": both["reviews"]}, args.output)
        reviews.append(both["reviews"])
    queue = checkpointed(L.review_queue(reviews).withColumnsRenamed({"pair_id": "Pair_ID", "decision": "Decision"}).orderBy("Pair_ID"))
    K.write_tables({"review_queue": queue}, args.output)
    U.save(spark, queue, at(REVIEWS))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="citegrid.plans.stages")
    sub = parser.add_subparsers(dest="stage", required=True)
    a = sub.add_parser("preprocess")
    a.add_argument("--inputs", nargs="+", required=True)
    a.add_argument("--author-mapping", default="", help="CSV that replaces the author template and is applied; without it no names are mapped")
    a.add_argument("--component-mapping", default="", help="CSV that seeds the component template")
    a.add_argument("--decisions", default="", help="decided pairs; without it those in the output's review table")
    a.add_argument("--author-cache", default="", help="JSON file or folder; without it the output's own")
    a.add_argument("--threshold", type=float, default=95.0)
    a.add_argument("--similarity-threshold", type=float, default=90.0)
    a.add_argument("--component-similarity-threshold", type=float, default=90.0)
    a.add_argument("--skip-lookups", action="store_true", help="ask no external service; the cache is used")
    a.add_argument("--lookup-url", default=W.SERVICE)
    a.add_argument("--lookup-mailto", default="")
    a.add_argument("--lookup-timeout", type=float, default=20.0)
    a.add_argument("--lookup-retries", type=int, default=2)
    a.add_argument("--lookup-delay", type=float, default=0.2)
    a.add_argument("--lookup-lanes", type=int, default=1, help="look-ups at a time")
    b = sub.add_parser("analyze")
    b.add_argument("--inputs", nargs="+", required=True)
    b.add_argument("--combined", default="")
    b.add_argument("--dictionary", default="")
    b.add_argument("--reference-year", type=int)
    b.add_argument("--part", choices=("all", "dataset", "combined", "terms"), default="all")
    c = sub.add_parser("maps")
    c.add_argument("--input", required=True)
    c.add_argument("--codes", required=True, help="CSV with name and iso3")
    for p in (a, b, c):
        p.add_argument("--output", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("citegrid").getOrCreate()
    name = lambda path: os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    if args.stage == "preprocess":
        run_preprocess(spark, args, name)
    elif args.stage == "analyze":
        tables = {name(p): spark.read.parquet(p) for p in args.inputs}
        ready = {n: papers(t, args.reference_year) for n, t in tables.items()}
        if args.part in ("all", "dataset"):
            for n, p in ready.items():
                K.write_tables({f"{n}_{k}": v for k, v in analyze_dataset(p, n, args.reference_year).items()}, args.output)
        if args.part in ("all", "combined") and len(ready) == 2:
            (n1, p1), (n2, p2) = ready.items()
            K.write_tables({"year_comparison": E.year_comparison(E.annual_counts(p1), E.annual_counts(p2), ["publications", "citations"], (n1, n2))}, args.output)
        if args.combined:
            p = papers(spark.read.parquet(args.combined).withColumn("original_row", F.col("k_order")), args.reference_year)
            if args.part in ("all", "combined"):
                for n, net in analyze_networks(p).items():
                    K.write_tables({f"{n}_{k}": v for k, v in net.items()}, args.output)
            if args.part in ("all", "terms") and args.dictionary:
                K.write_tables(analyze_terms(p, R.read_dictionary(spark, args.dictionary)), args.output)
    else:
        counts = spark.read.parquet(args.input).select("countries", F.greatest(F.col("cited_by").cast("double"), F.lit(0.0)).alias("cited"))
        codes = R.read_strings(spark, args.codes)
        K.write_tables(country_maps(counts, codes, codes.select("iso3", "name").distinct()), args.output)


if __name__ == "__main__":
    main()
