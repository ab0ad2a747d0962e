"""Files that a reviewer fills in, and how well their entries took effect.

Each is read, merged with what the data bring, and replaced as a whole: the reviewer's rows stay, new rows are appended in the
order of the file. A table is a folder of CSV parts, so that it may have any size; a single CSV file in its place is read as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.functions import text as T
from citegrid.operators import mapping as M
from citegrid.operators.lineage import checkpointed
from citegrid.sources import files
from citegrid.sources import records as R
from citegrid.sources import sinks as K

OBSERVED = "OBSERVED_COMPONENT"


def save(spark: SparkSession, table: DataFrame, path: str) -> None:
    """Replace the table at path."""
    files.swap(spark, path, lambda p: K.write_csv(table, p))


def template(spark: SparkSession, path: str, columns: tuple[str, ...], seed: str, rows) -> DataFrame:
    """The rows to start from: the file's own if it has valid ones, else those of the seed if that has more. rows(spark, path):
    the number of valid rows of a file."""
    own, other = rows(spark, path), rows(spark, seed) if seed else -1
    return K.make_template(spark, path if own > 0 or other <= own else "", columns, seed)


def author_template(spark: SparkSession, path: str, mentions: DataFrame, seed: str = "") -> DataFrame:
    """The author template with blank ids filled from the exports, written back to path. mentions: name, aid."""
    rows = template(spark, path, K.AUTHOR_TEMPLATE, seed, R.mapping_rows)
    more = [c for c in rows.columns if c not in K.AUTHOR_TEMPLATE]
    keyed = rows.select(
        F.col("Variant").alias("text_v"), F.col("Canonical").alias("text_c"), F.monotonically_increasing_id().alias("at"), *[F.col(f"`{c}`").alias(f"more_{i}") for i, c in enumerate(more)],
        T.clean_author("Variant").alias("variant"), T.author_id("`Variant ID`").alias("variant_id"), T.clean_author("Canonical").alias("canonical"), T.author_id("`Canonical ID`").alias("canonical_id"),
    )
    filled = M.fill_ids(checkpointed(keyed), mentions)
    out = checkpointed(filled.orderBy("at").select(F.col("text_v").alias("Variant"), F.col("variant_id").alias("Variant ID"), F.col("text_c").alias("Canonical"), F.col("canonical_id").alias("Canonical ID"), *[F.col(f"more_{i}").alias(c) for i, c in enumerate(more)]))
    save(spark, out, path)
    return out


def start_component_template(spark: SparkSession, path: str, seed: str = "") -> DataFrame:
    """The component template before a run, with its fixed columns; it holds the rules of the run."""
    return checkpointed(template(spark, path, K.COMPONENT_TEMPLATE, seed, R.component_mapping_rows).select(*[f"`{c}`" for c in K.COMPONENT_TEMPLATE]))


def extended_components(rows: DataFrame, records: DataFrame, threshold: float = 90.0) -> DataFrame:
    """The component template after a run, in its order: the reviewer's rows, each observed component, and similar pairs of
    components that no rule names yet.

    rows: the template. records: component_key, spelling, mentions, example, mapped. A pair of keys that the template has is
    not added again.
    """
    own = checkpointed(rows.withColumns({"v": T.clean_affiliation("Variant"), "c": T.clean_affiliation("Canonical")}))
    lone = (F.col("v") != "") & (F.col("c") == "")  # a component without a target stands for itself
    own = own.withColumns({"Canonical": F.when(lone, F.col("v")).otherwise(F.col("Canonical")), "vk": T.lookup_key("v"), "ck": F.when(lone, T.lookup_key("v")).otherwise(T.lookup_key("c"))})
    blank = T.squeeze("`Candidate Reason`") == ""
    own = checkpointed(own.withColumn("Candidate Reason", F.when(blank & (F.col("v") != "") & (F.col("vk") == F.col("ck")), OBSERVED).otherwise(F.col("`Candidate Reason`"))).drop("v", "c"))
    text = lambda x: F.col(x).cast("string")
    known = checkpointed(records)
    observed = known.select(
        F.col("spelling").alias("Variant"), F.col("spelling").alias("Canonical"), F.lit("").alias("Component_Type"), F.lit("unresolved").alias("Decision"), text("mentions").alias("Mentions"), text("mentions").alias("Canonical Mentions"),
        F.lit(OBSERVED).alias("Candidate Reason"), *[F.lit("").alias(x) for x in K.COMPONENT_TEMPLATE[7:11]], F.coalesce("example", F.lit("")).alias("Variant Full Affiliation"), F.col("component_key").alias("vk"), F.col("component_key").alias("ck"),
    )
    pairs = M.component_candidates(known.filter(~F.col("mapped") & (F.length("component_key") > 1)), threshold)
    similar = pairs.join(known.select(F.col("component_key").alias("variant_key"), "example"), "variant_key").select(
        F.col("variant").alias("Variant"), F.col("canonical").alias("Canonical"), F.lit("").alias("Component_Type"), F.lit("unresolved").alias("Decision"), text("variant_mentions").alias("Mentions"), text("canonical_mentions").alias("Canonical Mentions"),
        F.col("reason").alias("Candidate Reason"), *[text(a).alias(b) for a, b in zip(("token_sort", "characters", "jaccard", "containment"), K.COMPONENT_TEMPLATE[7:11], strict=True)], F.coalesce("example", F.lit("")).alias("Variant Full Affiliation"),
        F.col("variant_key").alias("vk"), F.col("canonical_key").alias("ck"),
    )
    new = observed.unionByName(similar).join(own.select("vk", "ck"), ["vk", "ck"], "left_anti")
    number = lambda x: F.coalesce(T.number(f"`{x}`"), F.lit(-1.0)).desc()
    both = own.unionByName(new.select(*own.columns))
    return both.orderBy("ck", "vk", F.asc("Candidate Reason"), number("Token Sort Similarity"), number("Character Similarity")).select(*[f"`{x}`" for x in K.COMPONENT_TEMPLATE])


def named_components(rows: DataFrame) -> DataFrame:
    """component_key: what accepted rows of the template name, as variant or canonical."""
    good = rows.filter((T.decision("Decision") == "accept") & (T.component_type("Component_Type") != ""))
    names = good.select(T.clean_affiliation("Variant").alias("a"), T.clean_affiliation("Canonical").alias("b")).filter("a != '' and b != ''")
    return names.select(F.explode(F.array("a", "b")).alias("name")).select(T.lookup_key("name").alias("component_key")).distinct()


def country_validation(rules: DataFrame, entries: DataFrame, countries: DataFrame) -> DataFrame:
    """variant, canonical, raw_mentions, canonical_mentions, status of every country rule.

    rules: variant_key, variant, canonical (followed to the end). entries: `entries`, affiliations with components; each place
    of a component counts. countries: `countries`, lists after mapping.
    """
    parts = entries.select(F.explode(F.flatten(F.transform("entries", lambda e: e["components"]))).alias("component"))
    raw = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).groupBy(T.lookup_key("component").alias("variant_key")).agg(F.sum("n").alias("raw_mentions"))
    found = countries.select(F.explode("countries").alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n")).groupBy(T.lookup_key("country").alias("ck")).agg(F.sum("n").alias("canonical_mentions"))
    t = rules.withColumn("ck", T.lookup_key("canonical")).join(raw, "variant_key", "left").join(found, "ck", "left").na.fill(0, ["raw_mentions", "canonical_mentions"])
    status = F.when(F.col("variant_key") == F.col("ck"), "SELF_MAPPING").when(F.col("raw_mentions") == 0, "NOT_PRESENT_IN_INPUT").when(F.col("canonical_mentions") > 0, "PASS").otherwise("FAIL")
    return t.select("variant", "canonical", "raw_mentions", "canonical_mentions", status.alias("status")).orderBy("variant")


def country_rules(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """variant_key, variant (as the reviewer wrote it), canonical of the country rules. chained: component rules followed to
    their ends."""
    spelled = rows.select(T.clean_affiliation("Variant").alias("variant")).filter("variant != ''").withColumn("variant_key", T.lookup_key("variant")).groupBy("variant_key").agg(F.max("variant").alias("variant"))
    return chained.filter("component_type = 'country'").join(spelled, "variant_key").select("variant_key", "variant", "canonical")
