"""Variant-to-canonical mappings: loading rules, chains, look-up cascades, validation, and candidate generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.functions import text as T
from citegrid.functions.similarity import component_metrics
from citegrid.functions.text import order_key
from citegrid.operators.lineage import checkpointed
from citegrid.operators.similar import similar_pairs, word_blocks

#: Words that component names are not blocked on.
GENERIC_BLOCKS = ("a", "an", "and", "at", "by", "de", "del", "department", "division", "for", "hospital", "in", "institute", "laboratory", "of", "on", "research", "the", "to", "university", "with")


#: Similarity by characters from which two components are candidates, whatever their words.
CHARACTERS = 94.0


def rules(table: DataFrame, variant: str = "Variant", canonical: str = "Canonical") -> DataFrame:
    """variant, canonical of the rows that fill both; a variant with two targets is an error."""
    rows = table.select(T.squeeze(variant).alias("variant"), T.squeeze(canonical).alias("canonical")).filter("variant != '' and canonical != ''").distinct()
    checked = rows.groupBy("variant").agg(F.array_sort(F.collect_set("canonical")).alias("targets"))
    bad = F.raise_error(F.concat(F.lit("conflicting mappings for "), F.col("variant"))).cast("string")
    return checked.select("variant", F.when(F.size("targets") > 1, bad).otherwise(F.get("targets", F.lit(0))).alias("canonical"))


def chains(rule: DataFrame) -> DataFrame:
    """variant, canonical with every chain followed to its end; a cycle is an error. With a column target_id also the last
    id on the way that is not blank, the end's own included.

    Paths double each round. A path without a cycle is at most as long as there are rules, so what still moves after as
    many doublings as that number has digits is on a cycle.
    """
    with_ids = "target_id" in rule.columns
    rule = checkpointed(rule if with_ids else rule.withColumn("target_id", F.lit("")))
    step = rule.filter("variant != canonical").select("variant", "canonical", F.coalesce("target_id", F.lit("")).alias("target_id"))
    later = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    for _ in range(step.count().bit_length() + 1):
        far = step.select(F.col("variant").alias("canonical"), F.col("canonical").alias("next"), F.col("target_id").alias("next_id"))
        new = checkpointed(step.join(far, "canonical", "left").select("variant", F.coalesce("next", "canonical").alias("canonical"), later("next_id", "target_id").alias("target_id"), F.col("next").isNotNull().alias("moved")))
        step = new.select("variant", "canonical", "target_id")
        if not new.filter("moved").limit(1).count():
            break
    cyclic = F.raise_error(F.concat(F.lit("circular mapping at "), F.col("variant"))).cast("string")
    ends = rule.select(F.col("variant").alias("end"), (F.col("variant") != F.col("canonical")).alias("open"), F.col("target_id").alias("end_id"))
    done = step.join(ends, F.col("canonical") == F.col("end"), "left").select("variant", F.when(F.coalesce("open", F.lit(False)), cyclic).otherwise(F.col("canonical")).alias("canonical"), later("end_id", "target_id").alias("target_id"))
    out = done.unionByName(rule.filter("variant = canonical").select("variant", "canonical", F.coalesce("target_id", F.lit("")).alias("target_id")))
    return out if with_ids else out.drop("target_id")


def chains_sql(spark, view: str) -> DataFrame:
    """The same by a recursive query, with the length of each chain; the view has variant and canonical. A walk that takes
    more steps than there are rules is on a cycle, which is an error."""
    n = spark.table(view).count()
    out = spark.sql(f"""
        WITH RECURSIVE walk(variant, target, steps) MAX RECURSION LEVEL {n + 2} AS (
            SELECT variant, canonical, 1 FROM {view} WHERE variant <> canonical
            UNION ALL
            SELECT w.variant, r.canonical, w.steps + 1 FROM walk w JOIN {view} r ON r.variant = w.target WHERE r.variant <> r.canonical AND w.steps <= {n})
        SELECT variant, max_by(target, steps) AS canonical, max(steps) AS steps FROM walk GROUP BY variant""")
    cyclic = F.raise_error(F.concat(F.lit("circular mapping at "), F.col("variant"))).cast("string")
    return out.select("variant", F.when(F.col("steps") > n, cyclic).otherwise(F.col("canonical")).alias("canonical"), "steps")


def component_chains(rules: DataFrame) -> DataFrame:
    """component_rules() with each canonical text followed through the keys of its targets; a cycle is an error."""
    rules = checkpointed(rules.withColumn("next_key", T.lookup_key("canonical")))
    keyed = rules
    known = keyed.select(F.col("variant_key").alias("next_key"), F.lit(True).alias("known"))
    hop = keyed.join(known, "next_key", "left").select(F.col("variant_key").alias("variant"), F.when(F.col("known"), F.col("next_key")).otherwise(F.col("variant_key")).alias("canonical"))
    ends = chains(hop).select(F.col("variant").alias("variant_key"), F.col("canonical").alias("end"))
    texts = rules.select(F.col("variant_key").alias("end"), F.col("canonical").alias("text"))
    return rules.join(ends, "variant_key").join(texts, "end").select("variant_key", F.col("text").alias("canonical"), "component_type")


def _unambiguous(pairs: DataFrame) -> DataFrame:
    """key, name for keys that lead to one name only."""
    return pairs.filter("key != ''").groupBy("key").agg(F.countDistinct("name").alias("n"), F.min("name").alias("name")).filter("n = 1").select("key", "name")


def lookups(resolved: DataFrame, ascii_only: bool = False) -> dict[str, DataFrame]:
    """The five look-up tables of the cascade, in order: exact, normalised, canonical, word order, canonical word order."""
    key = T.ascii_key if ascii_only else T.lookup_key
    keyed = resolved.withColumns({"vk": key("variant"), "ck": key("canonical")})
    exact = keyed.select(F.col("variant").alias("key"), F.col("canonical").alias("name"))
    return {
        "exact": _unambiguous(exact),
        "normalized": _unambiguous(keyed.select(F.col("vk").alias("key"), F.col("canonical").alias("name"))),
        "canonical": _unambiguous(keyed.select(F.col("ck").alias("key"), F.col("canonical").alias("name"))),
        "ordered": _unambiguous(keyed.select(T.order_key("vk").alias("key"), F.col("canonical").alias("name"))),
        "canonical_ordered": _unambiguous(keyed.select(T.order_key("ck").alias("key"), F.col("canonical").alias("name"))),
    }


def cascade(names: DataFrame, tables: dict[str, DataFrame], name: str = "name", ascii_only: bool = False) -> DataFrame:
    """names with canonical and standardized (was any look-up hit, or the name blank). Joins run on distinct names."""
    key = T.ascii_key if ascii_only else T.lookup_key
    out = names.select(name).distinct().withColumns({"k": key(name)}).withColumns({"o": T.order_key("k")})
    on = {"exact": name, "normalized": "k", "canonical": "k", "ordered": "o", "canonical_ordered": "o"}
    for label, table in tables.items():
        out = out.join(table.select(F.col("key").alias(f"{label}_key"), F.col("name").alias(f"{label}_name")), F.col(on[label]) == F.col(f"{label}_key"), "left").drop(f"{label}_key")
    hits = [F.col(f"{label}_name") for label in tables]
    found = out.select(name, F.coalesce(*hits, F.col(name)).alias("canonical"), ((F.col(name) == "") | F.coalesce(*hits).isNotNull()).alias("standardized"))
    return names.join(found, name, "left")


def apply_to_lists(rows: DataFrame, row_id: str, authors: str, ids: str, tables: dict[str, DataFrame]) -> DataFrame:
    """row_id with mapped authors and ids; the first author of each identity stays."""
    flat = rows.select(row_id, F.posexplode(F.arrays_zip(F.col(authors).alias("n"), T.align_ids(F.col(authors), F.col(ids)).alias("i"))).alias("pos", "z")).select(row_id, "pos", T.clean_author(F.col("z.n")).alias("name"), T.author_id(F.col("z.i")).alias("aid"))
    mapped = cascade(flat, tables).withColumn("identity", T.identity_key(T.lookup_key("canonical"))).filter("canonical != '' and identity != ''")
    firsts = mapped.withColumn("n", F.row_number().over(Window.partitionBy(row_id, "identity").orderBy("pos"))).filter("n = 1")
    lists = firsts.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", "canonical", "aid"))).alias("z"))
    empty = F.array().cast("array<string>")
    return rows.select(row_id).join(lists, row_id, "left").select(row_id, F.coalesce(F.transform("z", lambda s: s["canonical"]), empty).alias("authors"), F.coalesce(F.transform("z", lambda s: s["aid"]), empty).alias("author_ids"))


def validation(resolved: DataFrame, raw: DataFrame, mapped: DataFrame) -> DataFrame:
    """variant, canonical, raw and mapped mentions, status. raw, mapped: one column `name`, a row per mention."""
    r = raw.groupBy(F.col("name").alias("variant")).agg(F.count(F.lit(1)).alias("raw_mentions"))
    left = mapped.groupBy(F.col("name").alias("variant")).agg(F.count(F.lit(1)).alias("variant_after"))
    to = mapped.groupBy(F.col("name").alias("canonical")).agg(F.count(F.lit(1)).alias("canonical_after"))
    t = resolved.join(r, "variant", "left").join(left, "variant", "left").join(to, "canonical", "left").na.fill(0)
    status = F.when(F.col("variant") == F.col("canonical"), "SELF_MAPPING").when(F.col("raw_mentions") == 0, "NOT_PRESENT_IN_INPUT").when((F.col("variant_after") == 0) & (F.col("canonical_after") > 0), "PASS").otherwise("FAIL")
    return t.select("variant", "canonical", "raw_mentions", "variant_after", "canonical_after", status.alias("status")).orderBy("variant")


def component_rules(table: DataFrame) -> DataFrame:
    """variant_key, canonical, component_type of accepted rows; a bad type or two targets for a key are errors."""
    clean = table.select(T.clean_affiliation("Variant").alias("variant"), T.clean_affiliation("Canonical").alias("canonical"), F.col("Component_Type").alias("raw_type"), "Decision")
    rows = clean.select(T.lookup_key("variant").alias("variant_key"), "canonical", T.component_type("raw_type").alias("component_type"), T.decision("Decision").alias("d"), "raw_type")
    rows = rows.filter("d = 'accept' and variant_key != '' and canonical != ''")
    bad = F.raise_error(F.concat(F.lit("bad component type "), F.coalesce("raw_type", F.lit("")))).cast("string")
    rows = rows.withColumn("component_type", F.when(F.col("component_type") == "", bad).otherwise(F.col("component_type")))
    grouped = rows.groupBy("variant_key").agg(F.array_sort(F.collect_set(F.struct("canonical", "component_type"))).alias("t"))
    clash = F.raise_error(F.concat(F.lit("conflicting mappings for "), F.col("variant_key"))).cast("struct<canonical:string,component_type:string>")
    return grouped.select("variant_key", F.when(F.size("t") > 1, clash).otherwise(F.get("t", F.lit(0))).alias("t")).select("variant_key", "t.canonical", "t.component_type")


def countries(rows: DataFrame, row_id: str, entries: str, country_rules: DataFrame) -> DataFrame:
    """row_id, countries: the mapped country of every component of every affiliation, each once, in order."""
    comps = rows.select(row_id, F.posexplode(F.flatten(F.transform(entries, lambda e: e["components"]))).alias("pos", "component"))
    hit = comps.withColumn("variant_key", T.lookup_key("component")).join(country_rules.filter("component_type = 'country'").select("variant_key", "canonical"), "variant_key")
    firsts = hit.groupBy(row_id, "canonical").agg(F.min("pos").alias("pos"))
    lists = firsts.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("z"))
    return rows.select(row_id).join(lists, row_id, "left").select(row_id, F.coalesce(F.transform("z", lambda s: s["canonical"]), F.array().cast("array<string>")).alias("countries"))


def component_records(rows: DataFrame, row_id: str, entries: str, country_rules: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Per component key: first spelling, mentions (once per affiliation), the most common raw affiliation, mapped."""
    key = T.ascii_key if ascii_only else T.lookup_key
    flat = rows.select(row_id, F.posexplode(entries).alias("a", "entry")).select(row_id, "a", "entry.raw_affiliation", F.posexplode("entry.components").alias("pos", "spelling")).withColumn("component_key", key("spelling")).filter("component_key != ''")
    once = flat.groupBy("component_key", row_id, "a").agg(F.min_by("spelling", "pos").alias("spelling"), F.first("raw_affiliation").alias("raw"), F.min("pos").alias("pos"))
    place = F.struct(F.col(row_id), F.col("a"), F.col("pos"))
    raws = once.groupBy("component_key", "raw").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.min_by("spelling", place).alias("spelling"))
    best = F.struct((-F.col("n")).alias("n"), F.col("at").alias("at"))
    out = raws.groupBy("component_key").agg(F.min_by("spelling", "at").alias("spelling"), F.sum("n").alias("mentions"), F.min_by("raw", best).alias("example"))
    if country_rules is None:
        return out.withColumn("mapped", F.lit(False))
    return out.join(country_rules.select(F.col("variant_key").alias("component_key"), F.lit(True).alias("m")), "component_key", "left").withColumn("mapped", F.coalesce("m", F.lit(False))).drop("m")


def blocks(key: Column) -> Column:
    """Blocking tokens of a component key: first and last two words, both ends of the compact form, its initial with its
    length class; generic words are none."""
    w = T.tokens(key)
    compact = F.replace(key, F.lit(" "), F.lit(""))
    sized = F.concat(F.left(compact, F.lit(1)), F.lit(":"), F.floor(F.length(compact) / 5).cast("string"))
    all_ = F.concat(F.slice(w, 1, 2), F.slice(F.reverse(w), 1, 2), F.array(F.left(compact, F.lit(8)), F.right(compact, F.lit(8)), sized))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_except(all_, F.array(*map(F.lit, GENERIC_BLOCKS))))


def component_candidates(records: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Pairs of component keys that share a block and are similar by words or by characters, the better-ranked one as canonical.

    records: component_key (distinct), spelling, mentions. Similar pairs come from similarity joins, so a block of any size is
    not paired with itself.
    """
    known = checkpointed(records.select("component_key", "spelling", "mentions"))
    keyed = known.select(F.col("component_key").alias("key"), order_key("component_key").alias("o"), blocks(F.col("component_key")).alias("blocks"))
    by_words, by_characters = similar_pairs(keyed, threshold, text="o"), similar_pairs(keyed, CHARACTERS, text="key")
    pairs = by_words.select("a", "b").union(by_characters.select("a", "b")).distinct()
    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(known.select(F.col("component_key").alias(side), *[F.col(c).alias(f"{name}_{c}") for c in known.columns]), side)
    scored = pairs.withColumn("m", component_metrics(F.col("x_component_key"), F.col("y_component_key"), threshold, CHARACTERS)).filter("m.accepted")
    rank = lambda s: F.struct(F.col(f"{s}_mentions"), F.size(T.tokens(f"{s}_component_key")), F.length(f"{s}_spelling"), F.lower(f"{s}_spelling"))
    top = rank("x") >= rank("y")
    of = lambda c: (F.when(top, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")), F.when(top, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")))
    (variant, canonical), (v_key, c_key), (v_n, c_n) = of("spelling"), of("component_key"), of("mentions")
    return scored.select(
        variant.alias("variant"), canonical.alias("canonical"), "m.token_sort", "m.characters", "m.jaccard", "m.containment", "m.reason",
        v_key.alias("variant_key"), c_key.alias("canonical_key"), v_n.alias("variant_mentions"), c_n.alias("canonical_mentions"),
    )


def extend_template(template: DataFrame, candidates: DataFrame) -> DataFrame:
    """template with the candidates whose pair of keys it lacks, in template order."""
    keyed = lambda df: df.withColumns({"vk": T.lookup_key("variant"), "ck": T.lookup_key("canonical")})
    new = keyed(candidates).join(keyed(template).select("vk", "ck"), ["vk", "ck"], "left_anti")
    both = keyed(template).unionByName(new, allowMissingColumns=True)
    return both.orderBy("ck", "vk", F.coalesce("token_sort", F.lit(-1.0)).desc()).drop("vk", "ck")


def fill_ids(template: DataFrame, authors: DataFrame) -> DataFrame:
    """template (variant, variant_id, canonical, canonical_id) with blank ids filled where a name, or its canonical group, has exactly one id.

    authors: name, aid; a row per mention.
    """
    known = authors.filter("aid != ''").groupBy("name").agg(F.min("aid").alias("one"), F.max("aid").alias("last")).filter("one = last").select("name", "one")
    t = template
    for name, aid in (("variant", "variant_id"), ("canonical", "canonical_id")):
        t = t.join(known.select(F.col("name").alias(name), F.col("one").alias("f")), name, "left").withColumn(aid, F.when(F.coalesce(aid, F.lit("")) == "", F.coalesce("f", F.lit(""))).otherwise(F.col(aid))).drop("f")
    ids = t.select(F.col("canonical").alias("c"), F.explode(F.array("variant_id", "canonical_id")).alias("id")).filter("id != ''")
    one = ids.groupBy("c").agg(F.min("id").alias("f"), F.max("id").alias("last")).filter("f = last").select("c", "f")  # a group's ids are not gathered
    t = t.join(one, F.col("canonical").eqNullSafe(F.col("c")), "left")
    return t.withColumn("canonical_id", F.when(F.col("canonical_id") == "", F.coalesce("f", F.lit(""))).otherwise(F.col("canonical_id"))).select(*template.columns)


def author_candidates(mentions: DataFrame, threshold: float = 90.0, known: DataFrame | None = None, components=None) -> DataFrame:
    """variant, canonical, score, reason: names on one id, names with a known canonical's words, fuzzy components.

    mentions: name, aid. known: column `name` of canonical names. The first reason of a variant wins. Names with one key are a class;
    similar classes come from a similarity join, and a name is scored against its component's canonical
    name, so the output grows with the names and not with their pairs.
    """
    from citegrid.operators.graph import labels_of

    freq = mentions.filter("name != ''").groupBy("name", "aid").agg(F.count(F.lit(1)).alias("n")).withColumn("k", T.lookup_key("name"))
    names = freq.groupBy("name", "k").agg(F.sum("n").alias("n"), F.max(F.when(F.col("aid") != "", 1).otherwise(0)).alias("has_id"), F.collect_set(F.nullif("aid", F.lit(""))).alias("aids"))
    words = T.tokens("k")
    rank = F.struct("has_id", "n", F.size(words), -F.size(F.filter(words, lambda w: F.length(w) == 1)), F.length("name"), F.lower("name"))
    ranked = checkpointed(names.withColumn("rank", rank).withColumn("o", order_key("k")))  # read by every part below
    on_id = ranked.select("name", "k", "rank", F.explode("aids").alias("aid"))
    same = on_id.groupBy("aid").agg(F.countDistinct("k").alias("kinds"), F.max_by("name", "rank").alias("canonical"), F.collect_set("name").alias("all")).filter("kinds > 1")
    by_id = same.select(F.explode("all").alias("variant"), "canonical", F.lit(100.0).alias("score"), F.lit("same_author_id").alias("reason"), F.lit(0).alias("o")).filter("variant != canonical")
    parts = [by_id]
    if known is not None:
        table = _unambiguous(known.select(T.order_key(T.lookup_key("name")).alias("key"), "name"))
        hit = ranked.join(table.select(F.col("key").alias("o"), F.col("name").alias("canonical")), "o").filter("name != canonical")
        parts.append(hit.select(F.col("name").alias("variant"), "canonical", F.lit(100.0).alias("score"), F.lit("same_words_as_canonical").alias("reason"), F.lit(1).alias("o")))
    classes = ranked.groupBy("k").agg(F.first("o").alias("o"), F.count(F.lit(1)).alias("members")).withColumn("blocks", word_blocks(T.tokens("k")))
    pairs = similar_pairs(classes, threshold - 0.005, key="k", text="o").withColumn("score", F.round("ratio", 2)).filter(F.col("score") >= threshold)
    linked = checkpointed(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score"))
    nodes = linked.select(F.explode(F.array("src", "dst")).alias("entity")).union(classes.filter("members > 1 and k != ''").select("k")).distinct()
    comp = (components or labels_of)(linked.select("src", "dst", F.lit(1).alias("shared"), F.lit(1.0).alias("weight")), nodes)
    members = checkpointed(comp.withColumnRenamed("entity", "k").join(ranked.select("name", "k", "rank"), "k"))
    stars = members.groupBy("label").agg(F.max_by(F.struct("name", "k"), "rank").alias("c")).select("label", F.col("c.name").alias("canonical"), F.col("c.k").alias("ck"))
    spokes = members.select("label", F.col("name").alias("variant"), "k").join(stars, "label").filter("variant != canonical")
    direct = linked.select(F.col("src").alias("k"), F.col("dst").alias("ck"), "score").union(linked.select("dst", "src", "score"))
    best = direct.select("k", "score").union(classes.filter("members > 1").select("k", F.lit(100.0))).groupBy("k").agg(F.max("score").alias("best"))
    near = spokes.join(direct, ["k", "ck"], "left").join(best, "k")
    score = F.when(F.col("k") == F.col("ck"), 100.0).otherwise(F.coalesce("score", "best"))
    parts.append(near.select("variant", "canonical", score.alias("score"), F.lit("similar_name").alias("reason"), F.lit(2).alias("o")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("n", F.row_number().over(Window.partitionBy("variant").orderBy("o", F.desc("score"), "canonical"))).filter("n = 1").select("variant", "canonical", "score", "reason").orderBy("canonical", "variant")


def recovered_authors(records: DataFrame, cache: DataFrame, least: int = 10) -> DataFrame:
    """records with authors, author_source: an external list replaces the listed one when the record lists at least `least`
    authors, has an identifier, and the external list is longer. cache: doi, authors, status."""
    joined = records.withColumn("k_doi", T.doi_key("doi")).join(cache.select(F.col("doi").alias("k_doi"), F.col("authors").alias("external"), F.col("status").alias("external_status")), "k_doi", "left")
    asked = (F.size("listed") >= least) & (F.col("k_doi") != "")
    longer = asked & (F.coalesce(F.size("external"), F.lit(0)) > F.size("listed"))
    source = F.when(~asked, "listed").when(longer, "external").when(F.col("external").isNull() & F.col("external_status").isNull(), "not_cached").otherwise(F.coalesce("external_status", F.lit("listed")))
    return joined.select(*records.columns, F.when(longer, F.col("external")).otherwise(F.col("listed")).alias("authors"), source.alias("author_source"))


def align_to_recovered(listed: list[str], ids: list[str], recovered: list[str]) -> list[str]:
    """Ids for recovered authors: equal names or word sets that are unambiguous, then the surname at the same position, then
    the most similar surname of at least 70; each listed author serves once."""
    from citegrid.functions.similarity import lcs_length

    key = lambda s: " ".join(sorted("".join(ch if ch.isalnum() else " " for ch in s.lower()).split()))
    last = lambda s: key(s.split(",")[0] if "," in s else (s.split() or [""])[-1])
    ids = (list(ids) + [""] * len(listed))[: len(listed)]
    free, out = set(range(len(listed))), [""] * len(recovered)
    open_ = []
    for r, name in enumerate(recovered):
        same = [i for i in sorted(free) if key(listed[i]) == key(name)]
        if len(same) == 1:
            out[r] = ids[same[0]]
            free.discard(same[0])
        else:
            open_.append(r)
    rest = []
    for r in open_:
        if r in free and last(listed[r]) == last(recovered[r]):
            out[r] = ids[r]
            free.discard(r)
        else:
            rest.append(r)
    for r in rest:
        a = last(recovered[r])
        scored = [(200.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0, -i) for i in free for b in [last(listed[i])]]
        if scored and max(scored)[0] >= 70:
            i = -max(scored)[1]
            out[r] = ids[i]
            free.discard(i)
    return out
