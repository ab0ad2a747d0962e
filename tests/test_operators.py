"""Operators on small tables with results worked out by hand, and negative cases."""

import pytest
from pyspark.sql import functions as F

from citegrid.operators import entities as E
from citegrid.operators import graph as G
from citegrid.operators import linkage as L
from citegrid.operators import mapping as M
from citegrid.operators import terms as D
from citegrid.sources import records as R
from citegrid.sources import sinks as K


def papers(spark, rows):
    return spark.createDataFrame(rows, "id long, year double, cited long, open boolean, authors array<string>, journal string")


def test_full_counting(spark):
    p = E.annualized(papers(spark, [(1, 2020.0, 3, True, ["A", "B", "A"], "j"), (2, None, 4, False, ["B", " "], "")]), 2024)
    got = {r.author: (r.publications, r.citations, round(r.total_rate, 4), round(r.mean_rate, 4)) for r in E.productivity(p, "authors", "author").collect()}
    assert got == {"B": (2, 7, 0.6, 0.6), "A": (1, 3, 0.6, 0.6)}
    assert [r.journal for r in E.column_productivity(p, "journal", "journal").collect()] == ["j"]


def test_annualized(spark):
    p = papers(spark, [(1, 2020.0, 10, True, [], ""), (2, None, 5, True, [], "")])
    got = {r.id: (r.citation_years, r.citation_rate) for r in E.annualized(p, 2024).collect()}
    assert got == {1: (5, 2.0), 2: (None, None)}
    with pytest.raises(Exception, match="before the latest year"):
        E.annualized(p, 2019).collect()


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    r = E.describe(df, ["v"], {"unit": "x"}).first()
    assert (r.n, r.mean, r.median, round(r.deviation, 6), r.least, r.most) == (4, 4.25, 3.0, 4.031129, 1.0, 10.0)
    d = E.distribution(df.filter("v < 100"), [], "v", "v").first()
    assert (d.v_q1, d.v_q3, d.v_iqr) == (1.75, 5.5, 3.75)
    empty = E.distribution(df.filter("v > 1000 and v < 2000"), [], "v", "v").first()
    assert set(empty.asDict().values()) == {0}
    assert E.describe(df.filter("v = 10"), ["v"], {}).first().deviation == 0.0
    assert E.describe(df.filter("v is null"), ["v"], {}).count() == 0


def test_open_access_fixed_rows(spark):
    p = E.annualized(papers(spark, [(1, 2020.0, 2, True, ["A"], "")]))
    rows = {r.status: r for r in E.open_access_summary(p).collect()}
    assert rows["Open Access"].share == 100.0
    assert rows["Not Open Access"].publications == 0
    assert rows["Not Open Access"].mean_citations == 0
    c = E.open_access_by_entity(p, "authors", "author").first()
    assert c.closed_mean_citations is None and c.mean_citations_ratio is None


def test_ranks_ticks_and_plots(spark):
    t = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3)], "n string, v long")
    assert [r["rank"] for r in E.competition_rank(t, "v", "n").collect()] == [1, 1, 3]
    ticks = spark.createDataFrame([(250,), (0,), (1,), (1000,)], "m long").select(E.tick_values(F.col("m")).alias("t"))
    assert [r.t for r in ticks.collect()] == [[0, 1, 10, 100, 250], [0], [0, 1], [0, 1, 10, 100, 1000]]
    vals = spark.createDataFrame([(2.5,), (None,), (3.456,)], "v double").select(E.plot_value(F.col("v")).alias("i"), E.plot_value(F.col("v"), "float").alias("f"))
    assert [(r.i, r.f) for r in vals.collect()] == [("2", "2.5"), ("", ""), ("3", "3.46")]
    assert K.safe_name("a/b  c*?__d_") == "a_b_c_d"


def test_edges_keep_the_full_list_size(spark):
    p = papers(spark, [(1, 2020.0, 1, True, ["A", "B", "C"], "")])
    allowed = spark.createDataFrame([("A",), ("B",)], "entity string")
    e = G.edges(p, "id", "authors", allowed).collect()
    assert [(r.src, r.dst, r.shared, r.weight) for r in e] == [("A", "B", 1, 0.5)]


def test_edges_of_a_long_list(spark):
    p = papers(spark, [(1, 2020.0, 1, True, [f"n{i:04}" for i in range(1200)], ""), (2, 2020.0, 1, True, ["n0000", "n0001"], "")])
    e = G.edges(p, "id", "authors")
    assert e.count() == 1200 * 1199 // 2
    assert [(r.shared, round(r.weight, 9)) for r in e.filter("src = 'n0000' and dst in ('n0001', 'n1199')").orderBy("dst").collect()] == [(2, round(1 + 1 / 1199, 9)), (1, round(1 / 1199, 9))]


def path_graph(spark):
    e = spark.createDataFrame([("a", "b", 1, 1.0), ("b", "c", 1, 1.0), ("x", "y", 1, 1.0)], "src string, dst string, shared long, weight double")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "entity string")
    return e, nodes


def test_graph_measures(spark):
    e, nodes = path_graph(spark)
    comp = {r.entity: (r.component, r.component_size) for r in G.components(e, nodes).collect()}
    assert comp == {"a": (1, 3), "b": (1, 3), "c": (1, 3), "x": (2, 2), "y": (2, 2), "z": (3, 1)}
    m = {r.entity: r for r in G.node_measures(e, nodes).collect()}
    assert m["b"].betweenness == pytest.approx(2 / 20)
    assert m["a"].betweenness == 0
    assert m["b"].closeness == pytest.approx(2 / 2 * 2 / 5)
    assert m["z"].closeness == 0
    assert m["a"].community == m["b"].community != m["x"].community
    g = G.graph_measures(e, nodes).first()
    assert (g.mean_path, g.diameter) == (pytest.approx(8 / 6), 2.0)
    r = {x.entity: x.pagerank for x in G.pagerank(e, nodes, rounds=40).collect()}
    assert sum(r.values()) == pytest.approx(1.0, abs=1e-6)
    assert r["b"] > r["a"] > r["z"]
    d = G.density(e, nodes).first()
    assert (d.nodes, d.edges, d.isolates, d.triangles) == (6, 3, 1, 0)


def record(n, title, year="2020", doi="", author="Doe, J.", kind="Article", cites="0", abstract="", **more):
    base = {"row_order": n, "source_row": n + 2, "title": title, "year": year, "doi": doi, "author_full_names": author, "document_type": kind, "cited_by": cites, "abstract": abstract, "source_title": "S", "publisher": "", "author_keywords": "", "open_access": ""}
    return base | more


def frame(spark, rows):
    schema = "row_order long, source_row long, title string, year string, doi string, author_full_names string, document_type string, cited_by string, abstract string, source_title string, publisher string, author_keywords string, open_access string"
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in schema.split(", ")) for r in rows], schema)


def compared(spark, rows):
    w = L.prepare(frame(spark, rows))
    return w, L.compare(L.with_keys(L.candidate_pairs(w), w))


def test_comparison_branches(spark):
    rows = [record(0, "Gene therapy one", doi="10.1/a"), record(1, "Gene therapy one", doi="10.1/A."), record(2, "Gene therapy one", year="2021", doi="10.1/a"), record(3, "Gene therapy one"), record(4, "Gene therapy one", doi="10.1/b"), record(5, "Gene therapy one", author="Other, X."), record(6, "Gene therapy ones", author="Q, Z.")]
    _, c = compared(spark, rows)
    got = {(r.first, r.second): (r.automatic, r.removal_reason, r.suggested_review) for r in c.collect()}
    assert got[0, 1] == (True, "same_normalized_doi_title_and_year", "")
    assert got[0, 2] == (False, "", "REVIEW_SHARED_DOI_DIFFERENT_YEAR")
    assert got[0, 3] == (True, "normalized_title_year_first_author_with_missing_doi", "")
    assert got[0, 4] == (False, "", "REVIEW_IDENTICAL_TITLE_YEAR_CONFLICTING_DOI")
    assert got[3, 5] == (False, "", "REVIEW_IDENTICAL_TITLE_AND_YEAR")
    assert got[3, 6] == (False, "", "REVIEW_FUZZY_TITLE")


def test_conflicting_identifiers_stay_apart_and_are_queued(spark):
    rows = [record(0, "T one two", doi="10.1/a"), record(1, "T one two"), record(2, "T one two", doi="10.1/b")]
    w, c = compared(spark, rows)
    clusters, reviews = L.cluster(w, c, "d")
    kept = {r.k_order: r.kept for r in clusters.collect()}
    assert kept[0] == kept[1] == 0 and kept[2] == 2
    assert [r.suggestion for r in reviews.collect()] == ["REVIEW_COMPONENT_CONFLICTING_DOI"]


def test_decisions_override(spark):
    rows = [record(0, "T one two"), record(1, "T one two"), record(2, "Another title here")]
    w, c = compared(spark, rows)
    pid = c.withColumn("p", L.pair_id(F.lit("d"))).first()["p"]
    apart = spark.createDataFrame([(pid, "KEEP_BOTH")], "pair_id string, verdict string")
    assert {r.k_order: r.kept for r in L.cluster(w, c, "d", apart)[0].collect()} == {0: 0, 1: 1, 2: 2}
    gone = spark.createDataFrame([(pid, "REMOVE_RECORD_1")], "pair_id string, verdict string")
    clusters, reviews = L.cluster(w, c, "d", gone)
    assert {r.k_order: r.kept for r in clusters.collect()} == {0: 1, 1: 1, 2: 2}
    assert reviews.first().status == "APPLIED_TO_FINAL_COMPONENT"
    assert L.removals(clusters, w).first().removal_reason == "manual_duplicate_decision"


def test_merge_rules(spark):
    rows = [
        record(0, "T one two", cites="3", abstract="N/A", author_keywords="Gene; x", open_access="Gold"),
        record(1, "T one two", cites="9", abstract="long text", author_keywords="gene; Y", open_access="closed access", publisher="P"),
    ]
    out = L.deduplicate(frame(spark, rows), "d")
    r = out["records"].first()
    assert out["records"].count() == 1
    assert (r.cited_by, r.abstract, r.open_access, r.publisher) == (9, "long text", "Gold", "P")
    assert sorted(x.lower() for x in r.author_keywords.split("; ")) == ["gene", "x", "y"]


def test_venue_blocks_over_the_limit_have_no_pairs(spark):
    rows = [record(n, f"w{n} common alpha beta gamma") for n in range(6)]
    w = L.prepare(frame(spark, rows))
    assert L.venue_block_pairs(w, 6).count() == 15
    assert L.venue_block_pairs(w, 5).count() == 0


def test_chains(spark):
    rules = M.rules(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x"), ("a", "b")], "Variant string, Canonical string"))
    assert {r.variant: r.canonical for r in M.chains(rules).collect()} == {"a": "c", "b": "c", "x": "x"}
    rules.createOrReplaceTempView("rules_view")
    assert {r.variant: r.canonical for r in M.chains_sql(spark, "rules_view").collect()} == {"a": "c", "b": "c"}
    with pytest.raises(Exception, match="circular"):
        M.chains(M.rules(spark.createDataFrame([("a", "b"), ("b", "a")], "Variant string, Canonical string"))).collect()
    with pytest.raises(Exception, match="conflicting"):
        M.rules(spark.createDataFrame([("a", "b"), ("a", "c")], "Variant string, Canonical string")).collect()
    with pytest.raises(Exception, match="bad component type"):
        M.component_rules(spark.createDataFrame([("a", "b", "planet", "yes")], "Variant string, Canonical string, Component_Type string, Decision string")).collect()


def test_long_chains_and_cycles(spark):
    links = [(f"n{k}", f"n{k + 1}") for k in range(140)]
    rules = M.rules(spark.createDataFrame(links, "Variant string, Canonical string"))
    assert {r.canonical for r in M.chains(rules).collect()} == {"n140"}
    M.checkpointed(M.rules(spark.createDataFrame(links[66:], "Variant string, Canonical string"))).createOrReplaceTempView("long_view")
    assert {r.canonical for r in M.chains_sql(spark, "long_view").collect()} == {"n140"}
    circle = M.checkpointed(M.rules(spark.createDataFrame([*links[:9], ("n9", "n3"), ("x", "y")], "Variant string, Canonical string")))
    circle.createOrReplaceTempView("circle_view")
    for made in (M.chains(circle), M.chains_sql(spark, "circle_view")):
        with pytest.raises(Exception, match="circular mapping"):
            made.collect()


def test_target_ids_of_chains(spark):
    rules = spark.createDataFrame([("a", "b", "1"), ("b", "c", "2"), ("c", "d", ""), ("x", "y", ""), ("y", "y", "9"), ("p", "q", "5")], "variant string, canonical string, target_id string")
    assert {r.variant: (r.canonical, r.target_id) for r in M.chains(rules).collect()} == {"a": ("d", "2"), "b": ("d", "2"), "c": ("d", ""), "x": ("y", "9"), "y": ("y", "9"), "p": ("q", "5")}


def test_component_chains_follow_keys(spark):
    rows = [("U.K.", "United Kingdom"), ("United-Kingdom", "Great Britain"), ("Great Britain", "great britain"), ("Wales", "Cymru")]
    table = spark.createDataFrame([(*r, "country", "accept") for r in rows], "Variant string, Canonical string, Component_Type string, Decision string")
    got = {r.variant_key: r.canonical for r in M.component_chains(M.component_rules(table)).collect()}
    assert got == {"u k": "great britain", "united kingdom": "great britain", "great britain": "great britain", "wales": "Cymru"}
    circle = spark.createDataFrame([("a", "B", "city", "yes"), ("b", "A", "city", "yes")], table.schema)
    with pytest.raises(Exception, match="circular"):
        M.component_chains(M.component_rules(circle)).collect()


def test_component_blocks(spark):
    keys = {"laboratory of a": {"laborato", "atoryofa", "l:2"}, "university of south wales": {"south", "wales", "universi", "uthwales", "u:4"}, "": set(), "lab": {"lab", "l:0"}}
    got = {r.k: set(r.b) for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", M.blocks(F.col("k")).alias("b")).collect()}
    assert got == keys


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).repartition(1).sortWithinPartitions("id").selectExpr("cast(id as string) as v").coalesce(1).write.text(path)
    rows = R.number_rows(spark.read.text(path).repartition(5), "at", 3).collect()
    assert sorted(r["at"] for r in rows) == list(range(3, 1003)) and len({r.value for r in rows}) == 1000
    assert [(r["at"], r.value) for r in R.number_rows(spark.read.text(path)).withColumnRenamed("row_order", "at").collect()][:3] == [(0, "0"), (1, "1"), (2, "2")]


def test_review_queue_from_exports(spark, tmp_path):
    """Undecided manual pairs, decided ones, and an automatic duplicate that a reviewer overrides, through the stage."""
    import csv

    from citegrid.plans import stages

    columns = ["Author full names", "Author(s) ID", "Title", "Year", "Source title", "Volume", "Issue", "Art. No.", "DOI", "Abstract", "Cited by", "Document Type"]
    text = "gene therapy of primary immunodeficiency"
    one = lambda title, year, doi, names="Abel, A. (10000001); Bell, B. (10000002)": [names, "", f"{title} {text}", year, "Journal of Tests", "1", "", "", doi, text, "3", "Article"]
    rows = [one("alpha", "2020", "10.1/a"), one("alpha", "2020", ""), one("beta", "2021", "10.1/b"), one("beta", "2021", "10.1/c"), one("gamma", "2020", "10.1/d"), one("gamma", "2020", "10.1/d"), one("delta", "2019", "", "Cole, C. (10000003)"), one("delta", "2019", "", "Dunn, D. (10000004)")]
    path = tmp_path / "part.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([columns, *rows])
    raw = R.read_records(spark, str(path))
    kept = stages.preprocess(raw, "part")
    first = {(r.record_1_title.split()[0], r.suggested_review, r.decision) for r in kept["reviews"].collect()}
    assert first == {("beta", "REVIEW_IDENTICAL_TITLE_YEAR_CONFLICTING_DOI", ""), ("delta", "REVIEW_IDENTICAL_TITLE_AND_YEAR", "")}
    assert kept["records"].count() == 6
    ids = {r.record_1_title.split()[0]: r.pair_id for r in kept["reviews"].collect()}
    auto = kept["pairs"].filter("automatic").withColumn("pair_id", L.pair_id(F.lit("part"))).collect()
    gamma = next(r.pair_id for r in auto if r.a_k_title.startswith("gamma"))
    verdicts = spark.createDataFrame([(ids["delta"], "REMOVE_RECORD_1"), (gamma, "KEEP_BOTH")], "pair_id string, verdict string")
    again = stages.preprocess(raw, "part", decisions=verdicts)
    rows = {r.record_1_title.split()[0]: r for r in again["reviews"].collect()}
    assert set(rows) == {"beta", "gamma", "delta"}
    assert rows["gamma"].suggested_review == "MANUAL_OVERRIDE_OF_AUTOMATIC_DUPLICATE" and rows["gamma"].decision == "KEEP_BOTH" and rows["gamma"].removal_reason == ""
    assert rows["delta"].decision == "REMOVE_RECORD_1" and rows["delta"].decision_status == "APPLIED_TO_FINAL_COMPONENT"
    assert rows["beta"].decision == "" and rows["beta"].manual and rows["beta"].record_2_title.startswith("beta")
    assert again["records"].count() == 6
    queue = L.review_queue([again["reviews"], kept["reviews"]])
    assert queue.count() == 3 and {r.decision for r in queue.collect()} == {"", "KEEP_BOTH", "REMOVE_RECORD_1"}


def test_cascade_and_lists(spark):
    resolved = spark.createDataFrame([("Doe, J", "Doe, Jane"), ("Roe R", "Roe, Rita")], "variant string, canonical string")
    names = spark.createDataFrame([("Doe, J",), ("DOE J",), ("j doe",), ("Jane Doe",), ("Nobody",), ("",)], "name string")
    got = {r.name: (r.canonical, r.standardized) for r in M.cascade(names, M.lookups(resolved)).collect()}
    assert got == {"Doe, J": ("Doe, Jane", True), "DOE J": ("Doe, Jane", True), "j doe": ("Doe, Jane", True), "Jane Doe": ("Doe, Jane", True), "Nobody": ("Nobody", False), "": ("", True)}
    rows = spark.createDataFrame([(1, ["Doe, J", "Jane Doe", "Nobody"], ["12345", "", "99999"]), (2, [], [])], "id long, a array<string>, i array<string>")
    got = {r.id: (r.authors, r.author_ids) for r in M.apply_to_lists(rows, "id", "a", "i", M.lookups(resolved)).collect()}
    assert got == {1: (["Doe, Jane", "Nobody"], ["12345", "99999"]), 2: ([], [])}


def test_align_to_recovered():
    assert M.align_to_recovered(["Doe, J", "Roe, R"], ["11111", "22222"], ["R Roe", "Jane Doe", "New One"]) == ["22222", "11111", ""]


def test_terms(spark):
    words = {"immune defect": ["XIAP deficiency", "XIAP"], "other": ["XIAP", "long phrase here"]}
    d = spark.createDataFrame([(k, i, t) for k, ts in words.items() for i, t in enumerate([k, *ts])], "disease string, position int, term string")
    vocab = D.vocabulary(d)
    symbols = {(r.disease, r.term): r.symbol for r in vocab.collect()}
    assert symbols["immune defect", "XIAP"] and not symbols["immune defect", "XIAP deficiency"]
    texts = spark.createDataFrame([(1, "title", "XIAP in a patient"), (2, "abstract", "xiap alone far from anything"), (3, "abstract", "xiap"), (3, "title", "xiap"), (4, "abstract", "a long phrase here"), (5, "title", "xiaps")], "row_id long, field string, text string")
    got = {(r.row_id, r.disease): (r.accepted, r.strict, r.category[:8]) for r in D.assign(D.matches(texts, D.term_index(vocab))).collect()}
    assert got[1, "other"] == (True, False, "Context-")
    assert got[2, "other"] == (False, False, "")
    assert got[3, "immune defect"] == (True, False, "Repeated")
    assert got[4, "other"] == (True, True, "Normaliz")
    assert not any(k[0] == 5 for k in got)


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Title,Year,Cited by,Extra\n"Two\nlines",2020,7,NA\nB,12d,x,e\n', encoding="utf-8")
    got = R.read_records(spark, str(p)).orderBy("row_order").collect()
    assert [(r.title, r.year, r.cited_by, r.Extra, r.source_row) for r in got] == [("Two lines", 2020.0, 7, "", 2), ("B", None, 0, "e", 3)]
    dec = tmp_path / "d.csv"
    dec.write_text("Pair_ID,Decision\np,keep_both\np,REMOVE_RECORD_1\nq,maybe\n")
    assert [(r.pair_id, r.verdict) for r in R.read_decisions(spark, str(dec)).collect()] == [("p", "REMOVE_RECORD_1")]
    assert R.read_decisions(spark, str(tmp_path / "none.csv")).count() == 0
    cache = tmp_path / "c.json"
    cache.write_text('{"10.1/a": {"authors": ["X"], "status": "found"}, "10.1/b": {"authors": null, "status": "http_404"}, "10.1/c": {"authors": [], "status": "timeout"}}')
    assert sorted(r.doi for r in R.read_author_cache(spark, str(cache)).collect()) == ["10.1/a", "10.1/b"]
    terms = tmp_path / "t.json"
    terms.write_text('{"D": ["x", "y"], "E": 5}')
    assert sorted((r.disease, r.term) for r in R.read_dictionary(spark, str(terms)).collect()) == [("D", "D"), ("D", "x"), ("D", "y"), ("E", "E")]
    assert R.fullest(["a", "b"], lambda x: {"a": -1, "b": 3}[x]) == "b"
    with pytest.raises(ValueError, match="different folders"):
        R.combined_path("/x/a.csv", "/y/b.csv")
    with pytest.raises(ValueError, match="no columns"):
        R.gather(spark.range(1), "Author", "authors")
    with pytest.raises(ValueError, match="lacks"):
        R.read_mapping(spark, str(dec))
    codes = spark.createDataFrame([("A", "AAA")], "name string, iso3 string")
    with pytest.raises(Exception, match="unknown country"):
        R.with_iso3(spark.createDataFrame([("B",)], "country string"), codes).collect()


def test_wide_lists_round_trip(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "id long, l array<string>")
    wide = K.widen(df, "l", "L")
    assert wide.columns == ["id", "L_1", "L_2", "L_3"]
    assert {r.id: r.l for r in R.gather(wide, "L", "l").collect()} == {1: ["a", "b", "c"], 2: []}


def test_eligibility_is_a_substring_rule(spark):
    df = spark.createDataFrame([("a Primary-Immunodeficiency study", ""), ("x", "inborn  errors of immunity!"), ("immunity", None)], "title string, abstract string")
    assert [r.title for r in R.eligible(df, columns=("title", "abstract")).collect()] == ["a Primary-Immunodeficiency study", "x"]
