"""The first stage from files to files: templates, candidates, validations, decisions and look-ups, run twice."""

import csv
import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from citegrid.plans import curation as U
from citegrid.plans import stages
from citegrid.sources import files
from citegrid.sources import lookups as W
from citegrid.sources import records as R

COLUMNS = ["Author full names", "Author(s) ID", "Title", "Year", "Source title", "DOI", "Abstract", "Affiliations", "Cited by", "Document Type"]
SUBJECT = "gene therapy of primary immunodeficiency"
MANY = "; ".join(f"Name{i}, A. ({10_000_000 + i})" for i in range(10))
MANY_IDS = "; ".join(str(10_000_000 + i) for i in range(10))


def export(path, rows):
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows([COLUMNS, *rows])
    return str(path)


@pytest.fixture
def service():
    """A service that answers for 10.1/a with twelve authors, knows nothing of 10.1/gone, and fails at first for 10.1/slow."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            doi = urllib.parse.unquote(self.path.rpartition("works/")[2])
            asked.append(doi)
            code = 404 if doi == "10.1/gone" else 503 if doi == "10.1/slow" and asked.count(doi) < 2 else 200
            n = 12 if doi == "10.1/a" else 0
            body = json.dumps({"message": {"author": [{"family": f"Name{i}", "given": "A."} for i in range(n)]}}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if code == 200 else b"{")

        def log_message(self, *args):
            return

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/works/", asked
    server.shutdown()


def rows_of(spark, path):
    return R.read_strings(spark, path).collect()


def test_preprocess_twice(spark, tmp_path, service):
    url, asked = service
    one = lambda title, doi, names="Abel, A. (10000101); Bell, B. (10000102)", ids="10000101; 10000102", places="Univ of Testing, Berlin, Germany; Univ of Testing, Berlin, Germny": [names, ids, f"{" ".join([title] * 5)} {SUBJECT}", "2020", "Journal", doi, SUBJECT, places, "3", "Article"]
    first = export(tmp_path / "first.csv", [one("alpha", "10.1/a", MANY, MANY_IDS), one("beta", "10.1/gone", MANY, MANY_IDS), one("gamma", "10.1/slow", MANY, MANY_IDS), one("delta", "", "Abel, A. (10000101)", "10000101"), one("delta", "", "Roe, R. (10000103)", "10000103")])
    second = export(tmp_path / "second.csv", [one("epsilon", "10.1/few"), one("alpha", "10.1/a", MANY, MANY_IDS), one("unlike all others", "", "Abell, A. (10000104)", "10000104", "Hospital of Examples, Germany")])
    out = f"file://{tmp_path}/out"
    run = lambda *more: stages.main(["preprocess", "--inputs", f"file://{first}", f"file://{second}", "--output", out, "--lookup-url", url, "--lookup-delay", "0.01", *more])
    run()
    assert sorted(set(asked)) == ["10.1/a", "10.1/gone", "10.1/slow"] and asked.count("10.1/gone") == 1 and asked.count("10.1/slow") == 2
    records = {r.title.split()[0]: r for r in spark.read.parquet(f"{out}/first").collect()}
    assert records["alpha"].author_source == "external" and len(records["alpha"].authors) == 12
    assert records["alpha"].author_ids[:10] == [str(10_000_000 + i) for i in range(10)] and records["alpha"].author_ids[10:] == ["", ""]
    assert records["beta"].author_source == "http_404" and records["gamma"].author_source == "found_no_authors"

    components = rows_of(spark, f"{out}/{stages.COMPONENTS}")
    kinds = {(r.Variant, r.Canonical): r for r in components}
    assert kinds["Germany", "Germany"]["Candidate Reason"] == "OBSERVED_COMPONENT" and kinds["Germany", "Germany"].Decision == "unresolved"
    assert kinds["Germny", "Germany"]["Candidate Reason"].startswith("STRICT_")
    assert [r.Canonical.lower() for r in components] == sorted(r.Canonical.lower() for r in components)
    similar = {(r.variant, r.canonical) for r in spark.read.parquet(f"{out}/author_similarity_candidates").collect()}
    assert ("Abell, A.", "Abel, A.") in similar
    assert spark.read.parquet(f"{out}/country_mapping_validation").count() == 0

    # the reviewer settles a country, names a variant, and decides on a pair
    edited = [{**r.asDict(), **({"Component_Type": "country", "Decision": "accept"} if (r.Variant, r.Canonical) in (("Germany", "Germany"), ("Germny", "Germany")) else {})} for r in components]
    edited.append({**dict.fromkeys(edited[0], ""), "Variant": "Nowhere", "Canonical": "Utopia", "Component_Type": "country", "Decision": "yes"})
    files.delete(spark, f"{out}/{stages.COMPONENTS}")
    with open(tmp_path / "out" / stages.COMPONENTS, "w", newline="") as f:  # a single file in the folder's place
        w = csv.DictWriter(f, edited[0].keys())
        w.writeheader()
        w.writerows(edited)
    names = export(tmp_path / "names.csv", [])
    with open(names, "w") as f:
        f.write("Variant,Canonical,Note\n\"Abell, A.\",\"Abel, A.\",same person\nNobody,Somebody,\n")
    pairs = {r.record_1_title.split()[0]: r.Pair_ID for r in rows_of(spark, f"{out}/{stages.REVIEWS}")}
    assert set(pairs) == {"delta"}
    queue = R.read_strings(spark, f"{out}/{stages.REVIEWS}").withColumn("Decision", F.lit("REMOVE_RECORD_2"))
    U.save(spark, spark.createDataFrame(queue.collect(), queue.schema), f"{out}/{stages.REVIEWS}")
    n = len(asked)
    run("--author-mapping", f"file://{names}")
    assert asked[n:] == ["10.1/slow"]  # answered without authors, so not settled; the others are not asked again
    first_again = spark.read.parquet(f"{out}/first")
    assert first_again.count() == 4 and {tuple(r.countries) for r in first_again.collect()} == {("Germany",)}
    status = {r.variant: r.status for r in spark.read.parquet(f"{out}/country_mapping_validation").collect()}
    assert status == {"Germany": "SELF_MAPPING", "Germny": "PASS", "Nowhere": "NOT_PRESENT_IN_INPUT"}
    validated = {r.variant: (r.raw_mentions, r.variant_after, r.status) for r in spark.read.parquet(f"{out}/author_mapping_validation").collect()}
    assert validated == {"Abell, A.": (1, 0, "PASS"), "Nobody": (0, 0, "NOT_PRESENT_IN_INPUT")}
    template = {r.Variant: r for r in rows_of(spark, f"{out}/{stages.AUTHORS}")}
    assert (template["Abell, A."]["Variant ID"], template["Abell, A."]["Canonical ID"], template["Abell, A."].Note) == ("10000104", "10000101", "same person")
    again = {(r.Variant, r.Canonical): r for r in rows_of(spark, f"{out}/{stages.COMPONENTS}")}
    assert set(again) == set(kinds) | {("Nowhere", "Utopia")} and again["Germny", "Germany"].Decision == "accept"
    decided = rows_of(spark, f"{out}/{stages.REVIEWS}")
    assert [(r.Pair_ID, r.Decision, r.decision_status) for r in decided if r.Pair_ID == pairs["delta"]] == [(pairs["delta"], "REMOVE_RECORD_2", "APPLIED_TO_FINAL_COMPONENT")]


def test_merge_cache(spark):
    schema = W.CACHE
    old = spark.createDataFrame([("a", ["X"], "found_no_authors"), ("b", None, "http_404"), ("c", None, "timeout"), ("d", ["Y"], "found_no_authors")], schema)
    new = spark.createDataFrame([("a", None, "timeout"), ("b", None, "http_500"), ("c", None, "http_410"), ("d", ["Z"], "found_no_authors"), ("e", None, "timeout")], schema)
    got = {r.doi: (r.authors, r.status) for r in W.merge_cache(old, new).collect()}
    assert got == {"a": (["X"], "found_no_authors"), "b": (None, "http_404"), "c": (None, "http_410"), "d": (["Z"], "found_no_authors"), "e": (None, "timeout")}


def test_paths_with_a_scheme(spark, tmp_path):
    """Decisions, mappings and caches by address are what they are by path; a missing one is none."""
    d, m, c = tmp_path / "d.csv", tmp_path / "m.csv", tmp_path / "c.json"
    d.write_text("Pair_ID,Decision\np,KEEP_BOTH\n")
    m.write_text("Variant,Canonical\na,b\n")
    c.write_text('{"10.1/a": {"authors": ["X"], "status": "found"}}')
    for prefix in ("", "file://"):
        assert R.read_decisions(spark, f"{prefix}{d}").count() == 1
        assert R.mapping_rows(spark, f"{prefix}{m}") == 1
        assert R.read_author_cache(spark, f"{prefix}{c}").count() == 1
        assert W.read_cache(spark, f"{prefix}{c}").count() == 1
        assert R.read_decisions(spark, f"{prefix}{d}x").count() == 0
        assert R.mapping_rows(spark, f"{prefix}{m}x") == -1
        assert R.component_mapping_rows(spark, f"{prefix}{m}x") == -1
    folder = f"file://{tmp_path}/table"
    for n in (1, 2):
        files.swap(spark, folder, lambda p, n=n: spark.range(n).write.parquet(p))
        assert spark.read.parquet(folder).count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if "table" in p.name) == ["table"]
