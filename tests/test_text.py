"""Keys and cleaners on hand-made values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrid.functions import text as T
from citegrid.functions.similarity import author_relation, lcs_length, native_ratio, ratio, token_sort_ratio


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("Müller–Straße, J.", "mullerstrae j"), ("Gene  THERAPY: a review", "gene therapy a review"), ("ﬁbrosis №5", "fibrosis no5"), ("Çelik, A.-B.", "celik a b"), (None, ""), ("", ""), ("JosÃ©", "jose")],
)
def test_lookup_key(spark, value, expected):
    assert one(spark, T.lookup_key, value) == expected


def test_keys(spark):
    assert one(spark, lambda c: T.order_key(T.lookup_key(c)), "Celik, A.-B.") == "a b celik"
    assert one(spark, lambda c: T.title_block(T.lookup_key(c)), "The Role of Gene Therapy in SCID") == "role gene"
    assert one(spark, lambda c: T.title_block(T.lookup_key(c)), "Of the") == "of the"
    assert one(spark, T.doi_key, "https://doi.org/10.1000/ABC.") == "10.1000/abc"
    assert one(spark, T.doi_key, " \"doi: 10.1/X;\" ") == "10.1/x"
    assert one(spark, T.author_id, "id 12345678 x") == "12345678"
    assert one(spark, T.author_id, "1234") == ""
    assert one(spark, T.year_key, "2020.0") == "2020"
    assert one(spark, T.year_key, "12d") == ""
    assert one(spark, T.clean_author, "Doe, J. (123456) [editor];") == "Doe, J."
    assert one(spark, T.author_list, "A; ;B (99999)") == ["A", "B"]
    assert one(spark, T.author_id_list, "123456; ;654321") == ["123456", "", "654321"]
    assert one(spark, T.surname_key, "Müller, Anna") == "muller"
    assert one(spark, T.surname_key, "Anna Müller") == "muller"
    assert one(spark, T.identity_key, "") == ""


def test_affiliations(spark):
    found = one(spark, T.affiliations, "\"Dept A ,, Uni B\"; ; City, Land |")
    assert [(a.raw_affiliation, a.components) for a in found] == [("Dept A,  Uni B", ["Dept A", "Uni B"]), ("City, Land", ["City", "Land"])]


def test_flags(spark):
    notice = lambda c: T.notice_type(T.lookup_key(c))
    assert one(spark, notice, "Retraction: X Erratum") == "retraction"
    assert one(spark, notice, "Expression of Concern on X") == "expression_of_concern"
    assert one(spark, notice, "A correction") == "correction_or_erratum"
    assert one(spark, notice, "corrections") == ""
    assert one(spark, T.open_access_affirmative, "Gold") is True
    assert one(spark, T.open_access_affirmative, "closed access") is False
    assert one(spark, T.open_access_status, "All Open Access, Gold") == "Open Access"
    assert one(spark, T.open_access_status, "Gold") == "Not Open Access"
    assert one(spark, T.decision, "Yes") == "accept"
    assert one(spark, T.component_type, "CITY") == "city"


def test_term_key(spark):
    assert one(spark, T.term_key, "IL2RG α-chain mutations") == "il 2 rg alpha chain mutation"
    assert one(spark, T.term_key, None) == ""


def test_similarity(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("abc", "abc"), ("", ""), ("", "a")], "a string, b string")
    got = [round(r.r, 2) for r in rows.select(ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [61.54, 100.0, 100.0, 0.0]
    native = [round(r.r, 2) for r in rows.select(native_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert native == got
    keys = spark.createDataFrame([("gene therapy review", "review gene therapy"), ("smith john", "smith jon")], "a string, b string")
    assert [round(r.r, 2) for r in keys.select(token_sort_ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [100.0, 94.74]


def test_author_relation(spark):
    rows = spark.createDataFrame([(list("abcd"), list("abc")), (list("abcd"), list("abxy")), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    got = [(r.r.status, r.r.score) for r in rows.select(author_relation(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [("strong", 0.875), ("different", 0.3333), ("unknown", 0.0), ("exact", 1.0)]


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert lcs_length(a, b) == naive_lcs(a, b) == lcs_length(b, a)


def test_keys_are_idempotent(spark):
    values = ["Ünïcode  Text – x", "a;b", "12 (34)", "", "ß", "éa"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(T.lookup_key("v").alias("k"))
    assert all(r.k == r.kk for r in df.select("k", T.lookup_key("k").alias("kk")).collect())


def test_first_per_key(spark):
    df = spark.createDataFrame([(["B x", "b X", "", "A"],)], "v array<string>")
    assert df.select(T.first_per_key(F.col("v"), T.ascii_key).alias("r")).first()["r"] == ["B x", "A"]
