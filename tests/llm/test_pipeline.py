"""The pipeline's stages on a small corpus: what goes, what stays, and the columns in between."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    documents = docs.select("doc_id", "text", "lang", "source").filter("doc_id is not null").dropDuplicates(["doc_id"])
    documents = documents.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")
    documents.write.parquet(f"{folder}/documents.parquet")
    first = documents.filter("doc_id = 19").first().text.split("\n")
    spark.createDataFrame([(1, first[0] + "\n" + first[1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == documents.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
    n = documents.count()
    assert len(seen["quality classifier"]) == len(seen["line dedup"]) == n
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"].values() if r.text is not None)
    assert len(seen["near-duplicates"]) < n
    assert 19 in seen["near-duplicates"] and 19 not in seen["benchmark decontamination"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(seen["benchmark decontamination"])
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_with_nulls_repeats_and_labels(spark, corpus, tmp_path):
    """Null ids and texts, repeated rows and ids, a long text, clashing names, labels that reject some."""
    folder = str(tmp_path)
    rows = [(i, t, lang, source, None if t is None else len(t), 1, 2, 3) for i, t, lang, source in corpus]
    rows += [(300 + k, " ".join(f"{w}###" for w in corpus[k][1].split(" ")), "en", "s1", 1, 1, 2, 3) for k in range(40)] + rows[:2]
    rows += [(800, "lo ka " * 100_000, "en", "s1", 600_000, 1, 2, 3)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __gone int, removed_spans int, gone_id int")
    documents.repartition(3).write.parquet(f"{folder}/documents.parquet")
    first = corpus[9][1].split("\n")
    spark.createDataFrame([(1, first[0] + "\n" + first[1]), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], 1, 0) for r in corpus[:60]] + [(300 + k, 0, 0) for k in range(30)] + [(None, 0, 1), (300, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == documents.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        ids.append([r.doc_id for r in now.select("doc_id").collect()])
        assert ids[-1].count(None) == 2
    assert not set(range(300, 340)) & set(ids[0]) and sum(i is not None and i < 120 for i in ids[0]) > 55
    assert len(ids[1]) == len(ids[0]) and len(ids[2]) < len(ids[1])
    assert corpus[9][0] in ids[2] and corpus[9][0] not in ids[3]
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).select("doc_id").distinct().count() == len(set(ids[3]))
    for stage in ("labels", "benchmark"):
        none = spark.read.parquet(f"{folder}/{stage}.parquet").limit(0)
        none.write.mode("overwrite").parquet(f"{folder}/none/{stage}.parquet")
    documents.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
