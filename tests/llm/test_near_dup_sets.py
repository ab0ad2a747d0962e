"""How near-duplicates gets the sets that it verifies: without an exchange of texts, and without leaving them behind."""

import collections
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrid.llm import near_dup
from citegrid.llm.shared import cut, shared_dir, uncut


@pytest.mark.parametrize("most", [64, 1 << 27])
def test_sets_of_wanted_documents_come_without_an_exchange(spark, docs, corpus, monkeypatch, most):
    """The least table lets others pass, but loses none."""
    monkeypatch.setattr(near_dup, "MOST_BITS", most)
    whole = near_dup.signatures(docs, "doc_id", "text").filter("doc_id is not null and n_shingles > 0")
    want = collections.Counter((r.doc_id, r.n_shingles, r.s1, r.s2) for r in whole.filter("doc_id % 3 = 0").collect())
    wanted = cut(whole.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("node")).distinct(), "wanted")
    plain = cut(docs, "plain")
    sets = near_dup._sets(plain, wanted, "doc_id", "text", near_dup.WIDTH)
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    found = collections.Counter()
    for r in sets.collect():
        grams = np.frombuffer(r.grams, np.uint64)
        one, two = near_dup.set_hashes(grams, np.array([len(grams)]))
        found[r.node, len(grams), int(one[0]), int(two[0])] += 1
    assert want and all(found[k] == n for k, n in want.items())
    everything = {(r.doc_id, r.n_shingles, r.s1, r.s2) for r in whole.collect()}
    assert set(found) <= everything
    if most > 64:
        assert len(found) < len(everything) // 2


@pytest.mark.parametrize("size", [4, near_dup.SLICE])
def test_intermediate_tables_go_before_the_result_is_read(spark, docs, size):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    out = near_dup.near_duplicates(docs, size=size)
    left = {p.name.split("-")[0] for p in folder.iterdir() if p.name not in before}
    assert not left & {"sets", "regions", "pairs", "open", "grams", "times", "rare", "about"}
    assert out.count() == docs.count()


def test_uncut_deletes_one_table_only(spark):
    a, b = cut(spark.range(5), "one"), cut(spark.range(7), "two")
    uncut(a)
    assert b.count() == 7
    assert not [p for p in Path(shared_dir(spark).removeprefix("file://")).iterdir() if p.name.startswith("one-")]


def test_a_task_sends_what_it_found_by_rows():
    """Wide cells: what a task holds follows the rows found, not the number of cells, and no cell's rows are lost or parted."""
    n, cells = 256, 600
    sig = np.arange(near_dup.VALUES, dtype=np.uint32)[None, :].repeat(n, 0)
    rows = ((np.arange(c * n, (c + 1) * n), np.arange(c * n, (c + 1) * n), sig, 0, n) for c in range(cells))
    got = list(near_dup._open_rows(rows, 7 << 40))
    assert len(got) > 1 and max(len(b) for b in got) <= near_dup.SENT + n
    whole = [np.concatenate([np.asarray(b.column(k)) for b in got]) for k in range(3)]
    assert whole[1].tolist() == whole[2].tolist() == list(range(cells * n))
    assert whole[0].tolist() == [(7 << 40) + 1 + c for c in range(cells) for _ in range(n)]
