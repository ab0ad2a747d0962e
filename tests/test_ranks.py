"""Ranks and quantiles against numpy, with many small ranges, ties, nulls and a value that most rows have."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrid.operators import entities as E
from citegrid.operators import ranks
from citegrid.sources import sinks as K


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranks(spark, many_ranges):
    rng = random.Random(1)
    rows = [(f"n{i:03}", rng.choice((None, 5, 5, 5, rng.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "n string, v long").repartition(5)
    got = {r.n: r["rank"] for r in ranks.competition_ranks(df, "v").collect()}
    key = lambda v: -1 if v is None else v
    assert got == {n: 1 + sum(key(w) > key(v) for _, w in rows) for n, v in rows}
    place = ranks.positions(df, F.desc_nulls_last("v"), F.asc("n")).collect()
    want = sorted(rows, key=lambda r: (-key(r[1]), r[0]))
    assert [(r.n, r.v) for r in sorted(place, key=lambda r: r.position)] == want
    assert sorted(r.position for r in place) == list(range(1, 301))
    plan = E.competition_rank(df, "v", "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_quantiles(spark, many_ranges):
    rng = random.Random(2)
    values = {"hot": [rng.choice((1.0, 1.0, 1.0, rng.random())) for _ in range(2000)], None: [2.0, 3.0], "one": [7.0], "mixed": [rng.gauss(0, 1e6) for _ in range(333)], "none": []}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r for r in ranks.group_stats(df, ["g"], "v", shares).collect()}
    assert set(got) == {"hot", None, "one", "mixed"}
    for g, r in got.items():
        vs = values[g]
        assert (r.n, r.least, r.most) == (len(vs), min(vs), max(vs))
        assert r["mean"] == pytest.approx(np.mean(vs))
        assert r.deviation == (pytest.approx(np.std(vs, ddof=1)) if len(vs) > 1 else None)
        assert [r[f"q_{i}"] for i in range(len(shares))] == pytest.approx([float(np.quantile(vs, s)) for s in shares])
    d = {r.g: r for r in E.distribution(df, ["g"], "v", "x").collect()}
    assert (d["none"].x_n, d["none"].x_median, d["one"].x_deviation, d[None].x_q3) == (0, 0, 0, 2.75)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9, 10])
def test_columns_of_ranked_lines(spark, n):
    t = spark.createDataFrame([(i + 1, f"l{i:02}", 10 * i) for i in range(n)], "rank int, label string, v long")
    got = [r["column"] for r in sorted(K.ranked_lines(t, "v", "label").collect(), key=lambda r: r["rank"])]
    assert got == [i for i, part in enumerate(np.array_split(np.arange(n), 4)) for _ in part]
