"""Shortest-path measures of weighted graphs: each task follows the paths from its own sources.

A link is as long as its weight is small. The links go to all tasks as arrays of numbers with the names beside them, behind a check
of their number (MOST_LINKS: some 50 MB and the names); the sources are dealt over the tasks, and what they find is summed.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.operators.lineage import checkpointed

MOST_LINKS = 1 << 20
#: A task has this many sources at least.
SOURCES = 64


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "shared", "weight").union(e.select(F.col("dst"), F.col("src"), "shared", "weight"))


class Links:
    """Neighbours and lengths of links by node number."""

    def __init__(self, a: np.ndarray, b: np.ndarray, length: np.ndarray, n: int):
        order = np.lexsort((b, a))
        self.start = np.searchsorted(a[order], np.arange(n + 1))
        self.to, self.length = b[order], length[order]

    def around(self, v: int) -> list[tuple[int, float]]:
        part = slice(self.start[v], self.start[v + 1])
        return list(zip(self.to[part].tolist(), self.length[part].tolist(), strict=True))

    def distances(self, s: int) -> dict[int, float]:
        far, open_ = {s: 0.0}, [(0.0, s)]
        while open_:
            d, v = heapq.heappop(open_)
            if d == far[v]:
                for w, length in self.around(v):
                    if d + length < far.get(w, math.inf):
                        far[w] = d + length
                        heapq.heappush(open_, (far[w], w))
        return far

    def leaning(self, far: dict[int, float]) -> dict[int, float]:
        """For each node that is reached, the shares of shortest paths from the source to all others that pass through it.

        Paths are counted from near to far, over the links that bridge the distance between their ends up to rounding, and
        the shares handed back from far to near.
        """
        order = sorted(far, key=lambda v: (far[v], v))
        before: dict[int, list[int]] = {order[0]: []}
        number = {order[0]: 1.0}
        for w in order[1:]:
            before[w] = [v for v, length in self.around(w) if far[v] < far[w] and math.isclose(far[v] + length, far[w], rel_tol=1e-12)]
            number[w] = sum(number[v] for v in before[w])
        lean = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                lean[v] += number[v] / number[w] * (1 + lean[w])
        del lean[order[0]]
        return lean


def centralities(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, betweenness, closeness, reached, total, furthest, least for the linked entities of a graph of `nodes`.

    reached: entities on paths from this one, itself included; total, furthest: sum and largest of the distances; least: the
    first name among them, which names the component. More than MOST_LINKS links are an error.
    """
    spark = e.sparkSession
    links, n = checkpointed(e.select("src", "dst", "weight")), nodes.select("entity").distinct().count()
    if links.count() > MOST_LINKS:
        raise ValueError(f"shortest paths over more than {MOST_LINKS} links")
    rows = links.select("src", "dst", F.when(F.col("weight") > 0, 1.0 / F.col("weight")).otherwise(1.0).alias("length")).toPandas()
    ends, names = pd.factorize(np.concatenate([rows["src"].to_numpy(object), rows["dst"].to_numpy(object)]), sort=True)
    a, b = ends[: len(rows)], ends[len(rows) :]
    graph = Links(np.concatenate([a, b]), np.concatenate([b, a]), np.tile(rows["length"].to_numpy(float), 2), len(names))
    sent = spark.sparkContext.broadcast((graph, names))

    def run(batches):
        (graph, names), through = sent.value, {}
        for pdf in batches:
            out = []
            for s in pdf["id"].tolist():
                far = graph.distances(s)
                for v, share in graph.leaning(far).items():
                    if share:
                        through[v] = through.get(v, 0.0) + share
                out.append((names[s], None, len(far), sum(far.values()), max(far.values()), names[min(far)]))
            if out:
                yield pd.DataFrame(out, columns=["entity", "through", "reached", "total", "furthest", "least"])
        if through:
            yield pd.DataFrame({"entity": [names[v] for v in through], "through": list(through.values()), "reached": None, "total": None, "furthest": None, "least": None})

    parts = max(1, min(len(names) // SOURCES, spark.sparkContext.defaultParallelism * 4))
    found = spark.range(0, len(names), 1, parts).mapInPandas(run, "entity string, through double, reached bigint, total double, furthest double, least string")
    per = found.groupBy("entity").agg(F.coalesce(F.sum("through"), F.lit(0.0)).alias("through"), *(F.max(c).alias(c) for c in ("reached", "total", "furthest", "least")))
    others = F.col("reached") - 1
    # sums come in no fixed order: their last digits are cut
    between = F.round(F.col("through") / F.lit(float(max((n - 1) * (n - 2), 1))), 12)
    close = F.when(F.col("total") > 0, others / F.col("total") * others / F.lit(float(max(n - 1, 1)))).otherwise(0.0)
    return per.select("entity", between.alias("betweenness"), close.alias("closeness"), "reached", "total", "furthest", "least")


def component_paths(found: DataFrame) -> DataFrame:
    """One row: mean_path, diameter of the largest component, by what centralities gave; zeros without links."""
    per = found.groupBy("least").agg(F.max("reached").alias("k"), F.sum("total").alias("total"), F.max("furthest").alias("furthest"))
    first = per.agg(F.min_by(F.struct("k", "total", "furthest"), F.struct((-F.col("k")).alias("less"), "least")).alias("c"))
    return first.select(F.coalesce(F.try_divide("c.total", (F.col("c.k") * (F.col("c.k") - 1)).cast("double")), F.lit(0.0)).alias("mean_path"), F.coalesce("c.furthest", F.lit(0.0)).alias("diameter"))
