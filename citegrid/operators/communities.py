"""Communities by growing modularity, on graphs of any size.

A graph of more than MOST_NODES linked nodes is contracted by rounds over its link table: groups are dealt anew in each round into
those that nodes may leave and those that they may enter, and the best state of a level is contracted. What is left, at most
MOST_NODES groups, is finished in one task by moves in order of name. A larger rest that no round improves stays as it is.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.operators.lineage import checkpointed
from citegrid.operators.paths import both_ways
from citegrid.operators.ranks import positions

MOST_NODES = 2000
#: Rounds of a level: each node gets its turn in about a quarter of them.
ROUNDS = 16


def _modularity(links: DataFrame, state: DataFrame) -> float:
    a, b = state.select(F.col("node").alias("a"), F.col("grp").alias("ga")), state.select(F.col("node").alias("b"), F.col("grp").alias("gb"))
    per = links.join(a, "a").join(b, "b").groupBy("ga").agg(F.sum(F.when(F.col("ga") == F.col("gb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    row = per.agg(F.sum("inside").alias("i"), F.sum("total").alias("t"), F.sum(F.col("total") * F.col("total")).alias("s")).first()
    return row.i / row.t - row.s / row.t**2


def _round(links: DataFrame, state: DataFrame, all_: float, k: int) -> DataFrame:
    """node, strength, grp, moved after the moves of round k."""
    enters = lambda g: F.pmod(F.xxhash64(F.col(g), F.lit(k)), F.lit(2)) == 0
    totals = state.groupBy("grp").agg(F.sum("strength").alias("total"))
    near = links.filter("a != b").join(state.select(F.col("node").alias("b"), F.col("grp").alias("target")), "b").groupBy(F.col("a").alias("node"), "target").agg(F.sum("weight").alias("w"))
    leaving = state.filter(~enters("grp")).join(totals, "grp")
    own = leaving.join(near.withColumnRenamed("target", "grp"), ["node", "grp"], "left")
    own = own.select("node", "strength", (F.coalesce("w", F.lit(0.0)) - (F.col("total") - F.col("strength")) * F.col("strength") / all_).alias("stay"))
    open_ = near.filter(enters("target")).join(own, "node").join(totals.withColumnRenamed("grp", "target"), "target")
    gain = F.col("w") - F.col("total") * F.col("strength") / all_
    to = open_.withColumn("gain", gain).filter(F.col("gain") > F.col("stay") + 1e-12).groupBy("node").agg(F.min_by("target", F.struct((-F.col("gain")).alias("less"), "target")).alias("to"))
    return state.join(to, "node", "left").select("node", "strength", F.coalesce("to", "grp").alias("grp"), F.col("to").isNotNull().alias("moved"))


def _level(links: DataFrame) -> DataFrame | None:
    """node, grp of the best state of a level; None where no state is better than the nodes by themselves."""
    state = checkpointed(links.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("strength")).withColumn("grp", F.col("node")))
    all_ = float(state.agg(F.sum("strength")).first()[0])
    best, most, idle = None, _modularity(links, state) if all_ else 0.0, 0
    for k in range(ROUNDS if all_ else 0):
        new = checkpointed(_round(links, state, all_, k))
        idle = 0 if not new.filter("moved").isEmpty() else idle + 1
        state = new.drop("moved")
        if not idle and (now := _modularity(links, state)) > most + 1e-9:
            best, most = state, now
        if idle == 4:
            break
    return None if best is None else best.select("node", "grp")


def _finish(rows: list[tuple[str, str, float]]) -> dict[str, str]:
    """Groups of a small graph: moves in order of name while modularity grows, then the same on the graph of groups."""
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in sorted(rows):
        near[a][b] = near[a].get(b, 0.0) + w
    where_all = {v: v for v in near}
    all_ = sum(w for x in near.values() for w in x.values())
    while all_:
        strength = {v: sum(x.values()) for v, x in near.items()}
        where, total, moved = {v: v for v in near}, dict(strength), False
        for _ in range(100):
            again = False
            for v in sorted(near):
                links: dict[str, float] = defaultdict(float)
                for w, weight in near[v].items():
                    if w != v:
                        links[where[w]] += weight
                old = where[v]
                total[old] -= strength[v]
                gain = {g: links.get(g, 0.0) - total[g] * strength[v] / all_ for g in {*links, old}}
                better = [g for g in gain if gain[g] > gain[old] + 1e-12]
                new = min(better, key=lambda g: (-gain[g], g)) if better else old  # noqa: B023
                total[new] += strength[v]
                if new != old:
                    where[v], again, moved = new, True, True
            if not again:
                break
        if not moved:
            break
        where_all = {v: where[g] for v, g in where_all.items()}
        small: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for v, x in near.items():
            for w, weight in x.items():
                small[where[v]][where[w]] += weight
        near = {v: dict(x) for v, x in small.items()}
    return where_all


def _finished(links: DataFrame) -> DataFrame:
    """node, grp; links are of at most MOST_NODES nodes."""

    def run(batches):
        for pdf in batches:
            for rows in pdf["rows"]:
                found = _finish([(r["a"], r["b"], r["weight"]) for r in rows])
                if found:
                    yield pd.DataFrame({"node": list(found), "grp": list(found.values())})

    return links.agg(F.collect_list(F.struct("a", "b", "weight")).alias("rows")).mapInPandas(run, "node string, grp string")


def communities(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, community, community_size for every entity of nodes: numbered by size, inner weight and least name.

    An entity without links is a community of its own, and so is each entity where links have no weight.
    """
    links = checkpointed(both_ways(e).select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))
    member = None
    while True:
        small = links.select("a").distinct().limit(MOST_NODES + 1).count() <= MOST_NODES
        moved = _finished(links) if small else _level(links)
        if moved is None:
            break
        moved = checkpointed(moved)
        member = moved if member is None else checkpointed(member.join(moved.select(F.col("node").alias("grp"), F.col("grp").alias("to")), "grp").select("node", F.col("to").alias("grp")))
        if small:
            break
        a, b = moved.select(F.col("node").alias("a"), F.col("grp").alias("ga")), moved.select(F.col("node").alias("b"), F.col("grp").alias("gb"))
        links = checkpointed(links.join(a, "a").join(b, "b").groupBy(F.col("ga").alias("a"), F.col("gb").alias("b")).agg(F.sum("weight").alias("weight")))
    all_ = nodes.select("entity").distinct()
    named = all_.select("entity", F.col("entity").alias("grp")) if member is None else all_.join(member.withColumnRenamed("node", "entity"), "entity", "left")
    # a group is named by its least entity
    least = named.filter("grp is not null").groupBy("grp").agg(F.min("entity").alias("least"))
    own = checkpointed(named.join(least, "grp", "left").select("entity", F.coalesce("least", "entity").alias("least")))
    left, right = own.select(F.col("entity").alias("src"), F.col("least").alias("l1")), own.select(F.col("entity").alias("dst"), F.col("least").alias("l2"))
    inner = e.join(left, "src").join(right, "dst").filter("l1 = l2").groupBy(F.col("l1").alias("least")).agg(F.round(F.sum("weight"), 9).alias("inner"))
    groups = own.groupBy("least").agg(F.count(F.lit(1)).alias("community_size")).join(inner, "least", "left").withColumn("inner", F.coalesce("inner", F.lit(0.0)))
    ranked = positions(groups, F.desc("community_size"), F.desc("inner"), F.asc("least"), name="community")
    return own.join(ranked, "least").select("entity", F.col("community").cast("bigint").alias("community"), "community_size")
