"""Collaboration graphs: edges, strengths, components, backbone, measures.

All of it are DataFrame operations over the edge table, of any number of nodes. Shortest paths are in `paths`, where each
task follows those of its own sources, communities in `communities`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.operators.communities import communities
from citegrid.operators.entities import distinct_entities
from citegrid.operators.lineage import checkpointed
from citegrid.operators.paths import both_ways, centralities, component_paths
from citegrid.operators.ranks import positions


def edges(papers: DataFrame, paper_id: str, entities: str, allowed: DataFrame | None = None) -> DataFrame:
    """src, dst, shared, weight (src < dst).

    Each row adds 1 to the shared count and 1 / max(n - 1, 1) to the weight of every pair of its entities that are allowed;
    n counts all entities of the row. allowed: one column `entity`.
    """
    rows = papers.select(paper_id, distinct_entities(F.col(entities)).alias("es")).filter(F.size("es") > 0).select(paper_id, F.greatest(F.size("es") - 1, F.lit(1)).alias("m"), F.explode("es").alias("entity"))
    if allowed is not None:
        rows = rows.join(allowed.select("entity").distinct(), "entity", "left_semi")
    # pairs come from the row's own list, one entity at a time with those after it, so no task holds a row's pairs at once
    lists = rows.groupBy(paper_id, "m").agg(F.sort_array(F.collect_list("entity")).alias("es")).filter(F.size("es") > 1)
    each = lists.select("m", "es", F.posexplode("es").alias("i", "src"))
    one = each.select("src", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("dst"), (1.0 / F.col("m")).alias("w"))
    return one.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"), F.sum("w").alias("weight"))


def node_strength(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, collaborators, link_strength, fractional_strength, degree_centrality; isolated nodes have zeros."""
    sums = both_ways(e).groupBy(F.col("src").alias("entity")).agg(F.count(F.lit(1)).alias("collaborators"), F.sum("shared").alias("link_strength"), F.sum("weight").alias("fractional_strength"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    joined = nodes.join(sums, "entity", "left").join(F.broadcast(n), how="cross")  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("entity", zero("collaborators"), zero("link_strength"), F.coalesce("fractional_strength", F.lit(0.0)).alias("fractional_strength"), F.coalesce(F.try_divide(F.coalesce("collaborators", F.lit(0)).cast("double"), F.nullif(F.col("n") - 1, F.lit(0))), F.lit(0.0)).alias("degree_centrality"))


def weighted_triangles(e: DataFrame) -> DataFrame:
    """a, b, c with a < b < c, all three linked, and the weights ab, bc, ac."""
    x, y, z = (e.select("src", "dst", "weight").alias(n) for n in "xyz")
    two = x.join(y, F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"), F.col("x.weight").alias("ab"), F.col("y.weight").alias("bc"))
    return two.join(z, (F.col("a") == F.col("z.src")) & (F.col("c") == F.col("z.dst"))).select("a", "b", "c", "ab", "bc", F.col("z.weight").alias("ac"))


def triangles(e: DataFrame) -> DataFrame:
    """a, b, c with a < b < c, all three linked."""
    return weighted_triangles(e).select("a", "b", "c")


def density(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges, isolates, density, triangles, transitivity in one row."""
    deg = both_ways(e).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    parts = [
        nodes.agg(F.count(F.lit(1)).alias("nodes")),
        e.agg(F.count(F.lit(1)).alias("edges")),
        deg.agg(F.count(F.lit(1)).alias("linked"), F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("triads")),
        triangles(e).agg(F.count(F.lit(1)).alias("triangles")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(F.broadcast(p), how="cross")  # one row each
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return row.select("nodes", "edges", (F.col("nodes") - F.col("linked")).alias("isolates"), F.coalesce(F.try_divide(2.0 * F.col("edges"), F.nullif(pairs, F.lit(0))), F.lit(0.0)).alias("density"), "triangles", F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.nullif(F.col("triads"), F.lit(0.0))), F.lit(0.0)).alias("transitivity"))


def labels_of(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, label: the least name that can be reached. Labels jump to their label's label, until none moves."""
    both = checkpointed(both_ways(e).select(F.col("src").alias("entity"), "dst"))
    labels = checkpointed(nodes.select("entity", F.col("entity").alias("label")))
    while True:
        near = both.join(labels.select(F.col("entity").alias("dst"), "label"), "dst").groupBy("entity").agg(F.min("label").alias("m"))
        moved = labels.join(near, "entity", "left").select("entity", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("l"))
        jump = labels.select(F.col("entity").alias("l"), F.col("label").alias("far"))
        new = checkpointed(moved.join(jump, "l").select("entity", "old", F.least("l", "far").alias("label")))
        labels = new.select("entity", "label")
        if not new.filter("label != old").limit(1).count():
            return labels


def components(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity, component, component_size: numbered by size, then by least name. Only one row per component is numbered."""
    labels = labels_of(e, nodes)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("component_size"))
    numbered = positions(sizes, F.desc("component_size"), F.asc("label"), name="component")
    return labels.join(numbered, "label").select("entity", "component", "component_size")


def pagerank(e: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """entity, pagerank by power iteration over weighted edges; nodes without edges spread their rank evenly."""
    nodes = checkpointed(nodes.select("entity"))
    links = checkpointed(both_ways(e).select("src", "dst", "weight"))
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    share = checkpointed(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    n = nodes.count()
    if not n:
        return nodes.select("entity", F.lit(None).cast("double").alias("pagerank"))
    lone = nodes.join(out.select(F.col("src").alias("entity")), "entity", "left_anti").count()
    ranks = nodes.select("entity", F.lit(1.0 / n).alias("r"))
    if lone:
        loose = nodes.join(out.select(F.col("src").alias("entity")), "entity", "left_anti").withColumn("loose", F.lit(True))
        nodes = nodes.join(loose, "entity", "left").select("entity", F.coalesce("loose", F.lit(False)).alias("loose"))
    for k in range(rounds):
        got = share.join(ranks.select(F.col("entity").alias("src"), "r"), "src").groupBy(F.col("dst").alias("entity")).agg(F.sum(F.col("p") * F.col("r")).alias("g"))
        new = nodes.join(got, "entity", "left")
        spread = F.lit(0.0)
        if lone:
            total = ranks.join(nodes.filter("loose").select("entity"), "entity", "left_semi").agg(F.sum("r").alias("s"))
            new, spread = new.join(F.broadcast(total), how="cross"), F.coalesce("s", F.lit(0.0)) / n  # one row
        ranks = new.select("entity", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + spread)).alias("r"))
        if k % 5 == 4:
            ranks = checkpointed(ranks)
    return ranks.select("entity", F.col("r").alias("pagerank"))


def spanning_forest(e: DataFrame) -> DataFrame:
    """src, dst of the maximum spanning forest; of links of one weight the least names go first, so there is one forest.

    In each round every tree takes its heaviest link to another one, which at least halves the trees that have any; links
    inside a tree are dropped.
    """
    links = checkpointed(e.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")))
    taken = links.select("src", "dst").limit(0)
    while True:
        first = F.struct((-F.col("weight")).alias("less"), "src", "dst", "a", "b")
        best = links.select(F.explode(F.array("a", "b")).alias("tree"), first.alias("link")).groupBy("tree").agg(F.min("link").alias("link"))
        best = checkpointed(best.select("link.*").distinct())
        if best.isEmpty():
            return taken
        taken = taken.union(best.select("src", "dst"))
        joins = best.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("shared"), F.lit(1.0).alias("weight"))
        tree = labels_of(joins, joins.select(F.explode(F.array("src", "dst")).alias("entity")).distinct())
        left, right = tree.select(F.col("entity").alias("a"), F.col("label").alias("la")), tree.select(F.col("entity").alias("b"), F.col("label").alias("lb"))
        links = checkpointed(links.join(left, "a").join(right, "b").filter("la != lb").select("src", "dst", "weight", F.col("la").alias("a"), F.col("lb").alias("b")))


def backbone(e: DataFrame, nodes: DataFrame, per_node: int) -> DataFrame:
    """src, dst of what a drawing shows: all edges if they are few, else a maximum spanning forest and the heaviest per node."""
    if e.count() <= max(220, nodes.count() * per_node):
        return e.select("src", "dst")
    order = Window.partitionBy("src").orderBy(F.desc("weight"), F.desc("shared"), F.lower("dst"), "dst")
    heavy = both_ways(e).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_node).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return heavy.union(spanning_forest(e)).distinct()


def clustering(e: DataFrame) -> DataFrame:
    """entity, clustering of the linked entities: the geometric means of the scaled weights of their triangles, by their pairs of
    neighbours."""
    corner = weighted_triangles(e).select(F.explode(F.array("a", "b", "c")).alias("entity"), "ab", "bc", "ac")
    top = e.agg(F.max("weight").alias("top"))  # one row
    scaled = corner.join(F.broadcast(top), how="cross").groupBy("entity").agg(F.sum(F.cbrt(F.col("ab") / F.col("top") * F.col("bc") / F.col("top") * F.col("ac") / F.col("top"))).alias("t"))
    degrees = both_ways(e).groupBy(F.col("src").alias("entity")).agg(F.count(F.lit(1)).alias("d"))
    return degrees.join(scaled, "entity", "left").select("entity", F.coalesce(F.try_divide(2 * F.col("t"), F.nullif(F.col("d") * (F.col("d") - 1), F.lit(0))), F.lit(0.0)).alias("clustering"))


def assortativity(e: DataFrame) -> DataFrame:
    """One row: the correlation of the degrees at both ends of a link; 0 where they do not vary."""
    d = both_ways(e).groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("d"))
    ends = both_ways(e).select("src", "dst").join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    return ends.agg(F.when(F.min("d") < F.max("d"), F.corr("d", "d2")).otherwise(0.0).alias("assortativity"))


def modularity(e: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: modularity of the groups in membership (entity, community); 0 without links."""
    a = membership.select(F.col("entity").alias("src"), F.col("community").alias("c1"))
    b = membership.select(F.col("entity").alias("dst"), F.col("community").alias("c2"))
    per = both_ways(e).join(a, "src").join(b, "dst").groupBy("c1").agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    all_ = F.nullif(F.sum("total"), F.lit(0.0))
    return per.agg(F.coalesce(F.sum("inside") / all_ - F.sum(F.col("total") * F.col("total")) / (all_ * all_), F.lit(0.0)).alias("modularity"))


def node_measures(e: DataFrame, nodes: DataFrame, found: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """entity, betweenness, closeness, clustering, community, community_size; entities without links have zeros.

    found, groups: what `paths.centralities` and `communities.communities` gave for the same graph, if both are there already.
    """
    if found is None or groups is None:
        e, nodes = checkpointed(e), checkpointed(nodes)  # each measure reads them
        found, groups = centralities(e, nodes), communities(e, nodes)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return groups.join(found, "entity", "left").join(clustering(e), "entity", "left").select("entity", zero("betweenness"), zero("closeness"), zero("clustering"), "community", "community_size")


def graph_measures(e: DataFrame, nodes: DataFrame, found: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """One row: mean shortest path and diameter of the largest component, mean clustering, assortativity, communities, modularity.

    Of components of equal size the one with the least name counts. found, groups: as for node_measures.
    """
    if found is None or groups is None:
        e, nodes = checkpointed(e), checkpointed(nodes)  # each measure reads them
        found, groups = centralities(e, nodes), communities(e, nodes)
    n = nodes.agg(F.countDistinct("entity").alias("n"))
    sizes = groups.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    parts = [
        component_paths(found),
        clustering(e).agg(F.coalesce(F.sum("clustering"), F.lit(0.0)).alias("all_clustering")),
        assortativity(e),
        sizes.agg(F.count(F.lit(1)).alias("communities"), F.count_if(F.col("size") > 1).alias("communities_of_two")),
        modularity(e, groups),
    ]
    row = n
    for p in parts:
        row = row.join(F.broadcast(p), how="cross")  # one row each
    mean = F.coalesce(F.try_divide("all_clustering", F.nullif(F.col("n"), F.lit(0))), F.lit(0.0))
    return row.select("mean_path", "diameter", mean.alias("mean_clustering"), "assortativity", "communities", "communities_of_two", "modularity")


def ranked_network(papers: DataFrame, paper_id: str, entities: str, table: DataFrame, label: str, selected: DataFrame, per_node: int) -> dict[str, DataFrame]:
    """ranking, summary and displayed edges of the graph of the selected entities (columns entity, selection_rank)."""
    nodes = selected.select("entity").distinct()
    e, nodes = checkpointed(edges(papers, paper_id, entities, nodes)), checkpointed(nodes)
    comp = components(e, nodes)
    found, groups = checkpointed(centralities(e, nodes)), checkpointed(communities(e, nodes))
    metrics = table.select(F.col(label).alias("entity"), "publications", "citations", "total_rate", "mean_rate")
    rows = selected.join(metrics, "entity", "left").na.fill(0).join(node_strength(e, nodes), "entity").join(node_measures(e, nodes, found, groups), "entity").join(pagerank(e, nodes), "entity").join(comp, "entity")
    order = (F.desc("link_strength"), F.desc("collaborators"), F.desc("betweenness"), F.lower("entity"))
    ranking = positions(rows, *order, name="collaboration_rank").orderBy("collaboration_rank")
    shown = backbone(e, nodes, per_node)
    total = comp.agg(F.countDistinct("component").alias("components"), F.max("component_size").alias("largest_component"))
    summary = density(e, nodes).join(F.broadcast(graph_measures(e, nodes, found, groups)), how="cross").join(F.broadcast(total), how="cross").join(F.broadcast(shown.agg(F.count(F.lit(1)).alias("displayed_edges"))), how="cross")  # one row each
    summary = summary.withColumn("largest_component_share", F.coalesce(F.try_divide(100.0 * F.col("largest_component"), F.nullif(F.col("nodes"), F.lit(0))), F.lit(0.0)))
    return {"ranking": ranking, "summary": summary, "edges": shown}


def drawing(e: DataFrame, ranking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node sizes and edge widths of a drawing, from logarithms of strength and weight relative to the largest."""
    def scaled(table: DataFrame, c: str) -> tuple[DataFrame, Column]:
        most = table.agg(F.max(F.col(c).cast("double")).alias("__most"))  # one row
        share = F.try_divide(F.log1p(F.col(c).cast("double")), F.nullif(F.log1p("__most"), F.lit(0.0)))
        return table.join(F.broadcast(most), how="cross"), F.coalesce(share, F.lit(0.0))

    nodes, strength = scaled(ranking, "link_strength")
    links, weight = scaled(e, "weight")
    return nodes.select("entity", "community", (260.0 + 1500.0 * strength).alias("size")), links.select("src", "dst", (0.35 + 4.2 * weight).alias("width"))


def community_links(e: DataFrame, membership: DataFrame) -> DataFrame:
    """Summed weights between communities."""
    a = membership.select(F.col("entity").alias("src"), F.col("community").alias("c1"))
    b = membership.select(F.col("entity").alias("dst"), F.col("community").alias("c2"))
    return e.join(a, "src").join(b, "dst").filter("c1 != c2").groupBy(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).agg(F.sum("weight").alias("weight"))
