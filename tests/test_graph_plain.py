"""Graph measures, forests and communities against plain versions on small random graphs."""

import itertools
import math
import random

import pytest

from citegrid.operators import communities as C
from citegrid.operators import graph as G
from citegrid.operators import paths as P

EDGE = "src string, dst string, shared long, weight double"


def random_graph(seed, n, links, weights=(0.25, 1 / 3, 0.5, 1.0, 2.0)):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(n)]
    pairs = rng.sample(list(itertools.combinations(names[: n - 2], 2)), links)  # two nodes without links
    return [(a, b, rng.randint(1, 3), rng.choice(weights)) for a, b in pairs], names


def frames(spark, rows, names):
    return spark.createDataFrame(rows, EDGE), spark.createDataFrame([(x,) for x in names], "entity string")


def all_distances(rows, names):
    """Distances by relaxing every link until none changes, and numbers of shortest paths by the links that bridge them."""
    far = {(a, b): 0.0 if a == b else math.inf for a in names for b in names}
    near = {}
    for a, b, _, w in rows:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1 / w
    for s in names:
        moved = True
        while moved:
            moved = False
            for a, around in near.items():
                for b, length in around.items():
                    if far[s, a] + length < far[s, b] - 1e-12:
                        far[s, b], moved = far[s, a] + length, True
    paths = {}

    def count(s, t):
        if s == t:
            return 1
        if (s, t) not in paths:
            paths[s, t] = sum(count(s, v) for v, length in near.get(t, {}).items() if math.isclose(far[s, v] + length, far[s, t]))
        return paths[s, t]

    return far, count, near


@pytest.mark.parametrize("seed,links", [(1, 9), (3, 40)])
def test_measures_against_plain(spark, seed, links):
    rows, names = random_graph(seed, 14, links)
    far, count, near = all_distances(rows, names)
    n = len(names)
    e, nodes = frames(spark, rows, names)
    got = {r.entity: r for r in G.node_measures(e, nodes).collect()}
    assert sorted(got) == names
    top = max(w for *_, w in rows)
    weight = {frozenset((a, b)): w for a, b, _, w in rows}
    all_clustering = 0.0
    for v in names:
        through = sum(count(s, v) * count(v, t) / count(s, t) for s in names for t in names if v not in (s, t) and s != t and far[s, t] < math.inf and math.isclose(far[s, v] + far[v, t], far[s, t]))
        assert got[v].betweenness == pytest.approx(through / ((n - 1) * (n - 2)), abs=1e-9)
        reached = [far[v, t] for t in names if t != v and far[v, t] < math.inf]
        assert got[v].closeness == pytest.approx(len(reached) / sum(reached) * len(reached) / (n - 1) if reached else 0.0)
        corners = [(frozenset((v, a)), frozenset((v, b)), frozenset((a, b))) for a, b in itertools.combinations(sorted(near.get(v, {})), 2)]
        k = len(corners)
        mine = sum(math.prod(weight[x] / top for x in c) ** (1 / 3) for c in corners if c[2] in weight) / k if k else 0.0
        assert got[v].clustering == pytest.approx(mine)
        all_clustering += mine
    parts = sorted({frozenset(t for t in names if far[v, t] < math.inf) for v in names}, key=lambda p: (-len(p), min(p)))
    big = sorted(parts[0])
    m = G.graph_measures(e, nodes).first()
    inside = [far[a, b] for a in big for b in big if a != b]
    assert (m.mean_path, m.diameter) == (pytest.approx(sum(inside) / len(inside)), pytest.approx(max(inside)))
    assert m.mean_clustering == pytest.approx(all_clustering / n)
    ends = [(len(near[a]), len(near[b])) for a in near for b in near[a]]
    mx = sum(a for a, _ in ends) / len(ends)
    spread = sum((a - mx) ** 2 for a, _ in ends)
    assert m.assortativity == pytest.approx(sum((a - mx) * (b - mx) for a, b in ends) / spread if spread else 0.0)
    group = {v: got[v].community for v in names}
    assert m.modularity == pytest.approx(modularity(rows, group))
    assert (m.communities, m.communities_of_two) == (len(set(group.values())), sum(list(group.values()).count(c) > 1 for c in set(group.values())))


def modularity(rows, group):
    total = 2 * sum(w for *_, w in rows)
    degree = {}
    for a, b, _, w in rows:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    per = {}
    for v, d in degree.items():
        per[group[v]] = per.get(group[v], 0) + d
    return sum(2 * w for a, b, _, w in rows if group[a] == group[b]) / total - sum((d / total) ** 2 for d in per.values())


@pytest.mark.parametrize("seed", range(2))
def test_forest_against_plain(spark, seed):
    rows, names = random_graph(seed, 24, 90, (0.5, 1.0))
    tree, where = set(), {x: x for x in names}
    for a, b, _, _ in sorted(rows, key=lambda r: (-r[3], r[0], r[1])):
        if where[a] != where[b]:
            tree.add((a, b))
            old, new = where[a], where[b]
            where = {x: new if g == old else g for x, g in where.items()}
    e, nodes = frames(spark, rows, names)
    assert sorted((r.src, r.dst) for r in G.spanning_forest(e).collect()) == sorted(tree)
    assert {(r.src, r.dst) for r in G.backbone(e, nodes, 1).collect()} == {(a, b) for a, b, *_ in rows}  # few links: all
    full = [(a, b, 1, 1.0 + (i % 7) / 7) for i, (a, b) in enumerate(itertools.combinations(names, 2))]
    shown = {(r.src, r.dst) for r in G.backbone(*frames(spark, full, names), 1).collect()}
    assert len(names) - 1 <= len(shown) <= 2 * len(names)


def cliques(n, size):
    rows = [(f"c{i:02}_{a}", f"c{i:02}_{b}", 1, 1.0) for i in range(n) for a, b in itertools.combinations(range(size), 2)]
    return rows + [tuple(sorted((f"c{i:02}_0", f"c{(i + 1) % n:02}_1"))) + (1, 0.1) for i in range(n)]


@pytest.mark.parametrize("most", [2000, 20, 3])
def test_communities_of_any_size(spark, monkeypatch, most):
    """In one task, contracted first, and by rounds alone: planted groups are found."""
    monkeypatch.setattr(C, "MOST_NODES", most)
    rows = cliques(8, 6)
    names = sorted({x for r in rows for x in r[:2]} | {"alone"})
    got = {r.entity: r for r in C.communities(*frames(spark, rows, names)).collect()}
    assert sorted(got) == names
    groups = {}
    for x, r in got.items():
        groups.setdefault(r.community, set()).add(x)
        assert r.community_size == sum(q.community == r.community for q in got.values())
    assert {"alone"} in groups.values()
    assert modularity(rows, {x: r.community for x, r in got.items()}) > 0.8
    for i in range(8):  # no clique is cut
        assert len({got[f"c{i:02}_{a}"].community for a in range(6)}) == 1
    assert len(groups[1]) == max(map(len, groups.values()))


def test_empty_graph(spark, monkeypatch):
    e, nodes = frames(spark, [], ["a", "b"])
    assert [(r.entity, r.betweenness, r.community) for r in G.node_measures(e, nodes).orderBy("entity").collect()] == [("a", 0.0, 1), ("b", 0.0, 2)]
    m = G.graph_measures(e, nodes).first()
    assert (m.mean_path, m.diameter, m.mean_clustering, m.assortativity, m.communities, m.modularity) == (0.0, 0.0, 0.0, 0.0, 2, 0.0)
    assert G.spanning_forest(e).count() == 0
    monkeypatch.setattr(P, "MOST_LINKS", 0)
    with pytest.raises(ValueError):
        P.centralities(*frames(spark, [("a", "b", 1, 1.0)], ["a", "b"]))
