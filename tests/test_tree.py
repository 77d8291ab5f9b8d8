"""Communities, trees, gates and routes on planted graphs, against facts that any right answer has."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import search as S
from quarry.operators import tree as T

PLANTED, SIZE = 6, 10


@pytest.fixture(scope="module")
def planted(spark):
    """Communities of SIZE units in two partitions, some edges between them, two isolated units and an edge across partitions."""
    rnd = random.Random(9)
    units = [(i, i // SIZE % 2) for i in range(PLANTED * SIZE)] + [(9000, 0), (9001, 1)]
    edges = []
    for c in range(PLANTED):
        own = range(c * SIZE, (c + 1) * SIZE)
        edges += [(a, b, round(rnd.uniform(0.5, 1), 3)) for a in own for b in own if a < b and rnd.random() < 0.6]
    for _ in range(40):
        a, b = rnd.sample(range(PLANTED * SIZE), 2)
        if a // SIZE != b // SIZE and a // SIZE % 2 == b // SIZE % 2:
            edges.append((a, b, 0.2))
    edges += [(0, SIZE, 1.0), (3, 3, 1.0), (1, 2, 0.9), (2, 1, 0.9)]
    return spark.createDataFrame(units, "id long, part int"), spark.createDataFrame(edges, "a long, b long, weight double")


@pytest.fixture(scope="module")
def graph(planted):
    units, edges = planted
    nodes = units.withColumn("size", F.lit(1).cast("long"))
    return nodes, T.both_ways(edges, nodes)


@pytest.fixture(scope="module")
def found(graph):
    return T.communities(*graph, capacity=14)


@pytest.fixture(scope="module")
def built(planted):
    return T.build(*planted, leaf=6, children=3)


def groups(labels):
    out: dict = {}
    for r in labels.collect():
        out.setdefault(r.group, set()).add(r.id)
    return out


def modularity(edges, labels):
    """Newman's, plainly."""
    of = {r.id: r[1] for r in labels.collect()}
    rows = [(r.u, r.v, r.weight) for r in edges.collect()]
    total = sum(w for *_, w in rows)
    degree: dict = {}
    for u, _, w in rows:
        degree[of[u]] = degree.get(of[u], 0) + w
    return sum(w for u, v, w in rows if of[u] == of[v]) / total - sum((d / total) ** 2 for d in degree.values())


def test_planted_communities_are_found(found):
    planted = [set(range(c * SIZE, (c + 1) * SIZE)) for c in range(PLANTED)]
    assert sum(any(p == g - {9000, 9001} for g in groups(found).values()) for p in planted) >= PLANTED - 1


def test_no_group_outgrows_its_capacity_or_mixes_partitions(graph, found):
    nodes, edges = graph
    part = {r.id: r.part for r in nodes.collect()}
    for capacity, labels in ((14, found), (5, T.communities(nodes, edges, capacity=5))):
        by = groups(labels)
        assert sorted(i for g in by.values() for i in g) == sorted(part)
        assert all(len(g) <= capacity and len({part[i] for i in g}) == 1 and name == min(g) for name, g in by.items())


def test_at_least_as_good_as_label_propagation(graph, found):
    nodes, edges = graph
    plain = G.label_propagation(edges.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"), "weight"), 4)
    linked = found.join(plain.select("id"), "id", "left_semi")
    assert modularity(edges, linked) >= modularity(edges, plain)
    assert T.worth(nodes, edges, found) >= T.worth(nodes, edges, plain.withColumnRenamed("label", "group"))


def test_moves_never_lower_the_total(graph):
    nodes, edges = graph
    rnd = random.Random(1)
    start = nodes.sparkSession.createDataFrame([(r.id, rnd.randrange(8) * 2 + r.part) for r in nodes.collect()], "id long, group long")
    totals = [T.worth(nodes, edges, T._move(nodes, start, edges, 32, T.RESOLUTION, n)) for n in (0, 1, 4)]
    assert totals == sorted(totals) and totals[-1] > totals[0]


def test_tree_is_whole_and_gated(planted, built):
    units, edges = planted
    nodes, members = built
    assert T.integrity(nodes, members, units).collect() == []
    facts = T.metrics(nodes, members, edges)
    row = T.gates(facts, 6, 3, cohesion=0.3, giant=0.9).first()
    assert row.capacity_ok and row.cohesion_ok and row.publishable and row.largest_leaf <= 6 and row.most_children <= 3
    assert not T.gates(facts, 6, 3, cohesion=0.99).first().publishable and not T.gates(facts, 4, 3).first().capacity_ok
    roots = nodes.where("parent is null").collect()
    assert sorted((r.part, r.units) for r in roots) == [(0, PLANTED * SIZE // 2 + 1), (1, PLANTED * SIZE // 2 + 1)]
    broken = members.where("id <> 5").unionByName(members.where("id = 6"))
    assert {r.fault for r in T.integrity(nodes, broken, units).collect()} == {"unit not in one leaf", "unit in two leaves"}


def test_small_and_empty_trees(spark):
    units, edges = spark.createDataFrame([(1, 0)], "id long, part int"), spark.createDataFrame([], "a long, b long, weight double")
    nodes, members = T.build(units, edges)
    assert sorted((r.node, r.parent, r.units) for r in nodes.collect()) == [("0/1", "root/0", 1), ("root/0", None, 1)] and members.count() == 1
    nodes, members = T.build(units.limit(0), edges)
    assert nodes.count() == members.count() == 0


def test_routes_reach_their_targets(spark, planted, built):
    """Units of common and own words; queries of a few words of one unit.  Recall at 10 of its routes' members."""
    units, edges = planted
    rnd = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    words = {r.id: rnd.sample(common, 12) + [f"t{r.id // SIZE}x{i}" for i in rnd.sample(range(12), 5)] + [f"u{r.id}x{i}" for i in range(3)] for r in units.collect()}
    terms = spark.createDataFrame([(i, w, 1.0) for i, ws in words.items() for w in ws], "id long, term string, weight double")
    targets = rnd.sample(sorted(words), 30)
    asked = spark.createDataFrame([(q, w) for q in targets for w in rnd.sample(words[q][:12], 4) + rnd.sample(words[q][12:], 4)], "query long, term string")
    nodes, members = built
    depth = nodes.agg(F.max("height")).first()[0] + 1
    routes = S.route(T.signals(asked, T.profiles(terms, members, nodes), nodes, "query"), "query", depth)
    reach = routes.select("query", "leaf").distinct().join(members, "leaf")
    ranked = reach.join(terms.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).join(asked, ["query", "term"]).groupBy("query", "id").count()
    best: dict = {}
    for r in ranked.collect():
        best.setdefault(r.query, []).append((-r["count"], r.id))
    hits = sum(q in [i for _, i in sorted(best.get(q, []))[:10]] for q in targets)
    assert hits >= 0.9 * len(targets)
    assert reach.count() < 0.6 * len(targets) * units.count()
