"""Routing trees: capacity-bound communities by merges and moves in rounds, levels built from the leaves up, quality gates, routes.

A community is worth the weight of its inside edges less ``resolution`` for each pair of its members.  Everything happens in rounds over
tables: in a round, pairs of groups that are each other's best partner merge (or one member of a group moves to a group that
takes no other in this round), so the changes of a round touch different groups, their gains add up exactly, and no round
lowers the total.  No group outgrows its capacity at any time, so a hub costs at most as many rounds as a group has room.
Partitions (ACL scopes) never mix.  Groups and edges shrink with each merge; nothing is walked on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import edge_metrics
from .staging import cut, place_in_group

LEAF, CHILDREN, LEAST, RESOLUTION = 32, 8, 2, 0.05


def both_ways(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, weight) of edges (a, b, weight) whose ends are nodes of one partition; parallel edges count by their largest."""
    part = lambda c: nodes.select(F.col("id").alias(c), F.col("part").alias(f"_p{c}"))
    inside = edges.where("a <> b and weight > 0").join(part("a"), "a").join(part("b"), "b").where("_pa = _pb")
    pairs = inside.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "weight").groupBy("u", "v").agg(F.max("weight").alias("weight"))
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (u, v, weight) between groups, of edges between members; inside edges go."""
    side = lambda c: groups.select(F.col("id").alias(c), F.col("group").alias(f"_{c}"))
    between = edges.join(side("u"), "u").join(side("v"), "v").where("_u <> _v")
    return between.groupBy(F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.sum("weight").alias("weight"))


def _merge(nodes: DataFrame, edges: DataFrame, capacity: int, worth: Column, order: Column) -> DataFrame:
    """(id, group): mutual best partners merge, round after round, while a pair that fits is ``worth`` it.

    nodes (id, size); edges (u, v, weight), both ways.  worth and order are expressions over weight, su and sv, the same for both ends.
    """
    labels = cut(nodes.select("id", F.col("id").alias("group")))
    sizes, edges = cut(nodes.select("id", "size")), cut(edges)
    while True:
        size = lambda c: sizes.select(F.col("id").alias(c), F.col("size").alias(f"s{c}"))
        open_ = edges.join(size("u"), "u").join(size("v"), "v").where((F.col("su") + F.col("sv") <= capacity) & worth)
        # equal orders: the pair with the smaller ends, seen alike from both
        best = open_.groupBy("u").agg(F.max_by("v", F.struct(F.round(order, 12), -F.least("u", "v"), -F.greatest("u", "v"))).alias("v"))
        back = best.select(F.col("u").alias("v"), F.col("v").alias("u"))
        pairs = cut(best.join(back, ["u", "v"]).where("u < v"))
        if pairs.isEmpty():
            return labels
        into = pairs.select(F.col("v").alias("group"), F.col("u").alias("_to"))
        labels = cut(labels.join(into, "group", "left").select("id", F.coalesce("_to", "group").alias("group")))
        step = cut(sizes.select("id").join(into.withColumnRenamed("group", "id"), "id", "left").select("id", F.coalesce("_to", "id").alias("group")))
        sizes = cut(sizes.join(step, "id").groupBy(F.col("group").alias("id")).agg(F.sum("size").alias("size")))
        edges = cut(contract(edges, step))


def _move(nodes: DataFrame, labels: DataFrame, edges: DataFrame, capacity: int, resolution: float, rounds: int) -> DataFrame:
    """labels after single moves of positive gain: in a round a group sends one member or receives one, never both."""
    for turn in range(rounds):
        g = labels.join(nodes, "id")
        totals = g.groupBy("group").agg(F.sum("size").alias("total"))
        sends = F.pmod(F.xxhash64(F.lit(turn), "group"), F.lit(2)) == 0
        near = edges.join(labels.select(F.col("id").alias("v"), F.col("group").alias("to")), "v").groupBy("u", "to").agg(F.sum("weight").alias("w"))
        mine = g.join(totals, "group").where(sends).select(F.col("id").alias("u"), "size", F.col("group").alias("from"), F.col("total").alias("t_from"))
        each = cut(near.join(mine, "u"))
        stay = each.where("to = from").select("u", F.col("w").alias("w_from"))
        room = totals.where(~sends).select(F.col("group").alias("to"), F.col("total").alias("t_to"))
        gain = (F.col("w") - resolution * F.col("size") * F.col("t_to")) - (F.coalesce("w_from", F.lit(0.0)) - resolution * F.col("size") * (F.col("t_from") - F.col("size")))
        ready = each.where("to <> from").join(room, "to").join(stay, "u", "left").withColumn("gain", F.round(gain, 9)).where((F.col("gain") > 0) & (F.col("t_to") + F.col("size") <= capacity))
        first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("gain"), "u", "to"))  # noqa: E731  of a group's few movers
        moves = cut(ready.withColumn("_s", first("from")).where("_s = 1").withColumn("_r", first("to")).where("_r = 1").select(F.col("u").alias("id"), "to"))
        if moves.isEmpty() and turn % 2:
            break
        labels = cut(labels.join(moves, "id", "left").select("id", F.coalesce("to", "group").alias("group")))
    return labels


def communities(nodes: DataFrame, edges: DataFrame, capacity: int = LEAF, resolution: float = RESOLUTION, least: int = LEAST, rounds: int = 8) -> DataFrame:
    """(id, group) of nodes (id, size, part) under edges (u, v, weight): no group above ``capacity``.

    Merges by density, then moves; groups below ``least`` join the group they are most tied to, those without any tie are
    packed with others of their partition, by id, and what is left over joins the smallest group.  A group's name is the smallest id in it.
    """
    nodes, edges = cut(nodes), cut(edges)
    pairs = F.col("su") * F.col("sv")
    labels = _merge(nodes, edges, capacity, F.col("weight") > resolution * pairs, F.col("weight") / pairs)
    labels = _move(nodes, labels, edges, capacity, resolution, rounds)
    if least > 1:
        sizes = labels.join(nodes, "id").groupBy(F.col("group").alias("id")).agg(F.sum("size").alias("size"), F.first("part").alias("part"))
        sizes = cut(sizes)
        small = (F.col("su") < least) | (F.col("sv") < least)
        up = _merge(sizes, contract(edges, labels), capacity, small, F.col("weight"))
        labels = cut(labels.withColumnRenamed("group", "_g").join(up.withColumnRenamed("id", "_g"), "_g").select("id", "group"))
        sizes = cut(labels.join(nodes, "id").groupBy(F.col("group").alias("id")).agg(F.sum("size").alias("size"), F.first("part").alias("part")))
        few = cut(sizes.where(F.col("size") < least))
        if not few.isEmpty():
            width = max(1, capacity // (least - 1))
            placed = cut(place_in_group(few.select("id", "part"), "part", ["id"], "_p").withColumn("_b", F.floor((F.col("_p") - 1) / width)))
            packed = placed.join(placed.groupBy("part", "_b").agg(F.min("id").alias("_to")), ["part", "_b"]).select(F.col("id").alias("group"), "_to")
            labels = cut(labels.join(packed, "group", "left").select("id", F.coalesce("_to", "group").alias("group")))
            # the last pack of a partition may be small still: it joins the partition's smallest other group, if that has room
            sizes = cut(labels.join(nodes, "id").groupBy("group").agg(F.sum("size").alias("size"), F.first("part").alias("part")))
            last = sizes.where(F.col("size") < least).groupBy("part").agg(F.min("group").alias("_g"), F.min("size").alias("_s"))
            host = sizes.join(last, "part").where((F.col("group") != F.col("_g")) & (F.col("size") + F.col("_s") <= capacity)).groupBy("_g").agg(F.min(F.struct("size", "group"))["group"].alias("_to"))
            labels = cut(labels.join(host.withColumnRenamed("_g", "group"), "group", "left").select("id", F.coalesce("_to", "group").alias("group")))
    names = labels.groupBy("group").agg(F.min("id").alias("_name"))  # the member that a group was named after may have moved
    return cut(labels.join(names, "group").select("id", F.col("_name").alias("group")))


def worth(nodes: DataFrame, edges: DataFrame, labels: DataFrame, resolution: float = RESOLUTION) -> float:
    """The total that communities() raises; edges both ways."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("group").alias(f"_{c}"))
    inside = edges.join(side("u"), "u").join(side("v"), "v").where("_u = _v").agg(F.sum("weight")).first()[0] or 0.0
    s = labels.join(nodes, "id").groupBy("group").agg(F.sum("size").alias("t"), F.sum(F.col("size") * F.col("size")).alias("q"))
    return inside / 2 - resolution * (s.agg(F.sum((F.col("t") * F.col("t") - F.col("q")) / 2)).first()[0] or 0.0)


def build(units: DataFrame, edges: DataFrame, leaf: int = LEAF, children: int = CHILDREN, resolution: float = RESOLUTION, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): nodes (node, parent, part, height, units), members (id, leaf), of units (id, part) and edges (a, b, weight).

    Leaves are communities of units; the nodes of each height are communities of those below, at most ``children`` in one, until a
    partition has few enough for its root.  Ids are longs.
    """
    units = cut(units.select("id", "part", F.lit(1).cast("long").alias("size")))
    edges = cut(both_ways(edges, units))
    labels = communities(units, edges, leaf, resolution, least)
    name = lambda h, c: F.concat_ws("/", F.lit(h).cast("string"), F.col(c).cast("string"))
    members = labels.select("id", name(0, "group").alias("leaf"))
    level = cut(labels.join(units, "id").groupBy(F.col("group").alias("id"), "part").agg(F.count("*").alias("units")))
    edges, height, rows = cut(contract(edges, labels)), 0, []
    while True:
        counts = cut(level.groupBy("part").agg(F.count("*").alias("n")))
        done = counts.where(F.col("n") <= children).select("part")
        # the last nodes of a partition hang on its root
        rows.append(level.join(done, "part", "left_semi").select(name(height, "id").alias("node"), F.concat(F.lit("root/"), F.col("part").cast("string")).alias("parent"), "part", F.lit(height).alias("height"), "units"))
        rest = cut(level.join(done, "part", "left_anti"))
        if rest.isEmpty():
            break
        up = communities(rest.select("id", "part", F.lit(1).cast("long").alias("size")), edges, children, 0.0, 2)
        rows.append(rest.join(up, "id").select(name(height, "id").alias("node"), name(height + 1, "group").alias("parent"), "part", F.lit(height).alias("height"), "units"))
        level = cut(rest.join(up, "id").groupBy(F.col("group").alias("id"), "part").agg(F.sum("units").alias("units")))
        edges, height = cut(contract(edges, up)), height + 1
    nodes = rows[0]
    for r in rows[1:]:
        nodes = nodes.unionByName(r)
    roots = units.groupBy("part").agg(F.count("*").alias("units"))
    roots = roots.select(F.concat(F.lit("root/"), F.col("part").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), "part", F.lit(height + 1).alias("height"), "units")
    return cut(nodes.unionByName(roots)), cut(members)


def metrics(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: cohesion and edge_cut of the leaves, giant_ratio (largest of several children over their parent), child_size_entropy, depth, leaves, largest_leaf, most_children."""
    up = nodes.select(F.col("node").alias("parent"), F.col("units").alias("_of"))
    kids = nodes.where("parent is not null").join(up, "parent").withColumn("_k", F.count("*").over(Window.partitionBy("parent")))
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    shape = kids.agg(F.round(F.max(F.when(F.col("_k") > 1, F.col("units") / F.col("_of"))), 6).alias("giant_ratio"), F.sum("units").alias("_s"), F.sum(F.col("units") * F.log("units")).alias("_l"))
    shape = shape.select("giant_ratio", F.round(F.log("_s") - F.col("_l") / F.col("_s"), 6).alias("child_size_entropy"))
    few = kids.groupBy("parent").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_children"))
    size = leaves.agg(F.count("*").alias("leaves"), F.max("units").alias("largest_leaf"))
    whole = edge_metrics(edges, members.select("id", F.col("leaf").alias("group")))
    return whole.crossJoin(shape).crossJoin(few).crossJoin(size)  # one row each


def gates(row: DataFrame, leaf: int = LEAF, children: int = CHILDREN, cohesion: float = 0.0, cut_most: float = 1.0, giant: float = 1.0, recall: Column | None = None, recall_least: float = 0.0) -> DataFrame:
    """The metrics with a verdict on each and ``publishable``."""
    checks = {
        "capacity_ok": (F.col("largest_leaf") <= leaf) & (F.col("most_children") <= children), "cohesion_ok": F.col("cohesion") >= cohesion, "edge_cut_ok": F.col("edge_cut") <= cut_most,
        "giant_ok": F.coalesce("giant_ratio", F.lit(0.0)) <= giant, "recall_ok": F.lit(recall_least == 0) if recall is None else recall >= recall_least,
    }
    out = row.withColumns(checks)
    return out.withColumn("publishable", F.expr(" AND ".join(checks)))


def integrity(nodes: DataFrame, members: DataFrame, units: DataFrame) -> DataFrame:
    """(fault, n) of what is wrong with a tree: units missing or twice, nodes without parent, parts that mix, counts that don't add up."""
    up = nodes.select(F.col("node").alias("parent"), F.col("part").alias("_p"), F.col("height").alias("_h"))
    kids = nodes.where("parent is not null").join(up, "parent", "left")
    own = members.join(units, "id", "full_outer").join(nodes.select(F.col("node").alias("leaf"), F.col("part").alias("_p")), "leaf", "left")
    sums = kids.groupBy("parent").agg(F.sum("units").alias("n")).join(nodes.select(F.col("node").alias("parent"), "units"), "parent")
    named = {
        "unit not in one leaf": own.where("leaf is null or part is null or _p is null"), "unit in two leaves": members.groupBy("id").count().where("count > 1"), "unit in another part": own.where("part <> _p"),
        "parent missing": kids.where("_p is null"), "parts mix": kids.where("_p <> part"), "counts differ": sums.where("n <> units"), "not below its parent": kids.where("_h <= height"),
    }
    out = None
    for fault, rows in named.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(fault).alias("fault"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


# ---- routes -----------------------------------------------------------------------------------


def profiles(terms: DataFrame, members: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(node, term, weight) of every node: its units' terms (id, term, weight), summed up from the leaves to the roots.

    ``most`` keeps the heaviest terms of each node; without it a profile is complete, and a term that a unit holds is never missed on
    the way down to it.
    """
    at = terms.join(members, "id").groupBy(F.col("leaf").alias("node"), "term").agg(F.sum("weight").alias("weight"))
    parents = cut(nodes.where("parent is not null").select("node", "parent"))
    levels = [cut(at)]
    while True:
        above = levels[-1].join(parents, "node").groupBy(F.col("parent").alias("node"), "term").agg(F.sum("weight").alias("weight"))
        above = cut(above)
        if above.isEmpty():
            break
        levels.append(above)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = out.groupBy("node", "term").agg(F.sum("weight").alias("weight"))  # nodes whose children are of several heights
    if most is None:
        return out
    seat = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "term"))
    return out.withColumn("_s", seat).where(F.col("_s") <= most).drop("_s")


def signals(queries: DataFrame, profile: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """(query, node, parent, score): 0.65 of the share of a query's weight that the node's terms cover, 0.35 of the node's share of it among its siblings.

    A term weighs the more the fewer leaves hold it, so words that all nodes share tell none apart.
    """
    leaves = nodes.where("height = 0").select("node")
    n = leaves.count()
    df = profile.join(leaves, "node", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select(query, "term").distinct().join(df, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = cut(asked)
    total = asked.groupBy(query).agg(F.sum("idf").alias("_all"))
    hit = asked.join(profile, "term").groupBy(query, "node").agg(F.sum("idf").alias("_c"), F.sum(F.col("idf") * F.col("weight")).alias("_w"))
    hit = hit.join(total, query).join(nodes.select("node", "parent"), "node")
    siblings = F.sum("_w").over(Window.partitionBy(query, "parent"))
    return hit.select(query, "node", "parent", (0.65 * F.col("_c") / F.col("_all") + 0.35 * F.col("_w") / siblings).alias("score"))
