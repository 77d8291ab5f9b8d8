"""Knowledge graph, components, random walks, trees, routing, drift, lineage."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors as V
from .retrieval import BLOCK_BYTES, unit_rows
from .staging import bucketed, cut, place_in_group, range_rank

# Signal weights of an edge.
SIGNALS = {"semantic": 0.4, "lexical": 0.2, "entity": 0.15, "structure": 0.1, "temporal": 0.1, "citation": 0.05}


def fuse_signals(signals: dict[str, Column], weights: dict[str, float] = SIGNALS) -> Column:
    """Weighted mean over the signals that are not null; 0 without any."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c * weights[n], F.lit(0.0)) for n, c in signals.items()])
    mass = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), weights[n]).otherwise(0.0) for n, c in signals.items()])
    return F.when(mass > 0, total / mass).otherwise(0.0)


#: Places of a posting list that are looked at together.
STRETCH = 4096


def posting_candidates(keys: DataFrame, id_col: str, key: str, neighbours: int = 24, most: int = 96) -> DataFrame:
    """(a, b, votes), a < b: units near each other (by id) in the posting lists they share.

    In each list a unit meets at most ``neighbours`` others around its own place, so a hot key gives rows linear in its
    length: long lists are cut into stretches, and the places next to a stretch stand in it as well.  What travels is one short
    list of neighbours a posting; votes are counted and ranked where all lists of a unit have come together.
    """
    half = neighbours // 2
    placed = place_in_group(keys.distinct(), key, [id_col], "_p")
    stretch = lambda p: F.floor(p / STRETCH)
    at = F.col("_p") - 1
    seen = placed.withColumn("_own", stretch(at)).withColumn("_b", F.explode(F.array_distinct(F.array(stretch(F.greatest(at - half, F.lit(0))), "_own", stretch(at + half)))))
    around = Window.partitionBy(key, "_b").orderBy("_p").rowsBetween(-half, half)
    near = seen.withColumn("_near", F.collect_list(id_col).over(around)).where("_own = _b and size(_near) > 1").select(F.col(id_col).alias("_u"), "_near")
    votes = near.repartition("_u").select("_u", F.explode("_near").alias("_v")).where("_u <> _v").groupBy("_u", "_v").agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy("_u").orderBy(F.desc("votes"), "_v"))
    best = votes.withColumn("_r", rank).where(F.col("_r") <= most)
    return best.select(F.least("_u", "_v").alias("a"), F.greatest("_u", "_v").alias("b"), "votes").distinct()


#: Postings of one block of units, and the fewest blocks (pairs of blocks are what tasks work on).
BLOCK_POSTINGS, BLOCKS = 8_000_000, 8


def _term_lists(post: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """(_id, t, w): each unit's terms, as numbers in order, with their BM25 weights (mean length from the corpus), and the blocks to deal the units into."""
    post = cut(post)
    stats = post.groupBy(id_col).agg(F.first("doc_len").alias("n"), F.count("*").alias("terms")).agg(F.count("*").alias("n"), F.avg("n").alias("avg"), F.sum("terms").alias("terms")).first()
    df = range_rank(post.groupBy("term").agg(F.count("*").alias("df")), ["df", "term"], "_t")  # numbers instead of words from here on
    n, avg = stats["n"], stats["avg"] or 1.0
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("doc_len") / avg))
    own = post.join(df, "term").select(F.col(id_col).alias("_id"), F.struct(F.col("_t").cast("int").alias("t"), weight.alias("w")).alias("_p"))
    lists = own.groupBy("_id").agg(F.array_sort(F.collect_list("_p")).alias("_p")).select("_id", F.col("_p.t").alias("t"), F.col("_p.w").alias("w"))
    return lists, max(BLOCKS, -(-(stats["terms"] or 0) // BLOCK_POSTINGS))


def _block(c: Column | str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def _tile(x: Column, y: Column, blocks: int) -> Column:
    return F.least(x, y) * blocks + F.greatest(x, y)


def symmetric_bm25(pairs: DataFrame, post: DataFrame, id_col: str) -> DataFrame:
    """(a, b, lexical): half the sum of both directions' BM25 over shared terms, mean length from the corpus.

    A pair needs the terms of both its units, and units have many partners: units are dealt into blocks of bounded size, and
    a pair is worked out where the two blocks of its units meet.  So a unit's terms travel once a block, not once a partner.
    """
    lists, blocks = _term_lists(post, id_col)
    sent = lists.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(_tile(_block("_id", blocks), F.col("_o"), blocks).alias("_tile"), "_id", "t", "w")
    asked = pairs.select(_tile(_block("a", blocks), _block("b", blocks), blocks).alias("_tile"), "a", "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return asked.groupBy("_tile").cogroup(sent.groupBy("_tile")).applyInArrow(_shared_weight, f"a {kind}, b {kind}, lexical double")


#: Pairs that leave a task at once.
PAIRS_AT_ONCE = 1 << 17


def all_pairs_bm25(keys: DataFrame, post: DataFrame, id_col: str, key: str) -> DataFrame:
    """(a, b, lexical), a < b: every pair of units that share a key, with the value of symmetric_bm25.

    There are as many as the square of the longest lists.  Units are dealt into the same blocks; where two blocks meet, one unit after
    another is held against all of the other block, and its pairs leave the task at once: a task holds two blocks and no list of pairs.
    """
    lists, blocks = _term_lists(post, id_col)
    keys = cut(keys.where(F.col(id_col).isNotNull() & F.col(key).isNotNull()).select(id_col, key).distinct())
    number = range_rank(keys.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), [key], "_k")
    own = keys.join(number, key).groupBy(F.col(id_col).alias("_id")).agg(F.collect_list(F.col("_k").cast("int")).alias("k"))
    units = cut(own.join(lists, "_id", "left").withColumn("_b", _block("_id", blocks)))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    sent = units.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(_tile(F.col("_b"), F.col("_o"), blocks).alias("_tile"), "_b", "_id", "k", none("t", "int"), none("w", "double"))
    kind = keys.schema[id_col].dataType.simpleString()
    return sent.repartition(blocks * (blocks + 1) // 2, "_tile").sortWithinPartitions("_tile").mapInArrow(_tiles(blocks), f"a {kind}, b {kind}, lexical double")


def _tiles(blocks: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        tile = None
        for b in batches:
            of = b.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip([0, *ends], ends):
                if of[lo] != tile and held:
                    yield from _all_pairs(pa.Table.from_batches(held), *divmod(tile, blocks))
                    held = []
                tile = int(of[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _all_pairs(pa.Table.from_batches(held), *divmod(tile, blocks))

    return run


def _all_pairs(units: pa.Table, x: int, y: int):
    """The pairs that share a key between block x and block y, in batches."""
    side = lambda b: units.filter(pc.equal(units["_b"], b)).combine_chunks()
    left, right = side(x), side(y)
    flat = lambda t, c: pc.list_flatten(t[c]).to_numpy()
    ends = lambda t, c: np.concatenate([[0], np.cumsum(pc.list_value_length(t[c]).to_numpy())]).astype(np.int64)
    k, t, w, k_ends, t_ends = flat(right, "k"), flat(right, "t"), flat(right, "w"), ends(right, "k"), ends(right, "t")
    k_own, t_own, w_own, k_own_ends, t_own_ends = (k, t, w, k_ends, t_ends) if x == y else (flat(left, "k"), flat(left, "t"), flat(left, "w"), ends(left, "k"), ends(left, "t"))
    most = lambda *of: max((int(a.max()) for a in of if len(a)), default=0) + 1
    has, mine = np.zeros(most(k, k_own), bool), np.zeros(most(t, t_own))
    owner = np.repeat(np.arange(right.num_rows), np.diff(t_ends))
    ids, own_ids = right["_id"].combine_chunks(), left["_id"].combine_chunks()
    found: list[tuple] = []
    n = 0

    def batch():
        one = own_ids.take(pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])))
        two = ids.take(pa.array(np.concatenate([f[1] for f in found])))
        first = pc.less(one, two)
        return pa.RecordBatch.from_arrays([pc.if_else(first, one, two), pc.if_else(first, two, one), pa.array(np.concatenate([f[2] for f in found]))], ["a", "b", "lexical"])

    for u in range(left.num_rows):
        start = u + 1 if x == y else 0  # a block meets itself once
        if start >= right.num_rows:
            continue
        own_k, own_t = k_own[k_own_ends[u] : k_own_ends[u + 1]], slice(t_own_ends[u], t_own_ends[u + 1])
        has[own_k] = True
        near = start + np.flatnonzero(np.logical_or.reduceat(has[k[k_ends[start] :]], k_ends[start:-1] - k_ends[start]))
        has[own_k] = False
        if not len(near):
            continue
        mine[t_own[own_t]] = w_own[own_t]
        at = slice(t_ends[start], None)
        other = mine[t[at]]
        shared = np.flatnonzero(other > 0)
        both = np.bincount(owner[at][shared], other[shared] + w[at][shared], right.num_rows)
        mine[t_own[own_t]] = 0.0
        found.append((u, near, 0.5 * both[near]))
        n += len(near)
        if n >= PAIRS_AT_ONCE:
            yield batch()
            found, n = [], 0
    if found:
        yield batch()


def _shared_weight(pairs: pa.Table, units: pa.Table) -> pa.Table:
    """Half the sum of both weights of every term that a pair shares."""
    names = {x: i for i, x in enumerate(units["_id"].to_pylist())}
    sizes = pc.list_value_length(units["t"]).to_numpy()
    ends, terms, w = np.concatenate([[0], np.cumsum(sizes)]), pc.list_flatten(units["t"]).to_numpy(), pc.list_flatten(units["w"]).to_numpy()
    _, terms = np.unique(terms, return_inverse=True)
    at = lambda c: np.array([names.get(x, -1) for x in pairs[c].to_pylist()], np.int64)
    x, y = at("a"), at("b")
    out = np.zeros(len(x))
    mine = np.zeros(int(terms.max()) + 1 if len(terms) else 1)
    order = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.diff(x[order], prepend=-2))
    for lo, hi in zip(starts, [*starts[1:], len(order)]):
        which = order[lo:hi]
        own = x[which[0]]
        which = which[y[which] >= 0]
        if own < 0 or not len(which):
            continue
        seen = slice(ends[own], ends[own + 1])
        mine[terms[seen]] = w[seen]
        sizes = ends[y[which] + 1] - ends[y[which]]
        first = np.cumsum(sizes) - sizes
        cells = np.repeat(ends[y[which]] - first, sizes) + np.arange(sizes.sum())
        other = mine[terms[cells]]
        both = np.where(other > 0, other + w[cells], 0.0)
        out[which] = 0.5 * np.bincount(np.repeat(np.arange(len(which)), sizes), both, len(which))
        mine[terms[seen]] = 0.0
    return pa.table({"a": pairs["a"], "b": pairs["b"], "lexical": out})


def percentiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact, as F.percentile: bounds by approximate ones, then only the values between them, by count, come together."""
    n = df.agg(F.count(col)).first()[0]
    if not n:
        return [None] * len(shares)
    slack = 0.0005 + 4 / n  # the error of the approximate ones, and the two places that a share lies between
    asked = [min(1.0, max(0.0, p + d)) for p in shares for d in (-slack, slack)]
    bounds = df.agg(F.percentile_approx(col, asked, 10_000)).first()[0]
    out = []
    for k, p in enumerate(shares):
        lo, hi = bounds[2 * k], bounds[2 * k + 1]
        below = df.where(F.col(col) < lo).count()
        near = sorted((r[0], r[1]) for r in df.where(F.col(col).between(lo, hi)).groupBy(col).count().collect())
        ends = below + np.cumsum([c for _, c in near])
        at = p * (n - 1)
        value = lambda i: near[int(np.searchsorted(ends, i, "right"))][0]  # noqa: B023, E731
        x, y, part = value(math.floor(at)), value(math.ceil(at)), at - math.floor(at)
        out.append(x if x == y else (1 - part) * x + part * y)
    return out


def calibrate(df: DataFrame, col: str, out: str) -> DataFrame:
    """(v - q05) / (q95 - q05) clamped; with equal quantiles 1 where positive."""
    lo, hi = (q or 0.0 for q in percentiles(df, col, [0.05, 0.95]))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(col) - lo) / (hi - lo))) if hi > lo else (F.col(col) > 0).cast("double")
    return df.withColumn(out, c)


#: Edges that one task may walk.
WALK = 1 << 19


def greedy(edges: DataFrame, part: list[str], ends: tuple[Column, Column], order: list[Column], most: int, inside: Column | None = None, most_inside: int = 0) -> DataFrame:
    """The edges that a walk in ``order`` takes while both ends have room for ``most`` edges (``most_inside`` where ``inside`` holds).

    Nothing is walked: in each round every end marks the first edges it has room for, and an edge marked by both ends is one that the
    walk must take, since what stands before it leaves room.  Full ends drop out.  ``order`` must tell all edges of an end apart.

    An edge carries the room at both its ends, so a round is two shuffles of what is left: to the ends, which count what the round
    before took and mark, and back to the edges.  What is left when it is at most WALK edges is walked, in one task: the last rounds
    are many and small.
    """
    columns, num = edges.columns, lambda c: c.cast("int")
    inside = F.lit(False) if inside is None else F.coalesce(inside, F.lit(False))
    left = cut(edges.distinct().withColumns({c: F.lit(v).cast("int") for c, v in (("_xf", most), ("_yf", most), ("_xi", most_inside), ("_yi", most_inside), ("_t", 0))}))
    taken = None
    while True:
        if left.count() <= WALK:
            name = lambda node: F.to_json(F.struct(*part, node.alias("_n")))
            named = left.select(*columns, name(ends[0]).alias("_x"), name(ends[1]).alias("_y"), inside.alias("_in"), "_xf", "_yf", "_xi", "_yi", "_t")
            walked = cut(named.repartition(1).sortWithinPartitions(F.desc("_t"), *order).mapInArrow(_walk(len(columns)), edges.schema))
            return walked if taken is None else taken.unionByName(walked)
        at = lambda end, node: F.struct(node.alias("_n"), F.lit(end).alias("_w"), F.col(f"_{end}f").alias("_f"), F.col(f"_{end}i").alias("_fi"))
        half = left.select(*columns, "_t", inside.alias("_in"), F.explode(F.array(at("x", ends[0]), at("y", ends[1]))).alias("_h")).select(*columns, "_t", "_in", "_h.*")
        own = Window.partitionBy(*part, "_n")
        half = half.withColumns({"_f": F.col("_f") - num(F.sum("_t").over(own)), "_fi": F.col("_fi") - num(F.sum(F.when(F.col("_in"), F.col("_t")).otherwise(0)).over(own))})
        half = half.where("_t = 0 and _f > 0 and (not _in or _fi > 0)")
        seat, seat_in = F.row_number().over(own.orderBy(*order)), F.sum(num(F.col("_in"))).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        half = half.withColumns({"_s": seat, "_si": seat_in}).withColumn("_m", num((F.col("_s") <= F.col("_f")) & (~F.col("_in") | (F.col("_si") <= F.col("_fi")))))
        room = lambda end, c: F.max(F.when(F.col("_w") == end, F.col(c)))
        met = half.groupBy(*columns).agg(room("x", "_f").alias("_xf"), room("y", "_f").alias("_yf"), room("x", "_fi").alias("_xi"), room("y", "_fi").alias("_yi"), num(F.sum("_m") == 2).alias("_t"), F.count("*").alias("_c"))
        left = cut(met.where("_c = 2").drop("_c"))
        new = left.where("_t = 1").select(*columns)
        taken = new if taken is None else taken.unionByName(new)
        if left.where("_t = 0").isEmpty():
            return taken


def _walk(columns: int):
    """Of edges in order (after their columns: names of both ends, inside, room at both ends, whether taken; those first) the others that a walk takes."""

    def run(batches):
        room: dict[str, list[int]] = {}
        for b in batches:
            keep = []
            for x, y, inner, xf, yf, xi, yi, taken in zip(*(c.to_pylist() for c in b.columns[columns:])):
                p, q = room.setdefault(x, [xf, xi]), room.setdefault(y, [yf, yi])
                need = 2 if x == y else 1  # an edge of one node takes two places there
                takes = not taken and min(p[0], q[0]) >= need and (not inner or min(p[1], q[1]) >= need)
                if taken or takes:
                    for end in (p, q):
                        end[0] -= 1
                        end[1] -= bool(inner)
                keep.append(takes)
            yield b.select(range(columns)).filter(pa.array(keep, pa.bool_()))

    return run


def cap_degree(edges: DataFrame, part: str, most: int = 32) -> DataFrame:
    """Keep edges by weight while both ends have fewer than ``most``, at most half of them inside one document.

    (part, a, b, weight, same_doc) -> the same, as one walk in order of weight, a, b for each ACL partition would.
    """
    order = [F.desc("weight"), F.asc("a"), F.asc("b"), F.asc("same_doc")]
    return greedy(edges, [part], (F.col("a"), F.col("b")), order, most, F.col("same_doc"), max(1, most // 2))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable.  Minimum labels with pointer jumping; lineage is cut each round."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = cut(e.union(e.select("v", "u")).distinct())
    labels = cut(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "id"))
    while True:
        near = e.join(labels.withColumnsRenamed({"id": "v", "label": "l"}), "v").groupBy(F.col("u").alias("id")).agg(F.min("l").alias("l"))
        step = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = step.alias("x").join(step.alias("y"), F.col("x.label") == F.col("y.id"), "left")
        new = cut(jump.select(F.col("x.id").alias("id"), F.least(F.col("x.label"), F.coalesce("y.label", "x.label")).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels.withColumnRenamed("label", "component")


#: Buckets of a graph whose edges stay in place; ranks of its hubs go to each.  There are more of them where one would get too many edges.
GRAPH_BUCKETS, BUCKET_EDGES = 48, 2_000_000


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.6, rounds: int = 30, to_hub: Column | None = None) -> DataFrame:
    """Personalised PageRank over weighted directed edges (src, dst, weight) from seeds (id, weight): damped power iteration.

    Each round is one join and one sum; the mass of nodes without out-edges goes back to the seeds.  ``to_hub`` says which edges lead
    to a node of many edges from one of few; the ranks are the same whatever it says, but what is shuffled is not (_hub_rounds).
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    seed = seeds.groupBy("id").agg((F.sum("weight") / total).alias("s"))
    if to_hub is not None:
        return _hub_rounds(edges, seed, damping, rounds, to_hub)
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    move = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    seed = cut(seed)
    rank = seed.select("id", F.col("s").alias("r"))
    for i in range(rounds):
        flow = rank.join(move, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("r") * F.col("p"))).alias("f"))
        rank = flow.join(seed, "id", "full_outer").select("id", (F.coalesce("f", F.lit(0.0)) + (1 - damping) * F.coalesce("s", F.lit(0.0))).alias("r"))
        if i % 5 == 4:
            rank = cut(rank)
    return rank


def _hub_rounds(edges: DataFrame, seed: DataFrame, damping: float, rounds: int, to_hub: Column) -> DataFrame:
    """The rounds of pagerank with all edges in buckets of the end that has fewer of them, where they stay.

    An edge to a hub stands with its source: what a bucket sends to a hub is summed up there and travels as one row.  Any other edge
    stands with its target: a source's rank travels once to each bucket that has targets of it.  So a round is one
    shuffle, of a row a hub and bucket.  The joins hold a bucket's nodes in memory, so buckets grow in number and not in size.
    """
    spark = edges.sparkSession
    n = max(8, min(GRAPH_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), -(-edges.count() // BUCKET_EDGES))
    part = lambda c: F.pmod(F.hash(c), F.lit(n)).cast("int")
    e = edges.where("src IS NOT NULL").select("src", "dst", F.col("weight").cast("double").alias("w"), F.coalesce(to_hub & F.col("dst").isNotNull(), F.lit(False)).alias("_up"))
    up, down = e.where("_up"), e.where("not _up")
    with bucketed(spark, n, "part") as put:
        of = lambda df, id_, s, w: df.select(F.col(id_).alias("id"), F.expr(s).cast("double").alias("s"), F.expr(w).cast("double").alias("w"))
        ends = of(e, "src", "null", "w").unionByName(of(e, "dst", "null", "null")).unionByName(of(seed, "id", "s", "null"))
        nodes = put(ends.groupBy("id").agg(F.sum("s").alias("s"), F.sum("w").alias("total")).select(part("id").alias("part"), "id", "s", "total"))
        # a message has a key: the hub that it is for (up), or the source that it comes from
        routes = down.select("src", part("dst").alias("to")).distinct()
        sent = up.select(part("src").alias("part"), F.col("src").alias("id"), part("dst").alias("to"), F.lit(True).alias("up"), F.col("dst").alias("key"), "w")
        sent = put(sent.unionByName(routes.select(part("src").alias("part"), F.col("src").alias("id"), "to", F.lit(False).alias("up"), F.col("src").alias("key"), F.lit(1.0).alias("w"))))
        hubs = up.select("dst").distinct()
        got = down.select(part("dst").alias("part"), F.lit(False).alias("up"), F.col("src").alias("key"), "dst", "w")
        got = put(got.unionByName(hubs.select(part("dst").alias("part"), F.lit(True).alias("up"), F.col("dst").alias("key"), "dst", F.lit(1.0).alias("w"))))
        rank = nodes.where("s IS NOT NULL").select("part", "id", F.col("s").alias("r"), "total")
        for i in range(rounds):
            share = rank.where("total IS NOT NULL").select("part", "id", (F.col("r") / F.col("total")).alias("share"))
            own = share.hint("shuffle_hash").join(sent, ["part", "id"]).groupBy("part", "to", "up", "key").agg(F.sum(F.col("share") * F.col("w")).alias("f"))
            moved = own.select(F.col("to").alias("part"), "up", "key", "f").repartition(n, "part")
            flow = moved.hint("shuffle_hash").join(got, ["part", "up", "key"]).groupBy("part", F.col("dst").alias("id")).agg((damping * F.sum(F.col("f") * F.col("w"))).alias("f"))
            # all nodes stand left: the rows of a left join stay where they are
            on = (F.col("n.part") == F.col("f.part")) & F.col("n.id").eqNullSafe(F.col("f.id"))
            rank = nodes.alias("n").join(flow.alias("f").hint("shuffle_hash"), on, "left").where("f IS NOT NULL OR s IS NOT NULL")
            rank = rank.select("n.part", "n.id", (F.coalesce("f", F.lit(0.0)) + (1 - damping) * F.coalesce("s", F.lit(0.0))).alias("r"), "total")
            if i % 10 == 9 and i < rounds - 1:
                rank = put(rank)
        return cut(rank.select("id", "r"))


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, label): each node takes the label of most weight around it, ties to the smaller; stands in for a Leiden partition."""
    e = edges.select("a", "b", "weight")
    e = cut(e.union(e.select("b", "a", "weight")))
    labels = e.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for i in range(rounds):
        mass = e.join(labels, F.col("b") == F.col("id")).groupBy("a", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = mass.groupBy("a").agg(F.max_by("label", F.struct("w", (-F.col("label")).alias("n"))).alias("label"))
        labels = cut(best.withColumnRenamed("a", "id"))
    return labels


def balanced_children(labels: DataFrame, most: int) -> DataFrame:
    """(id, node_id): each label's members by id, in chunks of at most ``most``."""
    w = Window.partitionBy("label").orderBy("id")
    return labels.select("id", F.concat_ws("/", F.col("label"), F.floor((F.row_number().over(w) - 1) / most)).alias("node_id"))


def edge_metrics(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """cohesion (share of weight inside groups) and edge_cut, over (a, b, weight) and (id, group)."""
    j = edges.join(groups.withColumnsRenamed({"id": "a", "group": "_ga"}), "a", "left").join(groups.withColumnsRenamed({"id": "b", "group": "_gb"}), "b", "left")
    s = j.agg(F.sum("weight").alias("t"), F.sum(F.when(F.col("_ga").eqNullSafe(F.col("_gb")), F.col("weight")).otherwise(0.0)).alias("i"))
    ok = F.coalesce("t", F.lit(0.0)) > 0
    return s.select(F.round(F.when(ok, F.col("i") / F.col("t")).otherwise(0.0), 6).alias("cohesion"), F.round(F.when(ok, 1 - F.col("i") / F.col("t")).otherwise(0.0), 6).alias("edge_cut"))


def medoids(vectors: DataFrame, group: str, id_col: str, vec: str, most: int = 64) -> DataFrame:
    """(group, medoid, score): of the first ``most`` ids by SHA-256, the one with the largest sum of max(0, cosine) to all of the group.

    Sums of cosines don't split into vector sums because of the clamp; candidates are bounded, members are not.
    """
    v = vectors.select(group, id_col, V.l2_normalize(F.col(vec)).alias("_v"))
    order = Window.partitionBy(group).orderBy(F.sha2(F.col(id_col).cast("string"), 256))
    c = v.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(group, F.col(id_col).alias("medoid"), F.col("_v").alias("_c"))
    sums = v.join(c, group).groupBy(group, "medoid").agg(F.round(F.sum(F.greatest(F.lit(0.0), V.dot(F.col("_v"), F.col("_c")))), 6).alias("score"))
    return sums.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "medoid"))).where("_n = 1").drop("_n")


def sparse_profile(post: DataFrame, group: str, term: str, weight: str, most: int = 64) -> DataFrame:
    s = post.groupBy(group, term).agg(F.round(F.sum(weight), 6).alias("weight"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), term))).where(F.col("rank") <= most)


def assign(delta: DataFrame, leaves: DataFrame, id_col: str, vec: str, leaf: str, leaf_vec: str, part: str | None = None) -> DataFrame:
    """(id, leaf, similarity, state): nearest leaf (ties: the smallest); direct from 0.78, borderline from 0.58, else outlier.

    Leaves go to every task in blocks of checked size, and a batch of vectors meets a block in one matrix product.  With ``part``, a
    column of both sides, only leaves of a vector's own partition count; a vector whose partition has none is left out.
    """
    id_type, leaf_type = delta.schema[id_col].dataType.simpleString(), leaves.schema[leaf].dataType
    total = leaves.agg(F.sum(F.size(leaf_vec) * 8 + 64)).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    parts = []
    for i in range(n):
        scope = F.col(part).cast("string") if part else F.lit("")
        rows = sorted(leaves.where(F.pmod(F.xxhash64(leaf), F.lit(n)) == i).select(leaf, leaf_vec, scope).collect(), key=lambda r: r[0])
        if rows:
            near = _nearest_leaf(unit_rows([r[1] for r in rows]), pa.array([r[0] for r in rows], to_arrow_type(leaf_type)), np.array([r[2] for r in rows], object), id_col, leaf)
            parts.append(delta.select(id_col, vec, scope).mapInArrow(near, f"{id_col} {id_type}, {leaf} {leaf_type.simpleString()}, similarity double"))
    if not parts:
        return delta.select(id_col, F.lit(None).cast(leaf_type).alias(leaf), F.lit(0.0).alias("similarity"), F.lit("outlier").alias("state")).limit(0)
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        best = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("similarity"), leaf))
        found = found.withColumn("_n", best).where("_n = 1").drop("_n")
    s = F.col("similarity")
    return found.withColumn("state", F.when(s >= 0.78, "direct").when(s >= 0.58, "borderline").otherwise("outlier"))


def _nearest_leaf(table: np.ndarray, names: pa.Array, scopes: np.ndarray, id_col: str, leaf: str):
    def run(batches):
        for b in batches:
            s = np.round(unit_rows(b.column(1).to_pylist(), table.shape[1]) @ table.T, 6)
            s[np.array(b.column(2).to_pylist(), object)[:, None] != scopes[None, :]] = -np.inf
            at = s.argmax(axis=1) if len(s) else np.empty(0, np.int64)  # the first of equals, and names are in order
            best = s[np.arange(len(s)), at]
            found = pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(at)), pa.array(best)], [id_col, leaf, "similarity"])
            yield found.filter(pa.array(best > -np.inf))

    return run


def drift(assigned: DataFrame, leaf: str, centroid_limit: float = 0.15, outlier_limit: float = 0.20) -> DataFrame:
    g = assigned.groupBy(leaf).agg(F.count("*").alias("n"), F.round(1 - F.avg("similarity"), 6).alias("centroid_drift"), F.round(F.avg((F.col("state") == "outlier").cast("double")), 6).alias("outlier_ratio"))
    return g.withColumn("drifted", (F.col("centroid_drift") > centroid_limit) | (F.col("outlier_ratio") > outlier_limit))


def lineage_overlap(old: DataFrame, new: DataFrame, id_col: str = "id", node: str = "node") -> DataFrame:
    """(old_node, new_node, jaccard) over nodes that share members: joined on members, not node against node."""
    o, n = old.select(id_col, F.col(node).alias("old_node")), new.select(id_col, F.col(node).alias("new_node"))
    both = o.join(n, id_col).groupBy("old_node", "new_node").agg(F.count("*").alias("both"))
    so, sn = o.groupBy("old_node").agg(F.count("*").alias("no")), n.groupBy("new_node").agg(F.count("*").alias("nn"))
    j = both.join(so, "old_node").join(sn, "new_node")
    return j.select("old_node", "new_node", F.round(F.col("both") / (F.col("no") + F.col("nn") - F.col("both")), 6).alias("jaccard"))


def match_lineage(overlap: DataFrame, least: float = 0.3) -> DataFrame:
    """Greedy one-to-one matches by score, then by node."""
    sides = F.concat(F.lit("old:"), F.col("old_node")), F.concat(F.lit("new:"), F.col("new_node"))
    return greedy(overlap.where(F.col("jaccard") >= least), [], sides, [F.desc("jaccard"), F.asc("old_node"), F.asc("new_node")], 1)


def query_node_scores(query_terms: DataFrame, profiles: DataFrame, query: str, node: str) -> DataFrame:
    """0.65 * share of a query's terms in a node's profile + 0.35 * share of the profile's mass they hold."""
    mass = profiles.groupBy(node).agg(F.sum("weight").alias("_m"))
    n = query_terms.groupBy(query).agg(F.countDistinct("term").alias("_q"))
    hit = query_terms.distinct().join(profiles, "term").groupBy(query, node).agg(F.count("*").alias("_c"), F.sum("weight").alias("_w"))
    j = hit.join(mass, node).join(n, query)
    return j.select(query, node, F.round(0.65 * F.col("_c") / F.col("_q") + 0.35 * F.col("_w") / F.col("_m"), 6).alias("score"))


def lineage(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(root, id, depth): chains from each start over (parent, child) edges, breadth first, at most ``depth`` steps."""
    seen = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(edges, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id"), F.lit(d).alias("depth")).distinct()
        front = cut(front.join(seen, ["root", "id"], "left_anti"))
        seen = seen.union(front)
    return seen
