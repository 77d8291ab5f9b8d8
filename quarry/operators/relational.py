"""Filters, joins, aggregates, windows and paging of the knowledge store, over any tables with the named columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- filters ----------------------------------------------------------------------------------


def filter_ast(node: dict) -> Column:
    """{op: eq|in|range|exists, field, ...} and {op: and|or|not, args} to a Column, so that scans can push it down."""
    op = node["op"]
    if op in ("and", "or"):
        parts = [filter_ast(x) for x in node["args"]]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":
        return ~filter_ast(node["args"][0])
    c = F.col(node["field"])
    if op == "eq":
        return c == F.lit(node["value"])
    if op == "in":
        return c.isin(list(node["values"]))
    if op == "exists":
        return c.isNotNull()
    if op == "range":
        bounds = {"gte": c.__ge__, "gt": c.__gt__, "lte": c.__le__, "lt": c.__lt__}
        return reduce(lambda a, b: a & b, [bounds[k](F.lit(v)) for k, v in node.items() if k in bounds])
    raise ValueError(f"unknown filter {op!r}")


def tuple_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """(a, b) IN (SELECT a, b ...): a semi-join on all columns."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def after(keys: list[tuple[str, str, object]]) -> Column:
    """Keyset predicate: rows after a cursor in the order given as (column, 'asc'|'desc', value)."""
    out, equal = F.lit(False), F.lit(True)
    for name, way, value in keys:
        c, v = F.col(name), F.lit(value)
        out = out | (equal & ((c > v) if way == "asc" else (c < v)))
        equal = equal & (c == v)
    return out


def keyset_page(df: DataFrame, order: list[tuple[str, str]], cursor: tuple | None, size: int, back: bool = False) -> DataFrame:
    """One page of ``size`` rows after (or, back, before) the cursor, with has_more; rows come in the forward order."""
    flip = {"asc": "desc", "desc": "asc"}
    ways = [(c, flip[w] if back else w) for c, w in order]
    rows = df if cursor is None else df.where(after([(c, w, v) for (c, w), v in zip(ways, cursor, strict=True)]))
    top = rows.orderBy(*[F.col(c).asc() if w == "asc" else F.col(c).desc() for c, w in ways]).limit(size + 1)
    seat = Window.orderBy(*[F.col(c).asc() if w == "asc" else F.col(c).desc() for c, w in ways])  # size + 1 rows
    page = top.withColumn("_seat", F.row_number().over(seat)).withColumn("has_more", F.max("_seat").over(Window.partitionBy()) > size)
    return page.where(F.col("_seat") <= size).drop("_seat")


# ---- joins ------------------------------------------------------------------------------------


def heat(entities: DataFrame, relations: DataFrame, key: str, related: str) -> DataFrame:
    """Left join and count: entities without relations have heat 0.  Counts come first, so the join is one row a key."""
    counts = relations.where(F.col(related).isNotNull()).groupBy(key).agg(F.count("*").alias("heat"))
    return entities.join(counts, key, "left").withColumn("heat", F.coalesce("heat", F.lit(0)))


def dedup_relations(relations: DataFrame, keys: list[str], weight: str, note: str) -> DataFrame:
    """One row for each pair: its largest weight and largest note."""
    return relations.groupBy(*keys).agg(F.max(weight).alias(weight), F.max(note).alias(note))


def range_join(units: DataFrame, blocks: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """blocks.at BETWEEN units.start AND units.end under one key: a hash join on the key with a residual."""
    b = blocks.withColumnRenamed(key, f"_{key}")
    return units.join(b, (F.col(key) == F.col(f"_{key}")) & F.col(at).between(F.col(start), F.col(end))).drop(f"_{key}")


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from < b_to) & (b_from < a_to)


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str, end: str, seconds: int) -> DataFrame:
    """Pairs of one key whose half-open intervals overlap, columns as ``left_<name>`` and ``right_<name>``.

    Time is cut into buckets of ``seconds``; an interval stands in each bucket it touches, and a pair is kept in the bucket where the later
    one starts, so a key with many intervals is dealt over its buckets and distant intervals never meet.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)

    def side(df: DataFrame, name: str) -> DataFrame:
        cols = [F.col(c).alias(f"{name}_{c}") for c in df.columns]
        return df.select(*cols, F.explode(F.sequence(bucket(start), bucket(end))).alias("_bucket")).withColumn("_key", F.col(f"{name}_{key}"))

    both = side(left, "left").join(side(right, "right"), ["_key", "_bucket"])
    later = F.greatest(F.col(f"left_{start}"), F.col(f"right_{start}"))
    on = overlaps(F.col(f"left_{start}"), F.col(f"left_{end}"), F.col(f"right_{start}"), F.col(f"right_{end}"))
    return both.where(on & (F.floor(F.unix_timestamp(later.cast("timestamp")) / seconds) == F.col("_bucket"))).drop("_key", "_bucket")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_cols: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (nulls without one).

    One sort over the union of both sides carries the last right row forward, so rows are linear in the inputs however
    many versions a key has; of right rows at one time the largest by right_cols counts.
    """
    carry = F.struct(*[F.col(c) for c in [right_time, *right_cols]])
    lrow = F.struct(*[F.col(c) for c in left.columns])
    r = right.groupBy(key, right_time).agg(F.max(F.struct(*right_cols)).alias("_m")).select(key, right_time, "_m.*")
    both = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), lrow.alias("_l")).unionByName(
        r.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carry.alias("_r")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in [right_time, *right_cols]])


def bridges(relations: DataFrame, version: str, entity: str) -> DataFrame:
    """(a, b, shared): versions that share entities; an entity counts if at most max(3, min(10, 8 % of the versions)) have it.

    The cap is the operator's own: it bounds an entity's pairs by a constant, whatever the number of versions.
    """
    rel = relations.select(F.col(version).alias("_v"), F.col(entity).alias("_e")).where("_v is not null and _e is not null").distinct()
    n = rel.select("_v").distinct().count()
    cap = max(3, min(10, math.ceil(0.08 * n)))
    few = rel.groupBy("_e").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, cap)).select("_e")
    r = rel.join(few, "_e")
    pairs = r.select("_e", F.col("_v").alias("a")).join(r.select("_e", F.col("_v").alias("b")), "_e").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def two_hops(relations: DataFrame, unit: str, code: str, most: int = 3, decay: float = 0.92) -> DataFrame:
    """(src, dst, score): units two steps apart over codes that at most ``most`` units have; each step costs ``decay``."""
    rel = relations.select(F.col(unit).alias("_u"), F.col(code).alias("_c")).where("_u is not null and _c is not null").distinct()
    r = rel.join(rel.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select("_c"), "_c")
    step = r.select("_c", F.col("_u").alias("src")).join(r.select("_c", F.col("_u").alias("mid")), "_c").where("src <> mid").select("src", "mid").distinct()
    two = step.join(step.select(F.col("src").alias("mid"), F.col("mid").alias("dst")), "mid").where("src <> dst")
    return two.select("src", "dst").distinct().withColumn("score", F.lit(decay * decay))


def valid_at(versions: DataFrame, moment, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return versions.where((F.col(start) <= F.lit(moment)) & (F.lit(moment) < F.col(end)))


# ---- aggregates -------------------------------------------------------------------------------


def time_histogram(events: DataFrame, at: str, n: int) -> DataFrame:
    """Counts in n equal spans between the first and the last time, the last closed on the right; one span if all are equal.

    The bounds come from one aggregate, and only n rows leave the second.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    b = events.select(us.alias("t")).crossJoin(F.broadcast(bounds))  # one row
    span = F.col("hi") - F.col("lo")
    at_bucket = F.when(span == 0, 0).otherwise(F.least(F.floor((F.col("t") - F.col("lo")) * n / span), F.lit(n - 1)))
    counts = b.groupBy(at_bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n_events"))
    every = bounds.select(F.explode(F.sequence(F.lit(0), F.when(F.col("hi") > F.col("lo"), n - 1).otherwise(0))).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def category_topk(df: DataFrame, col: str, k: int, unnamed: str = "未分类") -> DataFrame:
    name = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(unnamed)).alias("category")
    return df.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("category")).limit(k)


def cost_ledger(usage: DataFrame, prices: DataFrame, by: list[str], tokens: list[str]) -> DataFrame:
    """Token sums by ``by`` with all roll-ups, and cost = sum of tokens * rate / 1e6 from a table of rates per model."""
    joined = usage.join(prices, "model", "left")
    cost = reduce(lambda a, b: a + b, [F.coalesce(F.col(t) * F.col(f"{t}_rate"), F.lit(0.0)) for t in tokens]) / 1e6
    sums = [F.sum(t).alias(t) for t in tokens]
    return joined.withColumn("_cost", cost).rollup(*by).agg(*sums, F.round(F.sum("_cost"), 8).alias("cost_usd"))


def normalized_entropy(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Shannon entropy over its largest value for so many kinds; 0 with one kind or none."""
    c = counts.where(F.col(n) > 0).withColumn("_p", F.col(n) / F.sum(n).over(Window.partitionBy(group)))
    h = c.groupBy(group).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("_h"), F.count("*").alias("_k"))
    return h.select(group, F.when(F.col("_k") <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_h") / F.log("_k")))).alias("diversity"))


# ---- windows and order ------------------------------------------------------------------------


def latest(df: DataFrame, key: str | list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int, tie: list[str]) -> DataFrame:
    """Rows by turns from each group: all first ones, then all second ones; ``turn`` says which."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", *tie).limit(limit)


def counted_rank(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(group)
    return df.withColumn("group_size", F.count("*").over(w)).withColumn("rank_in_group", F.row_number().over(w.orderBy(*order)))


def one_hop(relations: DataFrame, seed: DataFrame, via: str, at: str) -> DataFrame:
    """Neighbours that share ``via`` with the seed rows' ``at``, with the number of shared values; the seed itself is left out."""
    shared = relations.join(seed.select(at).distinct(), at, "left_semi").select(via).distinct()
    return relations.join(shared, via, "left_semi").join(seed.select(at).distinct(), at, "left_anti").groupBy(at).agg(F.countDistinct(via).alias("shared"))


def best_per_key(hits: list[DataFrame], key: list[str], score: str) -> DataFrame:
    """Union of several hit lists, the best score of each key."""
    return reduce(DataFrame.unionByName, hits).groupBy(*key).agg(F.max(score).alias(score))


def merge_channels(title: DataFrame, content: DataFrame, key: str, k: int) -> DataFrame:
    """Two channels of scores: title as it is, content * 0.95, the better counts, 0.03 more for both; below max(0.2, 0.55 * best) goes."""
    a = title.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("_a"))
    b = content.select(key, (F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")) * 0.95).alias("_b"))
    both = a.join(b, key, "full_outer")
    best = F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0)))
    s = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.least(F.lit(1.0), best + 0.03)).otherwise(best)
    top = both.select(key, s.alias("score")).orderBy(F.desc("score"), key).limit(k)
    best_of = top.withColumn("_best", F.max("score").over(Window.partitionBy()))  # k rows
    return best_of.where(F.col("score") >= F.greatest(F.lit(0.2), 0.55 * F.col("_best"))).select(key, F.round("score", 6).alias("score"))
