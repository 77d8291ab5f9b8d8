"""Composed search: term sequences, multi-hop expansion, routing, decisions, contradictions, feedback pages, index checks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .staging import cut

# Parts of a term sequence's score, weights of anchors and salient terms.
COVERED, COVERED_HEAD, NEAR, NEAR_HEAD = 0.50, 0.22, 0.18, 0.10
ANCHOR, SALIENT = 1.65, 1.45
# When a route is sure of its best child, and how many it follows otherwise.
DECISIVE, BROAD, BEAM = 0.18, 0.72, 3
# Parts of a decision's score.
SLOT, ENTITY, OVERLAP = 0.55, 0.30, 0.25


def term_sequence(sections: DataFrame, id_col: str, text: str, heading: str, terms: list[str], anchors: tuple[str, ...] = (), salient: tuple[str, ...] = ()) -> DataFrame:
    """(id, score): how much of a query's terms a section and its heading hold, by weight, and how close together.

    Weights are frequencies over all sections, larger for anchors, salient terms and digits; they are counted from the written
    hits, so texts are read once.
    """
    spaced = X.spaced(F.col(text)).alias("_t"), X.spaced(F.col(heading)).alias("_h")
    one = sections.select(id_col, *spaced)
    hits = lambda c: F.array(*[X.term_matches(F.lit(t), F.col(c)) for t in terms])
    pairs = list(zip(terms, terms[1:]))
    phrase = " " + " ".join(terms) + " "

    def near(c: str) -> Column:
        each = [X.proximity(F.lit(a), F.lit(b), F.col(c)) for a, b in pairs]
        mean = reduce(lambda x, y: x + y, each) / len(pairs) if pairs else F.lit(0.0)
        return F.when(F.contains(F.col(c), F.lit(phrase)), 1.0).otherwise(mean)

    seen = cut(one.select(id_col, hits("_t").alias("t"), hits("_h").alias("h"), near("_t").alias("nt"), near("_h").alias("nh"), (F.col("_t") == "").alias("blank")))
    counts = seen.agg(F.count("*").alias("n"), *[F.sum(F.col("t")[i].cast("int")).alias(f"c{i}") for i in range(len(terms))]).first()
    weight = []
    for i, t in enumerate(terms):
        df = F.lit(counts[f"c{i}"] or 0)
        special = ANCHOR if t in anchors else SALIENT if t in salient or any(c.isdigit() for c in t) else 1.0
        weight.append((F.log(1 + (F.lit(counts["n"]) - df + 0.5) / (df + 0.5)) + 1) * special)
    total = reduce(lambda x, y: x + y, weight)
    share = lambda c: reduce(lambda x, y: x + y, [F.when(F.col(c)[i], w).otherwise(0.0) for i, w in enumerate(weight)]) / total
    score = COVERED * share("t") + COVERED_HEAD * share("h") + NEAR * F.col("nt") + NEAR_HEAD * F.col("nh")
    return seen.select(id_col, F.when(F.col("blank"), 0.0).otherwise(F.least(F.lit(1.0), score)).alias("score"))


def expand(seeds: DataFrame, hops: Mapping[str, tuple[DataFrame, float]], versions: DataFrame, limit: int) -> DataFrame:
    """(seed, id, kind, score): what the seeds reach over each kind of edge, the best kind of a target, seeds left out.

    seeds (seed, score); hops: kind -> (edges (src, dst), decay); versions (id, version).  Of one version a seed takes at most
    max(2, limit // 4) targets, and ``limit`` in all.
    """
    reached = [
        seeds.join(edges.select(F.col("src").alias("seed"), F.col("dst").alias("id")), "seed").select("seed", "id", F.lit(kind).alias("kind"), (F.col("score") * decay).alias("score"))
        for kind, (edges, decay) in hops.items()
    ]
    every = reduce(DataFrame.unionByName, reached).where("seed <> id").join(seeds.select(F.col("seed").alias("id")), "id", "left_anti")
    best = every.groupBy("seed", "id").agg(F.max(F.struct("score", "kind")).alias("b")).select("seed", "id", "b.kind", "b.score").join(versions, "id")
    seat = F.row_number().over(Window.partitionBy("seed", "version").orderBy(F.desc("score"), "id"))
    few = best.withColumn("_s", seat).where(F.col("_s") <= max(2, limit // 4))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id"))
    return few.withColumn("_p", place).where(F.col("_p") <= limit).select("seed", "id", "kind", "score")


def route(scores: DataFrame, query: str, depth: int) -> DataFrame:
    """(query, leaf, broad): from the root down, the best child where it leads clearly, else the BEAM best.

    scores (query, node, parent, score), parent null for the root's children.  A lead is clear if the shares' margin is DECISIVE
    and their normalised entropy below BROAD.  Every level is one join and one window, for all queries at once.
    """
    w = Window.partitionBy(query, F.col("parent"))
    shares = scores.withColumn("p", F.col("score") / F.sum("score").over(w)).withColumn("n", F.count("*").over(w))
    ranked = shares.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "node")))
    lead = F.max(F.when(F.col("r") == 1, F.col("p"))).over(w) - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))).over(w), F.lit(0.0))
    spread = F.when(F.col("n") > 1, -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)).over(w) / F.log("n")).otherwise(0.0)
    sure = (F.col("n") == 1) | ((F.round(lead, 9) >= DECISIVE) & (F.round(spread, 9) < BROAD))
    steps = cut(ranked.withColumn("sure", sure).where((F.col("r") == 1) | (~F.col("sure") & (F.col("r") <= BEAM))).select(query, "node", "parent", (~F.col("sure")).alias("broad")))
    front = steps.where("parent is null").select(query, F.col("node").alias("leaf"), "broad")
    for _ in range(depth - 1):
        down = steps.where("parent is not null").select(query, F.col("parent").alias("leaf"), "node", F.col("broad").alias("_b"))
        front = front.join(down, [query, "leaf"], "left").select(query, F.coalesce("node", "leaf").alias("leaf"), (F.col("broad") | F.coalesce("_b", F.lit(False))).alias("broad"))
    return front


def decision_score(slot: Column, entity: Column, overlap: Column, status: Column, superseded: Column, mode: str) -> Column:
    """A turn against the ledger of decisions: slot, entities and words that match, then what its state is worth in this mode."""
    base = F.when(slot, SLOT).otherwise(0.0) + F.when(entity, ENTITY).otherwise(0.0) + OVERLAP * overlap
    if mode == "change_lineage":
        out = base + F.when(status.isin("CONFIRMED", "SUPERSEDED", "NEGATED", "OPEN_ISSUE"), 0.40).otherwise(0.0)
    else:
        out = F.when((status == "CONFIRMED") & ~superseded, base + 0.45).when((status == "OPEN_ISSUE") & ~superseded, base + 0.20).when(status.isin("SUPERSEDED", "NEGATED"), 0.0)
        if mode == "current_effective":
            out = out.when(status.isin("PROPOSED", "CONSIDERING"), base * 0.65)
        out = out.otherwise(base)
    return F.when(slot | entity | (overlap > 0), F.greatest(F.lit(0.0), out)).otherwise(0.0)


def contradictions(edges: DataFrame, ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(edge, source, target): knowledge units on both ends of edges whose search units share a partition.

    edges (edge, src, dst); ranges (unit, version, partition, start, end), either end first; blocks (version, ordinal, knowledge).
    A range join on (version, ordinal) names the knowledge units of each search unit; equal ones contradict nothing.
    """
    span = ranges.select("unit", "version", "partition", F.explode(F.sequence(F.least("start", "end"), F.greatest("start", "end"))).alias("ordinal"))
    of = span.join(blocks, ["version", "ordinal"]).select("unit", "partition", "knowledge").distinct()
    side = lambda at, name: of.select(F.col("unit").alias(at), F.col("partition").alias(f"_{at}"), F.col("knowledge").alias(name))
    both = edges.join(side("src", "source"), "src").join(side("dst", "target"), "dst")
    return both.where((F.col("_src") == F.col("_dst")) & (F.col("source") != F.col("target"))).select("edge", "source", "target").distinct()


def feedback_page(feedback: DataFrame, at: str, id_col: str, rating: str, keep: Column, cursor: tuple | None, limit: int) -> DataFrame:
    """One page by (time, id) descending after the cursor, with has_more and the totals of both ratings under the filter."""
    chosen = feedback.where(keep)
    totals = chosen.agg(F.coalesce(F.sum((F.col(rating) == "LIKE").cast("long")), F.lit(0)).alias("likes"), F.coalesce(F.sum((F.col(rating) == "DISLIKE").cast("long")), F.lit(0)).alias("dislikes"))
    if cursor is not None:
        chosen = chosen.where((F.col(at) < cursor[0]) | ((F.col(at) == cursor[0]) & (F.col(id_col) < cursor[1])))
    rows = chosen.orderBy(F.desc(at), F.desc(id_col)).limit(limit + 1)
    seat = rows.withColumn("_s", F.row_number().over(Window.orderBy(F.desc(at), F.desc(id_col)))).withColumn("has_more", F.max("_s").over(Window.partitionBy()) > limit)  # limit + 1 rows
    return seat.where(F.col("_s") <= limit).drop("_s").crossJoin(F.broadcast(totals))  # one row


def verify_index(units: DataFrame, points: DataFrame, id_col: str) -> DataFrame:
    """(expected, found, missing, orphans, ok): whether an index holds exactly the units of its manifest."""
    have = points.select(id_col).distinct().withColumn("_p", F.lit(1))
    both = units.select(id_col).distinct().withColumn("_u", F.lit(1)).join(have, id_col, "full_outer")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = both.agg(n(F.col("_u")).alias("expected"), n(F.col("_p")).alias("found"), n((F.col("_p").isNull()).cast("int")).alias("missing"), n((F.col("_u").isNull()).cast("int")).alias("orphans"))
    return counts.withColumn("ok", (F.col("missing") == 0) & (F.col("orphans") == 0))


def utc(at: Column, zone: str = "UTC") -> Column:
    """A naive time of a zone as an instant."""
    return F.to_utc_timestamp(at.cast("timestamp"), zone)


#: A date as snippets look for it.
DATE = r"20\d{2}(?:年\d{1,2}月\d{1,2}日|[-/]\d{1,2}[-/]\d{1,2})"


def snippet(text: Column, needle: str) -> tuple[Column, Column]:
    """(position from 1 of the best occurrence, 0 if none; the snippet around it, from the last date before it, links as their text).

    The best occurrence has the most Han characters and the fewest links around it; the first of equals.
    """
    import re

    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    count = lambda s, what: (F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))) / len(what)
    parts = F.split(F.lower(text), re.escape(needle.lower()), -1)

    def places(p: Column) -> Column:
        lengths = F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.length(x))
        start = F.expr("CAST(array() AS array<int>)")
        return F.aggregate(lengths, F.struct(F.lit(1).alias("at"), start.alias("all")), lambda a, n: F.struct((a["at"] + n + len(needle)).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")))["all"]

    def quality(at: Column) -> Column:
        lo = F.greatest(F.lit(1), at - 40)
        window = text.substr(lo, at + 700 - lo)
        han = F.length(F.regexp_replace(window, r"[^㐀-鿿]", ""))
        return (han - 40 * count(window, "http") - 15 * count(window, "](")).cast("double")

    best = F.array_max(F.transform(bind(parts, places), lambda at: F.struct(quality(at).alias("q"), (-at).alias("n"))))
    pos = F.coalesce(-best["n"], F.lit(0))

    def cut_out(at: Column) -> Column:
        lo = F.greatest(F.lit(1), at - 500)
        before = F.regexp_extract(text.substr(lo, at - lo), "(?s)^(.*)" + DATE, 1)
        dated = text.substr(lo, at - lo).rlike(DATE)
        start = F.when(dated, lo + F.length(before)).otherwise(F.greatest(F.lit(1), at - 80))
        raw = text.substr(start, at + 700 - start)
        plain = F.regexp_replace(F.regexp_replace(raw, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")
        return F.trim(F.regexp_replace(plain, r"[ \t]+", " "))

    return pos, F.when(pos > 0, bind(pos, cut_out))
