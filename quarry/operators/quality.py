"""Topic quality, evaluation of rankings, ablations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import normalized_entropy
from .temporal import decay

# Weights and thresholds of the scoring formula.
SEVERITY = {"coverage": 0.30, "diversity": 0.15, "freshness": 0.15, "contradiction": 0.25, "uncertainty": 0.15}
DEMAND, GROWTH, HALF_LIFE, DAILY_CAP, GROWTH_CAP, MIN_PRIORITY, LOW = 0.80, 0.20, 90.0, 50.0, 2.0, 0.20, 0.50


def topic_quality(units: DataFrame, demand: DataFrame, contradictions: DataFrame, topic: str, as_of, days: int) -> DataFrame:
    """One row a topic: metrics, severity, importance, priority, eligibility and reasons.

    units (topic, unit, source, at, anchored, confidence), demand (topic, current_n, previous_n), contradictions (topic, pairs).
    """
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 86_400_000_000
    base = units.groupBy(topic).agg(
        F.count("*").alias("n"),
        F.avg(F.col("anchored").cast("double")).alias("coverage"),
        F.when(F.max(F.col("at").isNull()), None).otherwise(F.avg(decay(age, HALF_LIFE))).alias("freshness"),
        F.coalesce(F.avg(F.when(F.col("anchored"), 1 - F.col("confidence"))), F.lit(1.0)).alias("uncertainty"),
    )
    spread = normalized_entropy(units.where("anchored").groupBy(topic, "source").count(), topic, "count")
    d = base.join(spread, topic, "left").join(contradictions, topic, "left").join(demand, topic, "left").fillna(0.0, ["diversity"]).fillna(0, ["pairs"])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    rate = F.when(pairs > 0, F.least(F.lit(1.0), F.col("pairs") / pairs)).otherwise(0.0)
    now, old = F.col("current_n") / days, F.col("previous_n") / days
    d = (
        d.withColumn("contradiction_rate", rate)
        .withColumn("query_demand", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(now) / math.log1p(DAILY_CAP))))
        .withColumn("demand_growth", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (now - old) / F.greatest(old, F.lit(1.0))) / GROWTH_CAP))
    )
    s = SEVERITY
    severity = (
        s["coverage"] * (1 - F.col("coverage")) + s["diversity"] * (1 - F.col("diversity")) + s["freshness"] * (1 - F.col("freshness"))
        + s["contradiction"] * F.col("contradiction_rate") + s["uncertainty"] * F.col("uncertainty")
    )
    d = d.withColumn("severity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), severity))).withColumn("importance", DEMAND * F.col("query_demand") + GROWTH * F.col("demand_growth"))
    d = d.withColumn("priority", F.round(F.col("severity") * F.col("importance"), 12))
    has = F.col("coverage") > 0
    reasons = [
        (F.col("coverage") < 1, "ANCHORED_EVIDENCE_COVERAGE_GAP"), (F.col("diversity") < LOW, "LOW_SOURCE_DIVERSITY"), (F.col("freshness").isNull(), "FRESHNESS_TIMESTAMP_UNAVAILABLE"),
        (F.col("freshness") < LOW, "STALE_EVIDENCE"), (F.col("pairs") > 0, "CONTRADICTION_CANDIDATE"), (F.col("uncertainty") >= LOW, "UNCALIBRATED_UNCERTAINTY_PROXY_HIGH"),
        (F.col("query_demand").isNull(), "QUERY_DEMAND_UNAVAILABLE"), (F.col("query_demand") > 0, "QUERY_DEMAND_PRESENT"), (F.col("demand_growth") > 0, "QUERY_DEMAND_GROWING"),
        (~has, "NO_SUPPORTING_EVIDENCE"), (F.col("priority") < MIN_PRIORITY, "PRIORITY_BELOW_THRESHOLD"),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in reasons]))
    return d.withColumn("eligible", F.coalesce((F.col("priority") >= MIN_PRIORITY) & has, F.lit(False))).withColumn("reasons", F.array_join(codes, ","))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int = 10) -> DataFrame:
    """recall@k, MRR@10 and nDCG@10 (gain 2 ** rel - 1) of each query; ranked (query, item, rank), relevant (query, item, rel)."""
    j = relevant.join(ranked, [query, item], "left")
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rel"), item))
    j = j.withColumn("_i", ideal)
    g = j.groupBy(query).agg(
        F.avg((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("double")).alias("recall"),
        F.coalesce(F.max(F.when(F.col("rank") <= 10, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, gain)), F.lit(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("_i") <= 10, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("_i") + 1.0))).alias("_ideal"),
    )
    return g.select(query, F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round(F.col("_dcg") / F.col("_ideal"), 6).alias("ndcg"))


def ablation(runs: DataFrame, variant: str) -> DataFrame:
    """Mean recall, full hits, stale contamination and evidence per 1000 tokens of each variant."""
    return runs.groupBy(variant).agg(
        F.round(F.avg("recall"), 6).alias("mean_recall"), F.count(F.when(F.col("recall") >= 1, 1)).alias("full_hits"), F.round(F.avg(F.col("stale").cast("double")), 6).alias("stale"),
        F.round(1000 * F.sum("hits") / F.sum("tokens"), 6).alias("density"),
    )
