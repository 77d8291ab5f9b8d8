"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Native: DataFrame expressions only.  A document's key is the md5 of seed and id; its first three hex
digits are its bucket, so each source, however hot, is dealt over 4096 buckets of near-equal count.
Sums per (source, bucket) come first (partial aggregation), a running sum over at most 4096 buckets a
source gives every bucket its offset, and only then are rows sorted, bucket by bucket.

Edge cases: a null text counts no words and is never taken; a null source is a source of its own, last in
order; a null doc_id hashes as the text 'null'; repeated rows are rows of their own; with an empty
table the result is empty.  Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, word_count

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def source_targets(per_source: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> and target: weights' shares of the total, no share over cap * source_size.

    Filling by weight until the caps stop it has a closed form: with sources in order of
    cap * size / weight, a source is capped exactly if the level that the rest would share is not below
    that ratio; the level at the first source that is not capped holds for all after it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    top = F.col("source_size").cast("double") * cap
    d = (
        per_source.withColumn("_w", w)
        .withColumn("_top", top)
        .withColumn("_ratio", F.col("_top") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_wall", F.sum("_w").over(whole))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_top").over(fill), F.lit(0.0))) / (F.col("_wall") - F.coalesce(F.sum("_w").over(fill), F.lit(0))))
        .withColumn("_capped", F.col("_level") >= F.col("_ratio"))
        .withColumn("_final", F.max(F.when(~F.col("_capped"), F.col("_level"))).over(whole))
    )
    return d.select("source", "source_size", F.when(F.col("_capped"), F.col("_top")).otherwise(F.col("_final") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, source, epochs.

    ``taken`` are the words that the mix takes of a document, repeats counted: whole epochs over the
    source, then the documents in hash order until the rest of the budget is used; the document at the
    cut gives the part that is left.  A source's taken words sum to its target rounded to an integer.
    Columns named in ``carry`` stay on their rows, and decide the order of rows that are equal otherwise.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = stage(
        docs.select("doc_id", "source", *carry, word_count("text").alias("size"), key.alias("_key")).withColumn("_bucket", F.substring("_key", 1, 3))
    )
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_off"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, cap)
    t = targets.withColumnRenamed("source", "_source")
    plan = offsets.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = plan.withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * cap)
    rest = F.col("_budget") - F.col("epochs") * F.col("source_size") - F.col("_before")
    return (
        rows.withColumn("_before", F.col("_off") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("_budget", budget)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
            "source",
            *carry,
        )
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM src),
f AS (SELECT *, 3.0::DOUBLE * source_size AS top, (3.0::DOUBLE * source_size) / w AS ratio,
             (sum(source_size) OVER ())::DOUBLE AS total, (sum(w) OVER ())::DOUBLE AS wall FROM w),
g AS (SELECT *, (total - coalesce(sum(top) OVER p, 0)) / (wall - coalesce(sum(w) OVER p, 0)::DOUBLE) AS level FROM f
      WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN level >= ratio THEN top
        ELSE (max(CASE WHEN level < ratio THEN level END) OVER ()) * w END AS target FROM g),
b AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS budget FROM t),
r AS (SELECT s.*, source_size, target, budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken, source
FROM r
"""
