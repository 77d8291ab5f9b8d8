"""Writers that replace whole partitions: runs of canonical blocks behind commit marks, upserts of vectors into buckets.

A run's rows go to a partition of their own, overwritten as a whole, and count once its mark stands.  A run that failed leaves the
marks, and so what readers see, as they were; a run that is repeated overwrites its own rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import cut
from .sinks import _fs


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def commits(spark: SparkSession, root: str) -> dict[str, dict]:
    """The marks of all runs that are complete: run -> order, rows, versions."""
    fs, at = _fs(spark, f"{root}/commits")
    if not fs.exists(at):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    marks = {}
    for n in names:
        if n.endswith(".json") and not n.startswith(("_", ".")):
            text = spark.read.text(f"{root}/commits/{n}", wholetext=True).collect()
            if text:
                marks[n.removesuffix(".json")] = json.loads(text[0][0])
    return marks


def write_blocks(blocks: DataFrame, root: str, run: str, version: str = "version") -> int:
    """Persist a run's blocks; returns its number of rows.  Its versions replace those of earlier runs when the mark is set."""
    spark = blocks.sparkSession
    done = commits(spark, root)
    order = done[run]["order"] if run in done else 1 + max((m["order"] for m in done.values()), default=0)
    _overwrite(blocks.withColumn("run", F.lit(run)), f"{root}/blocks", "run")
    written = spark.read.parquet(f"{root}/blocks").where(F.col("run") == run)
    rows = written.count()
    fs, at = _fs(spark, f"{root}/commits/{run}.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"order": order, "rows": rows}).encode()))
    out.close()
    return rows


def read_blocks(spark: SparkSession, root: str, version: str = "version") -> DataFrame:
    """Of each version the blocks of the last complete run that has it."""
    marks = commits(spark, root)
    if not marks:
        raise FileNotFoundError(f"no run of {root} is complete")
    rows = spark.read.parquet(f"{root}/blocks").where(F.col("run").cast("string").isin(list(marks)))
    order = spark.createDataFrame([(r, m["order"]) for r, m in marks.items()], "run string, _order int")
    rows = rows.withColumn("run", F.col("run").cast("string"))
    last = rows.select(version, "run").distinct().join(F.broadcast(order), "run").groupBy(version).agg(F.max_by("run", "_order").alias("run"))
    return rows.join(last, [version, "run"])


def upsert_vectors(points: DataFrame, root: str, dim: int, buckets: int = 64) -> DataFrame:
    """Put points (id, vec, payload) into a table in buckets by id; returns the counts of what was inserted, updated and payload only.

    A point without a vector gets zeros and ``has_vector`` false, or keeps the vector it has; one with a vector replaces both.  Of an
    id that comes twice the row with a vector counts, then the largest payload.  Only buckets that get points are written again.
    """
    spark = points.sparkSession
    wrong = points.where(F.col("vec").isNotNull() & (F.size("vec") != dim)).limit(1).count()
    if wrong:
        raise ValueError(f"vectors must have {dim} coordinates")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("vec").isNull(), F.desc("payload")))
    new = cut(points.withColumn("_n", best).where("_n = 1").select("id", "vec", "payload", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")))
    zeros = F.array_repeat(F.lit(0.0), dim)
    fs, at = _fs(spark, f"{root}/points")
    kind = points.schema["id"].dataType.simpleString()
    schema = f"id {kind}, vec array<double>, payload {points.schema['payload'].dataType.simpleString()}, has_vector boolean, bucket int"
    old = spark.read.schema(schema).parquet(f"{root}/points") if fs.exists(at) else spark.createDataFrame([], schema)
    old = old.join(new.select("bucket").distinct(), "bucket", "left_semi")
    both = old.select("id", F.struct("vec", "payload", "has_vector").alias("_o"), "bucket").join(new.select("id", F.struct("vec", "payload").alias("_c"), F.col("bucket").alias("_b")), "id", "full_outer")
    has = F.col("_c.vec").isNotNull() | F.coalesce("_o.has_vector", F.lit(False))
    vec = F.coalesce(F.col("_c.vec").cast("array<double>"), F.col("_o.vec"), zeros)
    state = F.when(F.col("_c").isNull(), "kept").when(F.col("_o").isNull(), F.when(F.col("_c.vec").isNull(), "payload_only").otherwise("inserted")).otherwise("updated")
    merged = cut(both.select("id", vec.alias("vec"), F.when(F.col("_c").isNotNull(), F.col("_c.payload")).otherwise(F.col("_o.payload")).alias("payload"), has.alias("has_vector"), F.coalesce("bucket", "_b").alias("bucket"), state.alias("_state")))
    _overwrite(merged.drop("_state"), f"{root}/points", "bucket")
    n = lambda s: F.coalesce(F.sum((F.col("_state") == s).cast("long")), F.lit(0)).alias(s)
    return merged.agg(n("inserted"), n("updated"), n("payload_only"))
