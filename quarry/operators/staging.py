"""Tables written to the shared folder, where lineage ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    A local session that names none gets one below /tmp; on a cluster that is an error, since executors would not share it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            sc.setCheckpointDir("/tmp/checkpoints")
        top = sc.getCheckpointDir()
    return f"{top.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: a lost executor then costs a read."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(spark: SparkSession, n: int, column: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a table in n buckets of a column.

    Inside, such tables and rows dealt by repartition(n, column) meet without another shuffle, on further keys as well.  The tables'
    names end with the block: what leaves it has to be cut.
    """
    names: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        path = _folder(spark)
        names.append(f"quarry_{path.rpartition('-')[2]}")
        df.repartition(n, column).write.bucketBy(n, column).option("path", path).format("parquet").saveAsTable(names[-1])
        return spark.table(names[-1])

    asked = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(asked)
    spark.conf.set(asked, "false")
    try:
        yield put
    finally:
        spark.conf.set(asked, before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def range_rank(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Append the gapless 1-based place of each row under the order of ``keys``: ranges are sorted, and only their counts are summed up."""
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, "_part").withColumn(rank, F.col("_base") + F.col("_at") + 1).drop("_part", "_mid", "_at", "_base")


#: Rows of one group that a single task may sort.
HOT = 100_000


def place_in_group(df: DataFrame, group: str, keys: list[str], place: str) -> DataFrame:
    """Append the 1-based place of each row inside its group.

    Groups of up to HOT rows are sorted each in its task; the others, counted first, are dealt over as many tasks as their rows
    need by a range shuffle.  Both ways give the same places.
    """
    rows = cut(df)
    seat = F.row_number().over(Window.partitionBy(group).orderBy(*keys)).cast("long")
    hot = cut(rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("_group"))
    if hot.isEmpty():
        return rows.withColumn(place, seat)
    on = F.col(group).eqNullSafe(F.col("_group"))
    ranked = cut(range_rank(rows.join(hot, on, "left_semi"), [group, *keys], "_rank"))
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_first"))
    large = ranked.join(first, on).withColumn(place, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first", "_group")
    return rows.join(hot, on, "left_anti").withColumn(place, seat).unionByName(large)
