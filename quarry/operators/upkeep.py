"""Upkeep of a routing tree between full builds: new units go to leaves, drift is counted over runs, only drifted subtrees are rebuilt.

The tree is a table of members (part, subtree, leaf, id, vec), written by partition and subtree; a subtree is what stands below one child
of a partition's root.  A run reads the leaves' centroids, gives each new unit its nearest leaf in its partition, and rewrites
the folders of subtrees that got units, nothing else (dynamic partition overwrite).  A leaf that drifts in two runs in a row makes its
subtree dirty, and a dirty subtree's units, old and new, are partitioned anew.  ``update`` takes one delta; as the function of
foreachBatch it takes a stream of them, and repeating a batch changes nothing.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tree as T
from .graph import assign
from .staging import cut

# How far a centroid may move, how many new units may be outliers, and for how many runs.
CENTROID_LIMIT, OUTLIER_LIMIT, RUNS = 0.15, 0.20, 2


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _centroids(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, centre, n): the mean of unit vectors of length 1, coordinate by coordinate."""
    each = members.select(*keys, F.posexplode("vec").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    mean = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    return mean.join(members.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))


def _cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 1e-12, dot(a, b) / size).otherwise(0.0)


def _write(members: DataFrame, root: str) -> None:
    rows = members.select("id", "vec", "leaf", "part", "subtree")
    rows.repartition("part", "subtree").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "subtree").parquet(f"{root}/members")


def _read(spark: SparkSession, root: str, vec_type: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"id {id_type}, vec {vec_type}, leaf string, part string, subtree string").parquet(f"{root}/members")


def create(units: DataFrame, edges: DataFrame, root: str, leaf: int = T.LEAF, children: int = T.CHILDREN, least: int = T.LEAST) -> None:
    """Build the tree of units (id, part, vec) and write its members."""
    nodes, members = T.build(units.select("id", "part"), edges, leaf, children, least=least)
    top = F.col("parent").startswith("root/")
    above = nodes.where("parent is not null").select("node", "parent")
    of = nodes.where("height = 0").select(F.col("node").alias("leaf"), F.col("node").alias("subtree"))
    while True:  # climb until every leaf has reached a child of the root
        up = of.join(above.where(~top).withColumnsRenamed({"node": "subtree", "parent": "_up"}), "subtree", "left")
        moved = cut(up.select("leaf", F.coalesce("_up", "subtree").alias("subtree"), F.col("_up").isNotNull().alias("_m")))
        of = moved.drop("_m")
        if moved.where("_m").isEmpty():
            break
    named = F.regexp_replace("subtree", "/", "-")
    _write(members.join(of, "leaf").join(units, "id").select("id", "vec", "leaf", F.col("part").cast("string").alias("part"), named.alias("subtree")), root)


def place(delta: DataFrame, members: DataFrame) -> DataFrame:
    """(id, part, vec, leaf, subtree, similarity, state): the nearest leaf of a unit's partition, by centroid; ties to the smaller name."""
    name = F.concat_ws("\x1f", "part", "subtree", "leaf")
    centres = cut(_centroids(members, "part", "subtree", "leaf").withColumn("_leaf", name))
    near = assign(delta.select("id", "vec", "part"), centres, "id", "vec", "_leaf", "centre", "part")
    return delta.join(near, "id").join(centres.select("_leaf", "leaf", "subtree"), "_leaf").select("id", "part", "vec", "leaf", "subtree", "similarity", "state")


def drift(members: DataFrame, placed: DataFrame, counts: DataFrame | None, leaf: int = T.LEAF) -> DataFrame:
    """(part, subtree, leaf, centroid_drift, outlier_ratio, overflow, violations, drifted) of the leaves that got units.

    A leaf violates its limits if its centroid moved, too many of its new units are outliers, or it is over capacity; violations count
    runs in a row, and RUNS of them are a drift.
    """
    keys = ["part", "subtree", "leaf"]
    touched = members.join(placed.select(*keys).distinct(), keys, "left_semi")
    old = _centroids(touched, *keys).withColumnsRenamed({"centre": "_old", "n": "_n"})
    new = _centroids(touched.select(*keys, "vec").unionByName(placed.select(*keys, "vec")), *keys)
    out = placed.groupBy(*keys).agg(F.avg((F.col("state") == "outlier").cast("double")).alias("outlier_ratio"))
    d = new.join(old, keys).join(out, keys).withColumn("centroid_drift", F.round(1 - _cosine(F.col("centre"), F.col("_old")), 9)).withColumn("overflow", F.col("n") > leaf)
    bad = (F.col("centroid_drift") > CENTROID_LIMIT) | (F.col("outlier_ratio") > OUTLIER_LIMIT) | F.col("overflow")
    before = F.lit(0)
    if counts is not None:
        d, before = d.join(counts.select(*keys, F.col("violations").alias("_v")), keys, "left"), F.coalesce("_v", F.lit(0))
    d = d.withColumn("violations", F.when(bad, before + 1).otherwise(0).cast("int"))
    return d.select(*keys, "centroid_drift", F.round("outlier_ratio", 9).alias("outlier_ratio"), "overflow", "violations", (F.col("violations") >= RUNS).alias("drifted"))


def rebuild(units: DataFrame, edges: DataFrame, leaf: int = T.LEAF, resolution: float = T.RESOLUTION, least: int = T.LEAST) -> DataFrame:
    """(id, leaf) of units (id, part): the leaves of dirty subtrees anew; ``part`` tells subtrees apart, and no leaf spans two."""
    nodes = cut(units.select("id", "part", F.lit(1).cast("long").alias("size")))
    labels = T.communities(nodes, T.both_ways(edges, nodes), leaf, resolution, least)
    return labels.select("id", F.concat(F.lit("0/"), F.col("group").cast("string")).alias("leaf"))


def update(delta: DataFrame, edges: DataFrame, root: str, batch: int, leaf: int = T.LEAF, least: int = T.LEAST) -> DataFrame:
    """Take one delta (id, part, vec) into the tree below ``root``; returns its drift report.

    Counters are written under the number of the batch and read from the last batch before it, units that are there already are
    left out, and a rewritten folder appears whole, so a batch that failed half way can be run again.
    """
    spark = delta.sparkSession
    delta = delta.withColumn("part", F.col("part").cast("string"))
    members = cut(_read(spark, root, delta.schema["vec"].dataType.simpleString(), delta.schema["id"].dataType.simpleString()))
    placed = cut(place(delta.dropDuplicates(["id"]).join(members.select("id"), "id", "left_anti"), members))
    counts = None
    if batch > 0 and _exists(spark, f"{root}/drift"):
        past = spark.read.parquet(f"{root}/drift").where(F.col("batch") < batch)
        last = F.row_number().over(Window.partitionBy("part", "subtree", "leaf").orderBy(F.desc("batch")))
        counts = past.withColumn("_n", last).where("_n = 1")
    report = cut(drift(members, placed, counts, leaf))
    dirty = report.where("drifted").select("part", "subtree").distinct()
    grown = placed.select("part", "subtree").distinct()
    touched = cut(members.join(grown, ["part", "subtree"], "left_semi").unionByName(placed.select(*members.columns)))
    stale = cut(touched.join(dirty, ["part", "subtree"], "left_semi"))
    rows = touched
    if not stale.isEmpty():
        fresh = rebuild(stale.select("id", F.concat_ws("/", "part", "subtree").alias("part")), edges, leaf, least=least)
        anew = stale.drop("leaf").join(fresh, "id")
        rows = touched.join(dirty, ["part", "subtree"], "left_anti").unionByName(anew.select(*touched.columns))
    _write(rows, root)
    report.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/drift")
    return report


def follow(deltas: DataFrame, edges: DataFrame, root: str, checkpoint: str, leaf: int = T.LEAF):
    """Start a stream of deltas into the tree; each micro-batch is one update."""
    take = lambda df, batch: None if df.isEmpty() else update(df, edges, root, batch + 1, leaf) and None
    return deltas.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
