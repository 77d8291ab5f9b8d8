"""Writers: insert-once, versioned publishing behind a pointer, orphan removal, package export."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


KEEP = 8  # pointers of the past that stay


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/pointers")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _point(spark: SparkSession, root: str, slot: str, rows: int, seen: list[int]) -> None:
    """Add a pointer under the number after those ``seen`` before the version was written; the largest number counts.

    The file is created without overwriting, which a store does for one of two writers only.  Until its text is there, and for good if
    its writer dies, readers pass over it and take the pointer before.
    """
    n = seen[-1] + 1 if seen else 1
    fs, at = _fs(spark, f"{root}/pointers/{n:012d}.json")
    if _pointers(spark, root) != seen:
        raise RuntimeError(f"version {n} of {root} was published by another writer")
    text = bytearray(json.dumps({"slot": slot, "rows": rows}).encode())
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise RuntimeError(f"version {n} of {root} was published by another writer") from e
    out.write(text)
    out.close()


def insert_once(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one for each key: what an append may write."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def split_orphans(points: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(points that have a row, points that have none)."""
    return points.join(rows, key, "left_semi"), points.join(rows, key, "left_anti")


def register_upload(uploads: DataFrame, versions: DataFrame, key: str, digest: str) -> DataFrame:
    """Uploads with the version they get: the latest one's number if the content is unchanged, else the next."""
    last = versions.groupBy(key).agg(F.max_by(digest, "version_no").alias("_d"), F.max("version_no").alias("_v"))
    j = uploads.join(last, key, "left")
    same = F.col(digest) == F.col("_d")
    number = F.when(same, F.col("_v")).otherwise(F.coalesce("_v", F.lit(0)) + 1)
    return j.withColumn("version_no", number).withColumn("reused", F.coalesce(same, F.lit(False))).drop("_d", "_v")


def publish(df: DataFrame, root: str, expected_rows: int | None = None) -> str:
    """Write a version into a folder of its own, count it, then point at it; readers see the old version or the new one.

    No folder is ever written twice, so neither a second publisher nor a reader of an old version meets foreign files: of two
    publishers at once, one gets the number, and the other's folder is removed and its call fails.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{root}/{version}"
    try:
        seen = _pointers(spark, root)
        df.write.parquet(folder)
        n = spark.read.parquet(folder).count()
        if expected_rows is not None and n != expected_rows:
            raise ValueError(f"the version has {n} rows, {expected_rows} were expected; the pointer stays")
        _point(spark, root, version, n, seen)
    except Exception:
        fs, at = _fs(spark, folder)
        fs.delete(at, True)
        raise
    _sweep(spark, root)
    return version


def _sweep(spark: SparkSession, root: str) -> None:
    """Remove the folders that only pointers beyond the last KEEP named."""
    old = _pointers(spark, root)
    named = {_slot(spark, root, n) for n in old[-KEEP:]}
    for n in old[:-KEEP]:
        version = _slot(spark, root, n)
        if version and version not in named:
            fs, at = _fs(spark, f"{root}/{version}")
            fs.delete(at, True)
        fs, _ = _fs(spark, root)
        fs.delete(_fs(spark, f"{root}/pointers/{n:012d}.json")[1], False)


def _slot(spark: SparkSession, root: str, number: int) -> str | None:
    """The folder that a pointer names; None while its text isn't there."""
    rows = spark.read.text(f"{root}/pointers/{number:012d}.json", wholetext=True).collect()
    try:
        return json.loads(rows[0][0])["slot"]
    except (IndexError, ValueError):
        return None


def current_version(spark: SparkSession, root: str) -> str | None:
    return next((v for n in reversed(_pointers(spark, root)) if (v := _slot(spark, root, n))), None)


def read_published(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{version}")


def rollback(spark: SparkSession, root: str) -> str:
    """Point again at the version before the live one."""
    numbers = _pointers(spark, root)
    live = current_version(spark, root)
    before = next((v for n in reversed(numbers) if (v := _slot(spark, root, n)) not in (live, None)), None)
    if before is None:
        raise FileNotFoundError(f"{root} has no earlier version")
    _point(spark, root, before, spark.read.parquet(f"{root}/{before}").count(), numbers)
    return before


def export_package(tables: dict[str, DataFrame], path: str) -> None:
    """JSON Lines in order of id.  Fails if an event has no entity or a relation names a missing one."""
    events, entities, rel = tables["events"], tables["entities"], tables["event_entities"]
    lonely = events.join(rel, events["id"] == rel["event_id"], "left_anti").limit(1).count()
    broken = rel.join(entities, rel["entity_id"] == entities["id"], "left_anti").limit(1).count()
    if lonely or broken:
        raise ValueError("an event has no entity" if lonely else "a relation names an entity that is missing")
    for name, df in tables.items():
        df.orderBy(*df.columns[:2]).write.mode("overwrite").json(f"{path}/{name}.jsonl")
