"""Plumbing that the training-data operators share: the shared folder, staging, ranks, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of most contracts: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where the session names no shared folder (tests, one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            sc.setCheckpointDir(LOCAL_CHECKPOINTS)
        top = sc.getCheckpointDir()
    return f"{top.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def stage(df: DataFrame, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Cut lineage with a written table in the shared folder; lost executors only reread it.

    ``rows``: for large rows, how many a row group holds at most.  Writers buffer a whole group, readers decode up to 4096 rows of one.
    """
    spark = session(df)
    path = shared_dir(spark)
    write = df.write.option("compression", codec)
    (write if rows is None else write.option("parquet.block.row.count.limit", rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of whole long texts stay bounded: few rows, few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def n_partitions(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def smallest(df: DataFrame, n: int, by: str) -> DataFrame:
    """The n rows of the smallest ``_k`` (an md5 text, distinct inside a group) of each group ``by``; df is narrow.

    The n-th key is closed in on two digits at a time: each round counts the rows of the 256 prefixes that go on from the one it
    lies in, so no window sees more than 256 rows a group, however many rows and tasks there are.  Eight digits are
    looked at; rows that share all eight with the n-th one stay as well.
    """
    from pyspark.sql import Window

    rows = stage(df)
    bound = None
    for digits in (2, 4, 6, 8):
        inside = rows.withColumn("_p", F.substring("_k", 1, digits))
        if bound is not None:
            inside = inside.join(F.broadcast(bound), F.col(by).eqNullSafe(F.col("_by")) & (F.substring("_k", 1, digits - 2) == F.col("_last")))
        need = F.lit(n) if bound is None else F.col("_need")
        counts = inside.groupBy(by, "_p", need.alias("_need")).agg(F.count("*").alias("_n"))
        before = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a group
        upto = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < F.col("_need"))
        last = upto.groupBy(F.col(by).alias("_by")).agg(F.max(F.struct("_p", (F.col("_need") - F.col("_before")).alias("need"))).alias("_m"))
        bound = stage(last.select("_by", F.col("_m.need").alias("_need"), F.col("_m._p").alias("_last")))  # one row a group
    few = rows.join(F.broadcast(bound), F.col(by).eqNullSafe(F.col("_by")) & (F.substring("_k", 1, 8) <= F.col("_last")))
    return few.select(*df.columns)


def frequent_from(counts: DataFrame, count: str, most: int) -> int:
    """The least power of two that at most ``most`` rows reach."""
    sizes = dict(counts.groupBy(F.length(F.bin(count)).alias("bits")).count().collect())  # at most 64 rows
    total, bits = 0, 64
    while bits and total + sizes.get(bits, 0) <= most:
        total, bits = total + sizes.get(bits, 0), bits - 1
    return 1 << bits


def word_count(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def global_rank(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Append the gapless 0-based rank of each row under the order of ``keys``.

    One range shuffle: Spark samples the keys, cuts ranges and sorts them; the position inside a
    range comes from monotonically_increasing_id, and only one count per range is summed up.  The
    ranges are fixed by writing the table, so a retried task cannot shift a rank.  Rows that are
    equal in every key are interchangeable; any of them may come first.
    """
    spark = session(df)
    ranged = df.repartitionByRange(n_partitions(spark), *keys).sortWithinPartitions(*keys)
    fixed = stage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", 33)
    counts = fixed.groupBy(pid.alias("_pid")).count()
    from pyspark.sql import Window

    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = counts.select("_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    return (
        fixed.withColumn("_pid", pid)
        .join(offsets, "_pid")
        .withColumn(rank, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_pid", "_off")
    )


def give_back() -> None:
    """Workers live on between tasks: let what a task has freed go back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def with_struct(df: DataFrame, inputs: list[str], name: str, dtype, make) -> DataFrame:
    """All columns of ``df`` and a new one, worked out batch by batch in Arrow.

    ``make()`` runs once in each task and gives a function from the input columns to an Arrow array of
    ``dtype``.  The other columns pass through untouched, whatever they are called.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(session(df))
    at = [df.columns.index(c) for c in inputs]
    kind = to_arrow_type(dtype)

    def run(batches):
        f = make()
        for b in batches:
            new = f(*[b.column(i) for i in at])
            new = new if isinstance(new, pa.Array) else pa.array(new, kind)
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, name])
        del f
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, dtype)]))


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x):
    """A bijection on unsigned 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15


def gram_hashes(words, k: int):
    """64-bit hashes of all runs of k consecutive word hashes (none if there are fewer words)."""
    import numpy as np

    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out + words[j : j + n]) * np.uint64(_ODD)
    return mix64(out)
