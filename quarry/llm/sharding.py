"""Sharding along a Hilbert curve, so that files can be pruned on several columns at once.  Native.

Each metadata column is quantised to ``bits`` bits with its order kept, the cell's index on the Hilbert
curve is worked out with bit operations inside one fold, rows are put in order of that index by a range
shuffle, and the order is cut into runs.  A hot cell (one source, one language) is no hot task:
the ranges are cut on (index, doc_id).

Edge cases: a null or empty text has 0 bytes, size 8 and crc 0; a null column value falls in cell 0;
equal rows may swap their slots; an empty table gives an empty result.  Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, stage, table

BITS, SHARDS = 8, 24


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index of a cell on the Hilbert curve through len(axes) dimensions of ``bits`` bits (below 63 bits in all).

    The published transposition (Skilling 2004) in three folds: undo the rotations from the highest bit
    down, Gray-code the axes, interleave their bits.
    """
    n = len(axes)
    start = F.array(*[a.cast("long") for a in axes])
    bits_down = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    dims = F.array(*[F.lit(i) for i in range(n)])

    def turn(x: Column, q: Column, i: Column) -> Column:
        first, here, low = x[0], F.get(x, i), q - 1
        t = first.bitwiseXOR(here).bitwiseAND(low)
        flip = here.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((j == 0) & (i == 0), v).when((j == 0) | (j == i), v.bitwiseXOR(t)).otherwise(v)
            ),
        )

    turned = F.aggregate(bits_down, start, lambda x, q: F.aggregate(dims, x, lambda y, i: turn(y, q, i)))

    def finish(x: Column) -> Column:
        gray = [x[0]]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(x[i]))
        last = gray[-1]
        t = F.aggregate(bits_down, F.lit(0).cast("long"), lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return F.array(*[g.bitwiseXOR(t) for g in gray])

    def weave(x: Column) -> Column:
        places = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(b).alias("bit")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(
            places, F.lit(0).cast("long"), lambda acc, p: acc * 2 + F.call_function("shiftright", F.get(x, p["axis"]), p["bit"]).bitwiseAND(F.lit(1))
        )

    # transform over a one-element array binds a value to a name once, instead of copying its expression
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bind(bind(turned, finish), weave)


def ordinal_codes(df: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """(col, code): the values' ranks scaled to 2**bits cells; null is left out (cell 0 by the caller)."""
    values = global_rank(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], "_rank")
    n = values.count()
    return values.select(F.col(col).alias(f"_v_{col}"), F.floor(F.col("_rank") * (1 << bits) / F.lit(max(1, n))).cast("long").alias(f"_c_{col}"))


def log_code(col: Column, bits: int = BITS) -> Column:
    """Lengths by eighth powers of two: 8 cells an octave, 32 octaves in 8 bits."""
    code = F.floor(F.log2(F.greatest(col, F.lit(0)).cast("double") + 1) * ((1 << bits) / 32))
    return F.least(F.coalesce(code, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def hilbert_shards(docs: DataFrame, n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(doc_id, text, lang, source) -> doc_id, size, text_crc32, shard, slot, hilbert, lang, source.

    Dimensions are source, language and the text's bytes.  Counts of the shards are at most one apart.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    base = stage(docs.select("doc_id", "lang", "source", (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32")))
    d = base
    for col in ("source", "lang"):
        codes = ordinal_codes(base, col, bits)
        d = d.join(codes, F.col(col) == F.col(f"_v_{col}"), "left").withColumn(f"_c_{col}", F.coalesce(f"_c_{col}", F.lit(0))).drop(f"_v_{col}")
    d = d.withColumn("_c_size", log_code(F.col("size"), bits))
    d = d.withColumn("hilbert", hilbert_index([F.col("_c_source"), F.col("_c_lang"), F.col("_c_size")], bits)).drop("_c_source", "_c_lang", "_c_size")
    n = base.count()
    ranked = global_rank(d, ["hilbert", "doc_id", "text_crc32", "size"])
    shard = F.expr(f"rank * {n_shards}L div {max(1, n)}L")
    first = F.expr(f"(shard * {max(1, n)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).withColumn("shard", F.col("shard").cast("int")).drop("rank")


def write_shards(sharded: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """One folder a shard, rows in curve order, so that each file's column bounds cover one run of the curve."""
    sharded.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
