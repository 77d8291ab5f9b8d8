"""Near-duplicate groups: banded MinHash candidates, odd sketches to sort them, full shingle sets to confirm.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes), BANDS x ROWS MinHash values, and an
   odd sketch: every (number, value) of the MinHash sample flips one of 1024 bits, so that the population
   count of two sketches' XOR tells the size of the samples' symmetric difference.
2. Texts with equal sets are one representative.  Representatives that share a band are candidates.
   Each is first held against one leader of its bucket (a star, not all pairs), a few bands at a time;
   components come from the links that full sets confirm.  Members of a bucket that are still in different
   components are then held against each other, so that no candidate pair between two components is left
   untested.  Pairs inside a component could not change the result and are never formed.
3. A pair goes to the full sets only if sizes allow the similarity and the sketch's estimate is not
   below the threshold by more than MARGIN (over six standard errors).

A pair at the threshold shares no band with probability (1 - 0.75**5)**40 = 2e-5, any closer pair with less.

Edge cases: texts without words (null, empty, blank) have empty sets and are linked with nothing; shorter
texts are one shingle; doc_ids are meant to be unique: rows that share one get a row each, grouped by their own texts, and
groups may meet in such an id (the pipeline numbers its rows first); rows with a null doc_id are left out of the groups, with
a null component_id, and kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, drop_folder, give_back, gram_hashes, mix64, shared_dir, small_batches, stage, table

SHINGLE, SIMILARITY = 5, 75  # words; per cent
BANDS, ROWS = 40, 5
STAR_ROUNDS = ((0, 3), (3, 10), (10, BANDS))
SKETCH_BITS, MARGIN = 1024, 0.18
_LONGS, _PARITY = SKETCH_BITS // 64, 32
TILE = 256  # members of a bucket that one task holds against the others


def shingle_set(text: str | None, known: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; bytes.lower() and bytes.split() are ASCII only."""
    words = known.of(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(k, len(words))))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


class Signer:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.n = bands, rows, bands * rows
        self.mul, self.add = (x[:, None] for x in _constants(self.n))
        self.number = np.arange(self.n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.band_no = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        self.work = np.empty((self.n, 256), np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(self.n, ~np.uint64(0))
        for i in range(0, len(s), 256):
            part = s[i : i + 256]
            w = self.work[:, : len(part)]
            np.multiply(self.mul, part[None, :], out=w)
            np.add(w, self.add, out=w)
            np.minimum(low, w.min(axis=1), out=low)
        return mix64(low)

    def keys(self, low: np.ndarray) -> np.ndarray:
        out = self.band_no.copy()
        for r in range(self.rows):
            out = mix64(out ^ low[r :: self.rows]) + np.uint64(r + 1)
        return out.view(np.int64)

    def sketch(self, low: np.ndarray) -> np.ndarray:
        at = (mix64(low ^ self.number) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)


_SIGNED = "doc_id {id}, n_shingles long, set_lo long, set_hi long, bands array<bigint>, sketch array<bigint>"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> size and 128-bit hash of the set, band keys, odd sketch."""
    small_batches(docs.sparkSession)

    def run(batches):
        known, sign = WordHashes(), Signer()
        none = np.empty(0, np.int64)
        for b in batches:
            sizes, lo, hi, keys, sketches = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, known)
                sizes.append(len(s))
                lo.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                hi.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                low = sign.minima(s) if len(s) else None
                keys.append(none if low is None else sign.keys(low))
                sketches.append(none if low is None else sign.sketch(low))
            yield pa.record_batch(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), _lists(keys), _lists(sketches)],
                ["doc_id", "n_shingles", "set_lo", "set_hi", "bands", "sketch"],
            )
        del known
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def may_link(a: str, b: str, n: int = BANDS * ROWS) -> Column:
    """Whether sizes and odd sketches (columns <side>_n, <side>_s0...) leave the similarity possible."""
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    differ = sum((F.bit_count(F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}"))) for i in range(1, _LONGS)), F.bit_count(F.col(f"{a}_s0").bitwiseXOR(F.col(f"{b}_s0"))))
    return (100 * small >= SIMILARITY * large) & (differ <= F.lit(most_bits(n)))


def most_bits(n: int) -> int:
    """Differing bits at which the estimate 1 + bits / (4 n) * ln(1 - 2 z / bits) falls to the threshold less MARGIN."""
    least = SIMILARITY / 100 - MARGIN
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * n * (1 - least) / SKETCH_BITS)))


def parity(s: np.ndarray) -> np.ndarray:
    """Odd sketch of a whole set.  Two sets differ in at least as many elements as their sketches do in bits."""
    at = (mix64(s ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * _PARITY)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * _PARITY) & 1).astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, set, parity) of the named representatives: size, sorted shingle hashes, and the odd sketch of the whole set.

    The ids grow with the corpus, so both sides are shuffled at any size, never one of them broadcast.
    """

    def run(batches):
        known = WordHashes()
        for b in batches:
            sets = [shingle_set(t, known) for t in b.column(1).to_pylist()]
            yield pa.record_batch(
                [b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), _lists([parity(x) for x in sets])],
                ["id", "n", "set", "parity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("id"), "text").join(ids.hint("shuffle_merge"), "id", "left_semi").mapInArrow(run, f"id {kind}, n long, set binary, parity array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return stage(both.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (id, root): the smallest id reachable, for every id that isn't its own root.

    Alternating large and small stars (Kiveris et al. 2014): each step is a minimum by node, which combines
    before the shuffle, and a join back; no node's neighbours are ever gathered.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    print_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(e)
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        e = stage(small.distinct())
        now = print_of(e)
        if now == before:
            return e.withColumnsRenamed({"u": "id", "v": "root"})
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    spark, key = docs.sparkSession, ["set_lo", "set_hi", "n_shingles"]
    path = shared_dir(spark)
    signatures(docs).write.parquet(path)
    signed = spark.read.parquet(path)
    kept = stage(signed.select("doc_id", *key))
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stage(sets.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    drop_folder(spark, path)
    digest = reps.select("rep", F.col("n_shingles").alias("n"), *[F.element_at("sketch", i + 1).alias(f"s{i}") for i in range(_LONGS)])
    side = lambda p: digest.select(F.col("rep").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in digest.columns[1:]])

    in_band = reps.select(F.col("rep").alias("x"), F.posexplode("bands").alias("no", "band"))
    shared = in_band.groupBy("band").agg(F.min("x").alias("leader"), F.count("*").alias("k")).where("k > 1")
    buckets = stage(in_band.join(shared.select("band", "leader"), "band"))
    shingles = stage(_sets(docs, buckets.select(F.col("x").alias("id")).distinct()))

    # a few bands first: they bring most of a large group together, and later bands pass over what is together
    roots = links = tested = None
    for first, last in STAR_ROUNDS:
        star = buckets.where((F.col("no") >= first) & (F.col("no") < last) & (F.col("x") != F.col("leader"))).select(F.col("x").alias("a"), F.col("leader").alias("b"))
        star = _apart(star, roots).distinct()
        star = star if tested is None else star.join(tested, ["a", "b"], "left_anti")
        star = stage(star.join(side("a"), "a").join(side("b"), "b").where(may_link("a", "b")).select("a", "b"))
        found = confirm(star, shingles)
        links = found if links is None else links.union(found)
        tested = star if tested is None else tested.union(star)
        roots = components(links)
    rest = stage(_between(buckets, roots, shingles).join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        roots = components(links.union(confirm(rest, shingles)))
    of_set = reps.select(*key, "rep").join(roots, F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("root", "rep").alias("component"))
    out = kept.join(of_set, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs whose ends aren't known to be in one component."""
    if roots is None:
        return pairs
    of = lambda p: roots.select(F.col("id").alias(p), F.col("root").alias(f"{p}_root"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _between(buckets: DataFrame, roots: DataFrame, shingles: DataFrame) -> DataFrame:
    """Distinct pairs (a > b) of a bucket whose components differ and whose sets may reach the similarity.

    Members meet only where their sizes allow the similarity, tile by tile.  Sets x, y reach it only if they differ in at most (100 - SIMILARITY) / (100 + SIMILARITY) of |x| + |y| elements, and
    they differ in no fewer than their odd sketches do in bits, so this filter loses nothing.
    """
    of = buckets.join(roots, F.col("x") == F.col("id"), "left").select("band", "x", F.coalesce("root", "x").alias("root"))
    mixed = of.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo <> hi")
    mixed = mixed.select("band", F.ceil(F.col("k") / TILE).cast("int").alias("tiles"))
    sketch = [F.element_at("parity", i + 1).alias(f"p{i}") for i in range(_PARITY)]
    open_ = of.join(mixed, "band").join(shingles.select(F.col("id").alias("x"), "n", *sketch), "x")
    # sizes by powers of 100 / SIMILARITY: a pair's levels are equal or neighbours
    open_ = open_.withColumn("level", F.floor(F.log("n") / F.log(F.lit(100 / SIMILARITY))))
    own = ["x", "root", "n", *[f"p{i}" for i in range(_PARITY)]]
    one = lambda d, p: d.select("band", "at", "tile", *[F.col(c).alias(f"{p}_{c}") for c in own])
    # a bucket's members are dealt over its tiles once, and sent to each of them once: no task holds a whole hot bucket's pairs
    dealt = one(open_.withColumnsRenamed({"level": "at"}).withColumn("tile", F.pmod(F.xxhash64("x"), F.col("tiles")).cast("int")), "a")
    sent = one(open_.withColumn("at", F.explode(F.array("level", F.col("level") - 1))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))), "b")
    differ = F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0")))
    for i in range(1, _PARITY):
        differ = differ + F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}")))
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_x") < F.col("b_x")))
    near = (100 * F.col("a_n") >= SIMILARITY * F.col("b_n")) & ((100 + SIMILARITY) * differ <= (100 - SIMILARITY) * (F.col("a_n") + F.col("b_n")))
    pairs = dealt.join(sent, ["band", "at", "tile"]).where(smaller & (F.col("a_root") != F.col("b_root")) & near)
    return pairs.select(F.greatest("a_x", "b_x").alias("a"), F.least("a_x", "b_x").alias("b")).distinct()


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Plain DuckDB SQL for the same rows: every two sets that share a shingle are counted out.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
x AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s),
g AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM x),
e AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT rep AS a, rep AS b FROM x UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, coalesce(c.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN x ON x.s = s.s LEFT JOIN c ON c.a = x.rep
"""


def brute_force(docs: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component_id) by comparing every pair of sets, for tests."""
    sets = {}
    for doc_id, text in docs:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= SIMILARITY * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}
