"""Training-data operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, language, line_dedup, mixing, near_dedup, preferences, quality, sharding, tokens, toxicity
from quarry.llm.common import WordHashes, fresh, global_rank, smallest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string"
LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "a", 0, None, None),
    (3, " \t\n ", "en", "a", 4, None, None),
    (4, "one two", "en", "a", 7, None, None),
    (5, "one two", "de", "a", 7, None, None),
    (5, "one two", "de", "a", 7, None, None),
    (6, LONG, "en", "b", 1, None, None),
    (7, LONG + " more", "en", "b", 1, None, None),
    (None, "one two", "en", None, 1, None, None),
    (8, "Ünï 日本語 🙂 <|endoftext|> it's\r\n\r\n done", "fr", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ---- near-dedup -------------------------------------------------------------------------------


def test_near_dedup_against_brute_force(docs):
    want = near_dedup.brute_force(texts(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want


def test_near_dedup_links_that_only_some_members_share(spark):
    rnd = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"z{rnd.random()}"
        rows.append((100 - i, " ".join(w)))
    want = near_dedup.brute_force(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_sql_of_near_dedup_and_decontamination_against_brute_force():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert {a: (b, c) for a, b, c, _ in con.execute(near_dedup.ORACLE).fetchall()} == near_dedup.brute_force(rows)
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert {r[0]: tuple(r[1:5]) for r in con.execute(decontamination.ORACLE).fetchall()} == decontamination.brute_force(rows, items)


def test_near_dedup_in_tiles(spark, monkeypatch):
    """Members of one bucket that no leader links: they meet tile by tile, whatever the number of tiles."""
    rnd = random.Random(11)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for g in range(12):
        own = [w if rnd.random() < 0.85 else f"g{g}x{i}" for i, w in enumerate(base)]
        for _ in range(6):
            w = list(own)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"z{rnd.random()}"
            rows.append((len(rows), " ".join(w[: rnd.randint(50, 60)])))
    want = near_dedup.brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (near_dedup.TILE, 2):
        monkeypatch.setattr(near_dedup, "TILE", tile)
        monkeypatch.setattr(near_dedup, "STAR_ROUNDS", ((0, 1),))  # few stars, so that buckets hold several components
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
        assert got == want


def test_near_dedup_edges(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[1].kept and by[2].component_id == 2 and by[4].n_shingles == 1
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 6
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicates(none).count() == 0


def test_odd_sketch_estimates_similarity():
    s = near_dedup.Signer()
    rnd = np.random.default_rng(1)
    x = np.unique(rnd.integers(0, 1 << 63, 900).astype(np.uint64))
    for share in (0.95, 0.8, 0.6):
        y = np.unique(np.concatenate([x[: int(len(x) * share)], rnd.integers(0, 1 << 63, 50).astype(np.uint64)]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        z = sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(s.sketch(s.minima(x)).view(np.uint64), s.sketch(s.minima(y)).view(np.uint64)))
        assert abs(1 + 1024 / (4 * s.n) * np.log(1 - 2 * z / 1024) - true) < 0.15
        bits = sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(near_dedup.parity(x).view(np.uint64), near_dedup.parity(y).view(np.uint64)))
        assert bits <= len(np.setxor1d(x, y))


# ---- mixing -----------------------------------------------------------------------------------


def test_mixing_budgets(docs, odd, none):
    got = mixing.mix(docs).toPandas()
    g = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), s=("source_size", "first"))
    assert ((g.k - g.t).abs() <= 0.5 + 1e-9).all() and (got.taken <= 3 * got["size"]).all() and abs(g.t.sum() - g.s.sum()) < 1e-3
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(none).count() == 0
    o = mixing.mix(odd).toPandas()
    assert len(o) == len(ODD) and o[o.doc_id == 1]["size"].item() == 0 and o[o.doc_id == 1].taken.item() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30.0 and got[None] == 15.0 and abs(sum(got.values()) - 1115) < 1e-9
    assert got["b"] == 300.0 and got["c"] == 770.0


# ---- sharding ---------------------------------------------------------------------------------


def test_hilbert_curve_walks_by_single_steps(spark):
    d = spark.range(4096).select((F.col("id") % 16).alias("x"), (F.expr("id div 16") % 16).alias("y"), F.expr("id div 256").alias("z"))
    p = d.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 4)).orderBy("h").toPandas()
    assert p.h.tolist() == list(range(4096)) and (p[["x", "y", "z"]].diff().abs().sum(axis=1)[1:] == 1).all()


def test_shards(docs, odd, none):
    p = sharding.hilbert_shards(docs).toPandas()
    assert p.groupby("shard").size().max() - p.groupby("shard").size().min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))
    raw = docs.toPandas().set_index("doc_id").text
    assert all(r.text_crc32 == zlib.crc32(raw[r.doc_id].encode()) and r.size == len(raw[r.doc_id].encode()) + 8 for r in p.itertuples())
    o = sharding.hilbert_shards(odd, 4).toPandas()
    assert len(o) == len(ODD) and o[o.doc_id == 1][["size", "text_crc32"]].values.tolist() == [[8, 0]]
    assert sharding.hilbert_shards(none).count() == 0


def _curve(axes, bits):
    """Index on the Hilbert curve, by walking down the curve's cells with plain integers."""
    x, n = list(axes), len(axes)
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_against_plain_python(docs):
    rows = docs.toPandas()
    code = {c: {v: i * 256 // rows[c].dropna().nunique() for i, v in enumerate(sorted(rows[c].dropna().unique()))} for c in ("source", "lang")}
    seats = []
    for r in rows.itertuples():
        raw = (r.text or "").encode()
        size = len(raw) + 8
        at = _curve([code["source"].get(r.source, 0), code["lang"].get(r.lang, 0), min(255, int(np.log2(size + 1) * 8))], 8)
        seats.append((at, r.doc_id, zlib.crc32(raw), size))
    seats.sort()
    want, slots = {}, {}
    for i, (at, doc_id, crc, size) in enumerate(seats):
        shard = i * 24 // len(seats)
        want[doc_id] = (shard, slots.get(shard, 0), at, crc, size)
        slots[shard] = slots.get(shard, 0) + 1
    got = {r.doc_id: (r.shard, r.slot, r.hilbert, r.text_crc32, r.size) for r in sharding.hilbert_shards(docs).collect()}
    assert got == want


def test_written_shards_can_be_pruned(spark, docs, tmp_path):
    """Each file covers a part of the values only, on every dimension, and reads back whole."""
    sharded = sharding.hilbert_shards(docs)
    sharding.write_shards(sharded, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(map(str, back.select(sorted(sharded.columns)).collect())) == sorted(map(str, sharded.select(sorted(sharded.columns)).collect()))
    p = back.toPandas()
    share = lambda c: p.groupby("shard")[c].nunique().mean() / p[c].nunique()
    assert share("source") < 0.4 and share("lang") < 0.8


def test_shards_of_ties_and_nulls(spark, odd):
    twice = odd.unionByName(odd)
    p = sharding.hilbert_shards(twice, 5).toPandas()
    assert len(p) == 2 * len(ODD) and p.groupby("shard").size().max() - p.groupby("shard").size().min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))


def test_global_rank(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(1000)], "k int, v int")
    p = global_rank(df, ["k", "v"]).toPandas().sort_values("rank")
    assert p["rank"].tolist() == list(range(1000)) and p[["k", "v"]].values.tolist() == sorted([i % 7, i] for i in range(1000))


# ---- quality ----------------------------------------------------------------------------------


def test_quality_features_and_bounds(spark, docs, none):
    known = WordHashes()
    text = "a b c a b c\nx # y\n\nx # y\nzz"
    assert quality.features(text, known)[:5] == (13, 14, 2, 1, 12)
    assert quality.features(None, known)[:5] == (0, 0, 0, 0, 0) and quality.features(" \n ", known)[0] == 0
    w = "p q r s p q r t".split()
    hit = {j for i in range(6) for j in range(i, i + 3) if sum(w[k : k + 3] == w[i : i + 3] for k in range(6)) > 1}
    assert quality.repeated_words(known.of([x.encode() for x in w])) == len(hit)
    for k, n in ((0, 100), (3, 200)):
        u = quality.binomial_upper(k, n, 0.05)
        cdf = sum(np.exp(quality.math.lgamma(n + 1) - quality.math.lgamma(i + 1) - quality.math.lgamma(n - i + 1) + i * np.log(u) + (n - i) * np.log1p(-u)) for i in range(k + 1))
        assert abs(cdf - 0.05) < 1e-6
        assert abs(quality.beta_cdf(1 - u, n - k, k + 1) - 0.05) < 1e-9
        assert quality.within_risk(k, n, u + 1e-9, 0.05) and not quality.within_risk(k, n, u - 1e-9, 0.05)
    assert not quality.within_risk(0, 0, 0.5, 0.5) and quality.within_risk(190_000, 10_000_000, 0.02, 0.01) and not quality.within_risk(200_500, 10_000_000, 0.02, 0.01)
    good, bad = np.zeros(50, int), np.zeros(50, int)
    good[30:], bad[:20] = 50, 10
    assert quality.choose_cutoff(good, bad, 0.02, 0.01) == 20
    assert quality.choose_cutoff(good // 50, bad, 0.02, 0.01) == 0  # too few good texts to vouch for any cutoff
    got = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert len(got) == docs.count() and not (got._base_failed & got._kept).any()
    assert quality.judge(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_quality_verdicts_against_plain_python(spark, docs):
    """Every verdict from the scores alone: holdout tallies, exact tails by summing, a walk for each language."""
    import math

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    alpha, delta = 0.1, 0.4
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels, alpha=alpha, delta=delta).toPandas()
    lab = labels.toPandas()[["doc_id", "quality"]].dropna().drop_duplicates()
    held = got[~got._base_failed].merge(lab, on="doc_id")
    held = held[[zlib.crc32(f"half:{i}".encode()) % 2 == 1 for i in held.doc_id]]
    bucket = lambda x: min(int(x * quality.GRID), quality.GRID - 1)
    strata, cuts = held.lang.nunique(), {}
    for lang, g in held.groupby("lang"):
        good = np.bincount([bucket(x) for x in g._score[g.quality == 1]], minlength=quality.GRID)
        bad = np.bincount([bucket(x) for x in g._score[g.quality == 0]], minlength=quality.GRID)
        n, best, cut, lost, caught = good.sum(), 0.0, 0, 0, 0
        for i in range(quality.GRID - 1):
            lost, caught = lost + good[i], caught + bad[i]
            if lost >= n or sum(math.comb(int(n), j) * alpha**j * (1 - alpha) ** int(n - j) for j in range(lost + 1)) > delta / strata:
                break
            gain = caught / max(1, bad.sum()) - 5 * lost / max(1, n)
            if gain > best + 1e-12:
                best, cut = gain, i + 1
        cuts[lang] = cut
    want = [not f and bucket(x) >= cuts.get(lang, 0) for f, x, lang in zip(got._base_failed, got._score, got.lang, strict=True)]
    assert got._kept.tolist() == want and any(cuts.values())


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, "x"), (7, 0, "x"), (7, 0, "x"), (5, 1, None), (None, 1, None), (4, None, None)], "doc_id long, quality int, lang string")
    got = quality.judge(odd, labels).collect()
    assert len(got) == len(ODD) and not any(r._base_failed and r._kept for r in got) and all(r._kept for r in got if r.doc_id in (6, 7))
    assert len(quality.judge(odd, labels.limit(0)).collect()) == len(ODD)


def test_fresh_names(odd):
    assert fresh(odd, "row") == "_row" and fresh(odd.withColumnRenamed("size", "_ROW").withColumnRenamed("hash", "__row"), "row") == "___row"


def test_smallest(spark):
    df = spark.createDataFrame([(g, f"{zlib.crc32(f'{g}{i}'.encode()):08x}") for g in ("a", None) for i in range(300)], "g string, _k string")
    rows = smallest(df, 7, "g").collect()
    assert sorted((r.g or "", r._k) for r in rows) == [(g or "", k) for g in (None, "a") for k in sorted(f"{zlib.crc32(f'{g}{i}'.encode()):08x}" for i in range(300))[:7]]


def test_quality_counts_against_plain_python(docs):
    import re

    got = {r.doc_id: r._quality for r in quality.measure(docs).collect()}
    for doc_id, t in texts(docs)[:60]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = pd.Series(runs).value_counts().to_dict() if runs else {}
        rep = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 3)}
        q = got[doc_id]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep))


# ---- tokens -----------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_tokenizer())
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "!", "\t", "　", "\x85", "\x1c", "日本", "<|endoftext|>", "\r\n", "x's", "THE", " the", "᠎", "🙂", "​", "I'll", "word,", "ab%%%", "naïve."]
    cases = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["x" * 5000, " ".join(["Ärger"] * 50)]
    for t in cases * 2:
        assert e.encode(t).tolist() == e.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_texts_of_a_batch_equal_the_library_in_few_calls(monkeypatch):
    """Odd texts, nulls and slices among plain ones; the model is asked for many new words at once, and for none twice."""
    e = tokens.Encoder(tokens.default_tokenizer())
    rnd = random.Random(4)
    parts = ["the", "word,", "Ärger", "x1", "it's", "“q”", "a\nb", "naïve.", "(see)", "日本", "<|endoftext|>", "x" * 40, " y", "\x02z", "ÿ", "\n", "\t"]
    texts = [None, "", *(" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(600)), None]
    for a in range(0, len(texts), 100):
        ids, sizes = e.encode_all(pa.array(texts, pa.string())[a : a + 100], 2)
        want = [[*e.library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[a : a + 100]]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert [x.tolist() for x in e.encode_all(pa.array([], pa.string()), 2)] == [[], []]
    calls = []
    monkeypatch.setattr(e.known, "tokenize", lambda text: calls.append(text) or e.bpe.tokenize(text))
    words = ["".join(rnd.choice("abcdefghijé") for _ in range(12)) for _ in range(1000)]
    text = "the " + " ".join(w + rnd.choice(["", ",", "."]) for w in words)
    for _ in range(2):
        assert e.encode_all(pa.array([text] * 3), 2)[0].tolist() == [*e.library.encode(text, add_special_tokens=False).ids, 2] * 3
    assert len(calls) <= 1000 / tokens.AT_ONCE + 1


def test_chunks_of_a_batch_are_those_of_each_text():
    rnd = np.random.default_rng(5)
    sizes = np.array([1, 5000, 127, 128, 129, 9000, 1, 3000, 16])
    ids = rnd.integers(0, 50000, sizes.sum()).astype("<u2")
    assert tokens.cut_texts(ids, sizes) == [tokens.cut_points(x) for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_store_round_trip(spark, odd, none, tmp_path):
    path = f"file://{tmp_path}/store"
    tokens.write_store(odd, path, tokens.default_tokenizer())
    lib = tokens.Encoder(tokens.default_tokenizer()).library
    want = sorted(((r[0] if r[0] is not None else -1), [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ODD)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), list(r.ids)) for r in tokens.read_ids(spark, path).collect())
    assert got == want
    d = sorted(((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_digests(spark, path).collect())
    at = 0
    for (doc_id, ids), row in zip(want, d, strict=True):
        assert row == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.encode_and_verify(none).count() == 0


def test_damage_is_noticed(spark, odd, tmp_path):
    path = f"file://{tmp_path}/store"
    tokens.write_store(odd, path, tokens.default_tokenizer())
    c = spark.read.parquet(f"{path}/store/kind=chunk")
    c.withColumn("n_ids", F.col("n_ids") + 1).write.parquet(f"{path}/bad/kind=chunk")
    import shutil

    shutil.rmtree(f"{tmp_path}/store/store/kind=chunk")
    shutil.move(f"{tmp_path}/store/bad/kind=chunk", f"{tmp_path}/store/store/kind=chunk")
    with pytest.raises(Exception, match="match its name"):
        tokens.read_digests(spark, path).collect()


def test_lost_recipes_are_noticed(spark, odd, tmp_path):
    path = f"file://{tmp_path}/store"
    tokens.write_store(odd, path, tokens.default_tokenizer())
    tokens.verify_manifest(spark, path)
    r = spark.read.parquet(f"{path}/recipes")
    for name, damaged in (("fewer", r.where("doc_id <> 7 or doc_id is null")), ("none", r.limit(0)), ("other", r.withColumn("root", F.when(F.col("doc_id") == 7, F.unhex(F.lit("00"))).otherwise(F.col("root"))))):
        damaged.write.parquet(f"{path}-{name}/recipes")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}-{name}/manifest")
        with pytest.raises(Exception, match="match the manifest"):
            tokens.verify_manifest(spark, f"{path}-{name}")


def test_chunks_are_cut_by_content():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 50000, 20000).astype("<u2")
    y = np.concatenate([rnd.integers(0, 50000, 777).astype("<u2"), x])
    cut = lambda a: {a[i:j].tobytes() for i, j in zip([0, *tokens.cut_points(a)[:-1]], tokens.cut_points(a))}
    assert len(cut(x) & cut(y)) > 0.8 * len(cut(x)) and max(len(c) for c in cut(x)) <= 2 * tokens.MAX_IDS
    assert b"".join(x[i:j].tobytes() for i, j in zip([0, *tokens.cut_points(x)[:-1]], tokens.cut_points(x))) == x.tobytes()


def test_merkle_peaks():
    for n in range(9):
        leaves, p = [bytes([i]) * 32 for i in range(n)], tokens.MerklePeaks()
        for leaf in leaves:
            p.add(leaf)
        assert p.root() == tokens.merkle_root(leaves)


# ---- line dedup -------------------------------------------------------------------------------


def test_line_dedup_against_brute_force(spark, docs, none):
    extra = [
        (10001, "a b c d e f g h i\nx\nA B c d e f g h\n\na b c d e f g h j"),
        (10002, "z b c d e f g h i\nx\na b c d e f g h i i\nq w e r t y u i\nq w e r t y u"),
        (10003, None),
        (10004, ""),
        (10005, LONG + "\n" + LONG.replace("w700 ", "") + "\n" + LONG.replace("w900 ", "k ")),
        (10005, "a b c d e f g h i"),
    ]
    rows = texts(docs)[:80] + extra[:-1]
    got = {(r.doc_id, r.line_no): (r.kept, (r.first_doc, r.first_line)) for r in line_dedup.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == line_dedup.brute_force(rows)
    assert line_dedup.line_verdicts(none).count() == 0
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(extra[:4], "doc_id long, text string")).collect()}
    assert left == {10001: "a b c d e f g h i\nx\n", 10002: "q w e r t y u i\nq w e r t y u", 10003: None, 10004: ""}


def test_line_dedup_of_chains(spark):
    """Each line is one word from the one before: every second one stays, and what goes is near a line that stays."""
    a = "a b c d e f g h i j".split()
    chain = [["X"] * i + a[i:] for i in range(7)]
    lines = [*chain, "p q r".split(), "p q s".split(), "p q r s".split()]
    rows = [(n, " ".join(w)) for n, w in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.first_doc) for r in line_dedup.line_verdicts(docs).collect()}
    assert got == {0: (True, 0), 1: (False, 0), 2: (True, 2), 3: (False, 2), 4: (True, 4), 5: (False, 4), 6: (True, 6), 7: (True, 7), 8: (True, 8), 9: (True, 9)}
    for bound in (3, 4):
        got = {(r.doc_id, r.line_no): (r.kept, (r.first_doc, r.first_line)) for r in line_dedup.line_verdicts(docs, bound).collect()}
        assert got == line_dedup.brute_force(rows, bound)


def test_line_dedup_in_random_neighbourhoods_and_by_sql(spark):
    """Few words and many lines, so that texts have several partners of several rounds."""
    import duckdb

    rnd = random.Random(6)
    base = [[rnd.choice("abc") for _ in range(8)] for _ in range(6)]
    rows = []
    for n in range(220):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice("abc")] * rnd.randint(0, 1)
        rows.append((n, " ".join(w)))
    want = line_dedup.brute_force(rows)
    got = {(r.doc_id, r.line_no): (r.kept, (r.first_doc, r.first_line)) for r in line_dedup.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {(r[0], r[1]): (r[3], (r[4], r[5])) for r in con.execute(line_dedup.ORACLE).fetchall()} == want


def test_line_dedup_of_distinct_texts_under_one_id(spark, odd):
    rows = [(0, "a b c d e f g h X"), (1, "a b c d e f g h i"), (1, "quite other words stand in this line here now"), (5, "same words here"), (5, "same words here")]
    got = [(r.doc_id, r.kept, r.first_doc) for r in line_dedup.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(0, True, 0), (1, False, 0), (1, True, 1), (5, False, 5), (5, True, 5)]
    left = line_dedup.dedup_lines(odd.withColumnRenamed("size", "_copy").withColumnRenamed("hash", "_gone"))
    assert left.count() == len(ODD) and left.columns == [*odd.columns[:5], "_copy", "_gone"]


def test_line_dedup_with_null_and_repeated_ids(spark):
    near, clean = "a b c d e f g h i", [f"clean{n} " + " ".join(f"x{n}y{i}" for i in range(9)) for n in range(4)]
    rows = [(None, near), (None, near[:-1] + "j"), (None, clean[0]), (None, clean[1]), (7, clean[2] + "\nsame"), (7, clean[3]), (8, "other\nsame"), (8, "other\nsame"), (None, "twice"), (None, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = lambda i: [line for t in [rows[i][1]] for line in t.split("\n")]
    got = line_dedup.line_verdicts(docs).collect()
    assert len(got) == sum(len(words(i)) for i in range(len(rows)))
    # clean lines stay, one of the two near copies, and one of each text that repeats
    assert sum(r.kept for r in got) == 4 + 1 + 3
    left = [line for r in line_dedup.dedup_lines(docs).collect() for line in r.text.split("\n") if line]
    assert sorted(line for line in left if not line.startswith("a b")) == sorted([*clean, "same", "other", "twice"]) and len(left) == 8


# ---- decontamination --------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    first = items[0][1].split()
    more = [(9001, "x y " + " ".join(first[2:12]) + " z"), (9002, " ".join(first[2:11])), (9003, "Short ITEM here"), (9004, "a short, item"), (9005, None), (9006, "k " * 400)]
    items += [(500, "short item"), (501, None), (502, "..."), (503, "k " * 30), (500, "z y x w")]
    d = spark.createDataFrame(texts(docs) + more, "doc_id long, text string")
    want = decontamination.brute_force(texts(docs) + more, items)
    x = F.col("_decontamination")
    rows = decontamination.annotate(d, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", x.alias("x")).collect()
    got = {r.doc_id: (r.x.n_words, r.x.n_hit, len(r.x["items"]), __import__("hashlib").sha256(",".join(r.x["items"]).encode()).hexdigest()) for r in rows}
    assert got == want and want[9001][1] == 10 and want[9002][1] == 0 and want[9004][1] == 2


def test_decontamination_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.annotate(odd, bench).count() == len(ODD)
    assert decontamination.annotate(odd, bench.limit(0)).where("_decontamination.n_hit > 0").count() == 0
    assert decontamination.annotate(none, bench).count() == 0


def test_decontamination_ways_agree(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "one two"), (901, " ".join(f"w{i}" for i in range(40, 60))), (None, "x 3 y")], "item_id long, text string"))
    for d in (docs, odd.withColumnRenamed("size", "_items").withColumnRenamed("hash", "_doc"), odd.limit(0)):
        seen = [sorted(map(str, decontamination.annotate(d, bench, most_bytes=most).select("doc_id", "_decontamination").collect())) for most in (decontamination.MOST_BYTES, 0)]
        assert seen[0] == seen[1] and len(seen[0]) == d.count()
    hit = {r.doc_id: r._decontamination.n_hit for r in decontamination.annotate(odd, bench).collect()}
    assert hit[None] == 2 and hit[6] == 20 and hit[1] == 0


def test_winnowing_keeps_every_long_shared_span():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        span = rnd.integers(0, 1 << 62, 10).astype(np.uint64)
        a = np.concatenate([rnd.integers(0, 1 << 62, rnd.integers(0, 20)).astype(np.uint64), span, rnd.integers(0, 1 << 62, 7).astype(np.uint64)])
        b = np.concatenate([rnd.integers(0, 1 << 62, 13).astype(np.uint64), span])
        assert np.isin(decontamination.window_minima(a), decontamination.window_minima(b)).any()
        assert set(decontamination.winnow(a)[0].tolist()) >= set(decontamination.window_minima(a).tolist())


# ---- toxicity ---------------------------------------------------------------------------------


def _insults():
    rnd = random.Random(7)
    syll = ["er", "on", "the", "tion", "an", "re", "is", "ed", "at", "en"]
    plain = lambda: " ".join("".join(rnd.choice(syll) for _ in range(rnd.randint(1, 3))) for _ in range(60))
    good = [plain() for _ in range(120)]
    bad = [plain() + " " + rnd.choice(["idiot", "moron", "scumbag"]) + " " + plain() for _ in range(120)]
    return good, bad, plain


def test_toxicity_tolerates_gaps_and_insertions(spark, none):
    good, bad, plain = _insults()
    m = toxicity.fit(good + bad, [False] * 120 + [True] * 120)
    score = lambda t: m.score(m.units(sorted(toxicity.units_of(t))))
    assert max(map(score, [plain() for _ in range(30)])) < 0.5
    for word in ("idiot", "Idiot!", "i.d.i.o.t", "i d i o t", "idioot", "moron", "mor*on", "scumbag"):
        assert score(plain() + f" {word} " + plain()) >= 0.5, word
    assert 0 <= score("") <= 1 and 0 <= score("日本語") < 0.5
    rows = toxicity.annotate(spark.createDataFrame(ODD, SCHEMA), m).collect()
    assert len(rows) == len(ODD) and all(0 <= r._toxicity <= 1 for r in rows) and toxicity.annotate(none, m).count() == 0
    blank = toxicity.fit(good, [False] * 120)
    assert blank.score(blank.units(["idiot"])) < 0.5 and toxicity.fit([], []).score(np.empty(0)) < 0.5


def test_kernel_against_its_definition():
    def plain(a, b):
        def features(u):
            out, u = {}, toxicity.MARK + u
            for i in range(len(u)):
                for j in range(i + 1, len(u)):
                    for k in range(j + 1, len(u)):
                        if k - i < toxicity.SPAN:
                            out[u[i] + u[j] + u[k]] = out.get(u[i] + u[j] + u[k], 0) + toxicity.DECAY ** (k - i + 1)
            return out

        dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
        x, y = features(a), features(b)
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    for a, b in (("idiot", "idiot"), ("idiot", "idxiot"), ("idiot", "scumbag"), ("banana", "bandana"), ("aaaaaaa", "aaa")):
        assert abs(toxicity.kernel(a, b) - plain(a, b)) < 1e-9
    assert toxicity.kernel("idiot", "idxiot") > 0.4 > toxicity.kernel("idiot", "patio")
    near = toxicity.Nystroem(["idiot", "moron", "clown", "table"]).features(["idiot", "moron", "clown", "table"])[:, :-1].astype(float)
    for i, a in enumerate(("idiot", "moron", "clown", "table")):
        for j, b in enumerate(("idiot", "moron", "clown", "table")):
            assert abs(near[i] @ near[j] - toxicity.kernel(a, b)) < 1e-3


def test_toxicity_sample_and_training_with_odd_rows(spark, none):
    good, bad, plain = _insults()
    rows = [(i, t, 0) for i, t in enumerate(good)] + [(1000 + i, t, 1) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1001, "another text")] * 40 + [(None, "idiot")] * 5 + [(2000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(1001, 0, "y"), (None, 1, None), (7, None, None), (2000, 0, None)], "doc_id long, toxic int, text string")
    sample = toxicity.labelled_sample(docs, labels)
    learnt = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5] + [i for i in (2000,) if zlib.crc32(str(i).encode()) % 5]
    assert len(sample) == len(learnt) and len(toxicity.labelled_sample(docs, labels, most=9)) == 18
    assert sum(len(t.encode()) for t, _ in toxicity.labelled_sample(docs, labels, most_bytes=20_000)) <= 20_000
    m = toxicity.train(docs, labels)
    assert m.score(m.units(["idiot"])) > 0.5 > m.score(m.units(sorted(toxicity.units_of(plain()))))
    assert toxicity.train(none, labels.limit(0)).score(np.empty(0)) < 0.5


def test_toxicity_held_out():
    sf = "/root/testdata/sf0.1"
    d = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in d.doc_id])
    m = toxicity.fit(d.text[~held].tolist(), (d.toxic[~held] == 1).tolist())
    got = np.array([m.score(m.units(sorted(toxicity.units_of(t)))) >= 0.5 for t in d.text[held]])
    truth = (d.toxic[held] == 1).values
    assert (got == truth).mean() > 0.97 and (got & truth).sum() / truth.sum() > 0.85


# ---- preferences ------------------------------------------------------------------------------


CONVERSATIONS = "conv_id long, turn long, role string, text string, side string, pos int"


def _plain_preferences(rows):
    """The two rules and the formatting by hand: pair_id -> (chosen_id, rejected_id, n, prompt, chosen, rejected, spans of both)."""
    import hashlib

    talks = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is None, turn or 0, role or "user", text or ""))
    talks = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in talks.items()}
    show = lambda t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    pairs, alone, groups = [], [], {}
    for c in sorted(talks):
        groups.setdefault(talks[c][0], []).append(c)
    for g in groups.values():
        pairs += [(a, b, talks[a], talks[b]) for a, b in zip(g[::2], g[1::2])]
        alone += g[len(g) // 2 * 2 :]
    last = {c: max((i for i, t in enumerate(talks[c]) if t[0] == "assistant"), default=0) for c in alone}
    order = sorted((c for c in alone if last[c] > 0), key=lambda c: (hashlib.md5(str(c).encode()).hexdigest(), c))
    for i, c in enumerate(order):
        d, n = order[(i + 1) % len(order)], last[c]
        pairs.append((c, d, talks[c][: n + 1], [*talks[c][:n], talks[d][last[d]]]))
    out = {}
    for a, b, x, y in pairs:
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        if n and (x[n:] or y[n:]):
            spans = []
            for tail in (x[n:], y[n:]):
                at, own = len(show(x[:n])), []
                for t in tail:
                    own += [(at + len("<|im_start|>assistant\n"), at + len(show([t])))] if t[0] == "assistant" else []
                    at += len(show([t]))
                spans.append(own)
            out[a] = (a, b, n, show(x[:n]), show(x[n:]), show(y[n:]), *spans)
    return out


def _preferences(df):
    rows = preferences.preferences(df).collect()
    spans = lambda s: [(x.start, x.end) for x in s]
    out = {r.pair_id: (r.chosen_id, r.rejected_id, r.n_prompt_turns, r.prompt, r.chosen, r.rejected, spans(r.chosen_spans), spans(r.rejected_spans)) for r in rows}
    assert len(out) == len(rows)
    return out


def test_preferences_against_plain_python(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = _preferences(table)
    assert got == _plain_preferences([tuple(r) for r in table.collect()]) and got
    long = " ".join(["word"] * 50_000)
    rows = [(c, t, r, x, "s", 1) for c, turns in {
        1: [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")],
        2: [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "no")],
        3: [("user", "hi")],
        4: [("user", "equal"), ("assistant", "twins")],
        5: [("user", "equal"), ("assistant", "twins")],
        6: [("system", "s"), ("assistant", "a"), (None, None)],
        7: [(None, None), ("assistant", long), ("user", "thanks")],
        8: [("assistant", "no turn before it")],
        9: [("user", "nobody answers")],
        10: [("user", "q"), ("assistant", None)],
        11: [("user", "prefix"), ("assistant", "x"), ("user", "y")],
        12: [("user", "prefix"), ("assistant", "x")],
    }.items() for t, (r, x) in enumerate(turns)]
    rows += [(10, 1, "assistant", "repeated turn", None, None), (10, None, "user", "last", None, None), (None, 0, "user", "x", None, None)]
    got = _preferences(spark.createDataFrame(rows, CONVERSATIONS))
    assert got == _plain_preferences(rows) and {1, 6, 7, 10, 11} <= set(got) and not {4, 5, 8, 9} & set(got)
    assert got[11][4] and not got[11][5]
    assert preferences.preferences(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_given_pairs(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", "a"), (3, 0, "user", "other")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 3)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: (r.n_prompt_turns, r.chosen, r.rejected) for r in preferences.preferences(turns, pairs).collect()}
    assert got[7] == (2, "", "") and got[8][0] == 0 and got[8][2] == "<|im_start|>user\nother<|im_end|>\n"


# ---- language ---------------------------------------------------------------------------------


def test_language_held_out_and_edges(spark, docs, odd, none):
    m = language.train(docs)
    p = language.annotate(docs.select("doc_id", "text", "lang").where(language.held_out()), m).toPandas()
    assert np.mean([x["lang"] == y for x, y in zip(p._language, p.lang)]) > 0.95
    by = {r.doc_id: r._language for r in language.annotate(odd, m).collect()}
    assert by[1].lang == by[2].lang == by[3].lang == "und" and by[8].lang in set(m.langs)
    assert m.predict("12 34 !")[0] == "und" and m.predict("日本語")[2]
    empty = language.train(none)
    assert empty.predict("text") == ("und", 0.0, True) and language.annotate(none, m).count() == 0


def test_language_against_plain_nearest_centroids(spark, docs):
    m = language.train(docs)
    for r in language.annotate(docs.select("doc_id", "text"), m).limit(60).collect():
        x = language.counts(r.text)
        v = np.log1p(x) * m.idf
        cos = [float(v @ c) / float(np.linalg.norm(v)) for c in m.centroids]
        assert r._language.lang == m.langs[int(np.argmax(cos))] and abs(r._language.score - max(cos)) < 1e-4 and r._language.rejected == (r._language.score < m.floors[int(np.argmax(cos))])


def test_language_sample_of_repeated_and_null_ids(spark):
    rows = [(i, f"plain words of text number {i} here", "en") for i in range(40)] + [(3, f"other text {i}", "en") for i in range(30)] + [(None, "null", "en")] * 9 + [(50, "texte sans langue", None), (51, "12 34", "fr")]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(F.col("lang").isNotNull() & ~language.held_out())
    got = language.sample_counts(learn)
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40)) and {g for g, _ in got} == {"en"}


# ---- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_against_plain_runs(spark):
    import corpus_pipeline as c
    from quarry.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, step in c.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(step(spark, kept, SF))
        after = [(r.doc_id, r.text) for r in kept.collect()]
        assert kept.columns == columns and {i for i, _ in after} <= set(before)
        if name == "near_dedup":
            want = near_dedup.brute_force(list(before.items()))
            assert sorted(i for i, _ in after) == sorted(i for i in before if want[i][1] == i)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = decontamination.brute_force(list(before.items()), items)
            assert sorted(i for i, _ in after) == sorted(i for i in before if want[i][1] == 0)
        if name == "mixing":
            taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(spark.createDataFrame(list(before.items()), "doc_id long, text string").join(docs.select("doc_id", "source"), "doc_id")).collect() if r.taken}
            assert pd.Series([i for i, _ in after]).value_counts().to_dict() == taken
    out = c.STAGES[-1][1](spark, kept, SF).toPandas().sort_values("start")
    lib = tokens.Encoder(tokens.default_tokenizer()).library
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    at = 0
    for (doc_id, text), r in zip(rows, out.itertuples(), strict=True):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline as c

    text = lambda n, k=60: " ".join(f"w{n}x{i}" for i in range(k))
    rows = [(None, text(1), "a"), (None, text(1), "a"), (None, text(2), "a"), (5, text(3), "a"), (5, text(4), "a"), (6, text(4), "a"), (3, text(5), "a"), (None, text(5), "a"), (9, text(6), "a"), (9, text(6), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id or 0), r.text.split()[0]) for r in c.drop_near_duplicates(spark, docs, SF).collect())
    assert got == [(0, "w1x0"), (0, "w2x0"), (3, "w5x0"), (5, "w3x0"), (5, "w4x0"), (9, "w6x0")]
    # a mix takes each row as often as its own words are taken
    rows = [(None, text(n, 10 * (n + 1)), s) for n in range(6) for s in ("a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sum(-(-r.taken // r.size) for r in mixing.mix(docs).collect() if r.taken)
    mixed = c.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() == want
    totals = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    size = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert all(totals[s] - 1 <= size[s] < totals[s] + 60 for s in totals)


def test_pipeline_with_odd_rows_and_clashing_names(spark, odd, none):
    import corpus_pipeline as c

    def named(df):
        for old, new in (("size", "_row"), ("hash", "_copies"), ("n_chars", "taken")):
            df = df.withColumnRenamed(old, new)
        return df.withColumns({n: F.lit("z") for n in ("_toxicity", "_decontamination", "_copy", "size", "_id", "_gone", "_doc", "_seat", "component_id", "kept")})

    for rows in (named(odd), named(none)):
        kept = rows
        for name, step in c.STAGES[:-1]:
            kept = step(spark, kept, SF)
            assert kept.columns == rows.columns, name
        out = c.STAGES[-1][1](spark, kept, SF)
        assert out.count() == kept.count()
