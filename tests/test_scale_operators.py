"""Operators that work in rounds, blocks or ranges, against plain one-pass versions; wording signals and turn states as facts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, graph, memory, relational, retrieval, search, similarity, staging


def plain_walk(rows, most, inside):
    degree, own, kept = {}, {}, []
    for part, a, b, weight, same in sorted(set(rows), key=lambda r: (-r[3], r[1], r[2], r[4])):
        ends = [(part, a), (part, b)]
        if all(degree.get(e, 0) < most for e in ends) and not (same and any(own.get(e, 0) >= inside for e in ends)):
            kept.append((part, a, b, weight, same))
            for e in ends:
                degree[e] = degree.get(e, 0) + 1
                own[e] = own.get(e, 0) + same
    return sorted(kept)


@pytest.mark.parametrize("seed,most", [(1, 2), (2, 3), (3, 4)])
def test_rounds_take_what_a_walk_takes(spark, seed, most):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(2), rnd.randrange(12), 100 + rnd.randrange(12), rnd.randrange(5) / 4, rnd.random() < 0.5) for _ in range(120)]
    rows += [(0, 1, 200 + i, 0.5, False) for i in range(60)]  # a hot node
    df = spark.createDataFrame(rows, "part int, a int, b int, weight double, same_doc boolean")
    got = sorted(tuple(r) for r in graph.cap_degree(df, "part", most).select("part", "a", "b", "weight", "same_doc").collect())
    assert got == plain_walk(rows, most, max(1, most // 2))
    assert graph.cap_degree(df.limit(0), "part", most).count() == 0


def test_lineage_is_matched_one_to_one(spark):
    rnd = random.Random(4)
    rows = [(o, n, rnd.randrange(1, 11) / 10) for o in range(8) for n in range(8) if rnd.random() < 0.6]
    old, new, want = set(), set(), []
    for o, n, j in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if j >= 0.3 and o not in old and n not in new:
            want.append((o, n, j))
            old.add(o)
            new.add(n)
    got = graph.match_lineage(spark.createDataFrame(rows, "old_node int, new_node int, jaccard double")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("hot", [staging.HOT, 70, 0])
def test_places_in_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(staging, "HOT", hot)
    rows = [(None if i % 5 == 0 else i % 3, i * 7 % 101) for i in range(300)]
    got = staging.place_in_group(spark.createDataFrame(rows, "g int, v int"), "g", ["v"], "place").collect()
    for g in (None, 0, 1, 2):
        own = sorted((r.place, r.v) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for x, v in rows if x == g)


@pytest.mark.parametrize("block", [retrieval.BLOCK_BYTES, 300])
def test_dense_search_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
    rnd = np.random.default_rng(1)
    v = rnd.integers(-3, 4, (60, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [0.0] * 4), (62, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in retrieval.vector_topk(df.where("id % 20 = 0"), df, "id", "id", "v", 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 6))
    unit = lambda x: np.zeros(4) if x is None or len(x) != 4 else np.array(x) / max(np.linalg.norm(x), 1e-12)
    for q in (0, 20, 40):
        each = sorted((-round((unit(rows[q][1]) @ unit(x) + 1) / 2, 6), i) for i, x in rows if i != q and x is not None)
        assert [got[q][n + 1] for n in range(5)] == [(i, -s) for s, i in each[:5]]


@pytest.mark.parametrize("block", [retrieval.BLOCK_BYTES, 100])
def test_sparse_search_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
    rnd = random.Random(2)
    words = "the of a lorem ipsum dolor sit amet rare".split()
    docs = [(i, " ".join(rnd.choices(words, weights=[9, 8, 7, 3, 3, 2, 2, 1, 1], k=rnd.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "The OF")]
    queries = [(1, "the rare"), (2, "amet, amet!"), (3, "unseen"), (4, None), (5, "of lorem the dolor")]
    tokens = {i: (t or "").lower().split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / sum(t is not None for _, t in docs)
    want = {}
    for q, text in queries:
        scores = []
        for i, w in tokens.items():
            s = 0.0
            for term in set((text or "").lower().replace(",", "").replace("!", "").split()):
                df = sum(term in x for x in tokens.values())
                if term in w:
                    tf = w.count(term)
                    s += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
            if s > 0:
                scores.append((-round(s, 6), i))
        want[q] = [(i, -s) for s, i in sorted(scores)[:4]]
    found = {}
    for r in retrieval.bm25_search(spark.createDataFrame(docs, "id long, t string"), "id", "t", spark.createDataFrame(queries, "q long, t string"), "q", "t", 4).collect():
        found.setdefault(r.q, {})[r["rank"]] = (r.id, round(r.score, 6))
    for q, rows in want.items():
        assert [i for i, _ in rows] == [found[q][n + 1][0] for n in range(len(rows))] if rows else q not in found
        assert all(abs(found[q][n + 1][1] - s) < 2e-6 for n, (_, s) in enumerate(rows))


def test_nearest_leaf_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    v, leaves = rnd.normal(size=(40, 3)), rnd.normal(size=(7, 3))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    n = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(leaves)], "leaf int, l array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.round(unit(v) @ unit(leaves).T, 6)
    for size in (graph.BLOCK_BYTES, 100):
        monkeypatch.setattr(graph, "BLOCK_BYTES", size)
        got = {r.id: (r.leaf, r.similarity) for r in graph.assign(d, n, "id", "v", "leaf", "l").collect()}
        assert got == {i: (int(want[i].argmax()), float(want[i].max())) for i in range(40)}


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(i, i % 3, s, s + rnd.randint(1, 200)) for i in range(60) for s in [rnd.randint(0, 900)]]
    df = spark.createDataFrame(rows, "id int, k int, s int, e int").select("id", "k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    got = sorted((r.left_id, r.right_id) for r in relational.overlap_join(df, df, "k", "s", "e", 60).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])


def test_wording_signals():
    t = lambda s: s.lower().replace(".", " .").split()
    quantity, polarity, life = range(3)
    for a, b, signal in (
        ("limit is 25 MiB", "limit is 10 MiB", quantity),
        ("keep 5 mb", "keep 5 gb", quantity),
        ("users are allowed", "users are not allowed", polarity),
        ("allow uploads", "deny uploads", polarity),
        ("the feature is enabled", "the feature is disabled", polarity),
        ("token is valid", "token is invalid", polarity),
        ("the rule stands", "the rule stands deprecated", life),
    ):
        assert similarity.diff_signals(t(a), t(b))[signal], (a, b)
    for a, b in (("the cache is not enabled", "the cache is disabled"), ("5 minutes", "5 min"), ("it is never optional here", "it is never optional here today"), ("", "not")):
        assert not any(similarity.diff_signals(t(a), t(b))), (a, b)


def test_turn_states(spark):
    facts = {
        "we decided to use postgres": "CONFIRMED",
        "we have not decided to use postgres": "FACT",
        "we might have agreed on it": "FACT",
        "dropped mongo, but we chose postgres": "CONFIRMED",
        "finalized, not really": "CONFIRMED",
        "finalized not yet": "FACT",
        "chưa chốt dùng Mongo": "CONSIDERING",
        "Chốt dùng Postgres nhé": "CONFIRMED",
        "did we decide? we chose postgres?": "FACT",
        "we dropped kafka": "NEGATED",
        "considering two options": "CONSIDERING",
        "I propose nats": "PROPOSED",
        "there is a blocker": "OPEN_ISSUE",
        "": "FACT",
    }
    df = spark.createDataFrame([(t,) for t in facts] + [(None,)], "t string")
    got = {r.t: r.s for r in df.select("t", memory.epistemic_state(F.col("t")).alias("s")).collect()}
    assert {k: got[k] for k in facts} == facts
    slots = {r.t: r.s for r in df.select("t", memory.topic_slot(F.col("t")).alias("s")).collect()}
    assert slots["we dropped kafka"] == "slot:messaging_queue" and slots["we decided to use postgres"] == "slot:database" and slots["I propose nats"] == "slot:messaging_queue"


def test_python_workers_get_few_rows_and_bytes_at_once(spark):
    from quarry.catalog import Tables

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    Tables(spark, "unused")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    short = spark.range(3000).coalesce(1).mapInArrow(sizes, "rows long, bytes long").collect()
    long = spark.range(300).coalesce(1).select(F.repeat(F.lit("x"), 100_000)).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in short) == 3000 and max(r.rows for r in short) <= 512
    assert sum(r.rows for r in long) == 300 and max(r.bytes for r in long) < 6 << 20


def test_topic_slots_bound_words_as_the_sql_does(spark):
    import duckdb

    from quarry.catalog import ORACLES

    texts = ["que queueó la", "ñqueue", "xqueue", "queue_", "QUEUE", "hàng\u000bđợi", "hàng  Đợi", "hàng\u00a0đợi", "đdb", "dbé", "mongo\u017f", "\u212a8s", "\u212aafka", "redi\u017f cache", "CI/CD", ""]
    df = pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "text": texts})
    con = duckdb.connect()
    con.register("conversations", df)
    want = {r[0]: r[2] for r in con.execute(ORACLES["topic_slots"]).fetchall()}
    got = {r.conv_id: r.s for r in spark.createDataFrame(df).select("conv_id", memory.topic_slot(F.col("text")).alias("s")).collect()}
    assert got == want and want[0] == want[1] == "slot:messaging_queue"


def test_sentences_keep_decimals(spark):
    text = "It costs 1.5 or v2.10.3 now. Really?! Yes\nnext line... end"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(chunking.sentences(F.col("t")).alias("s")).collect()
    assert list(got[0].s) == ["It costs 1.5 or v2.10.3 now.", "Really?!", "Yes", "next line...", "end"] and list(got[1].s) == []


def test_snippets_choose_the_best_occurrence(spark):
    text = "key http://a http://b " + "x" * 800 + " on 2024-03-05 the [key](http://c) 汉字汉字 key " + "y" * 900
    pos, part = search.snippet(F.col("t"), "KEY")
    r = spark.createDataFrame([(text,), ("nothing",), (None,)], "t string").select("t", pos.alias("pos"), part.alias("part")).collect()
    assert r[0].part.startswith("2024-03-05 the key 汉字") and r[0].pos > 800 and (r[1].pos, r[1].part) == (0, None) and r[2].part is None


def test_routes(spark):
    rows = [(1, "a", None, 0.9), (1, "b", None, 0.1), (1, "a1", "a", 0.4), (1, "a2", "a", 0.4), (1, "a3", "a", 0.4), (1, "a4", "a", 0.3), (1, "b1", "b", 1.0), (2, "a", None, 1.0), (2, "a1", "a", 0.5)]
    got = search.route(spark.createDataFrame(rows, "q int, node string, parent string, score double"), "q", 2).collect()
    assert sorted((r.q, r.leaf, r.broad) for r in got) == [(1, "a1", True), (1, "a2", True), (1, "a3", True), (2, "a1", False)]


def test_expansion_is_capped_by_version(spark):
    seeds = spark.createDataFrame([(1, 1.0)], "seed int, score double")
    edges = spark.createDataFrame([(1, i) for i in range(1, 30)], "src int, dst int")
    versions = spark.createDataFrame([(i, i // 10) for i in range(1, 30)], "id int, version int")
    got = search.expand(seeds, {"near": (edges, 0.9), "far": (edges, 0.5)}, versions, 8).collect()
    assert sorted(r.id for r in got) == [2, 3, 10, 11, 20, 21] and {r.kind for r in got} == {"near"}


def test_near_duplicates_sign_only_texts_that_may_match(spark, monkeypatch):
    """Copies are one text and long texts without common shingles get no signature; the matches are those of all pairs."""
    import random

    from quarry.operators import similarity as M

    rnd = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    long = [" ".join(rnd.choices(words, k=rnd.randint(120, 200))) for _ in range(30)]
    texts = [*long, None, "", *[long[0]] * 6, long[1] + " more", long[1] + " more!", long[1].upper(), long[2][:160], "a b a b a b a b a b", "b a b a b a b a b a b a", "short one of six plain words", "short one of six plain words now"]
    rnd.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    signed, hashed = [], M.minhash
    sig = {r.id: r.sig for r in hashed(df, "id", "t").collect()}
    tokens = [M.X.minhash_tokens(M.F.col("t")).alias("w")]
    words_of = {r.id: list(r.w or []) for r in df.select("id", *tokens).collect()}
    want = {}
    for b in sig:
        for a in range(b):
            if any(sig[a][4 * k : 4 * k + 4] == sig[b][4 * k : 4 * k + 4] for k in range(32)):
                s = sum(x == y for x, y in zip(sig[a], sig[b])) / 128
                if 0.35 <= s < 0.85 and 1 <= min(len(words_of[a]), len(words_of[b])) < M.SHORT:
                    s = max(s, M.difflib.SequenceMatcher(None, words_of[a], words_of[b], autojunk=False).ratio())
                if s >= 0.85:
                    want[b] = max(want.get(b, (0.0, -1)), (s, a))

    def counted(part, *args):
        signed.append(part.count())
        return hashed(part, *args)

    monkeypatch.setattr(M, "minhash", counted)
    got = {r.id: (r.similarity, r.match_id) for r in M.near_duplicates(df, "id", "t").collect()}
    assert got == want and len(got) >= 9
    assert signed == [len({tuple(w) for w in words_of.values() if len(w) <= M.LONG} | {tuple(w) for w in words_of.values() if w[:50] == long[1].split()[:50]})]


def test_next_jaccard_sends_each_text_once(spark, tmp_path):
    """Pairs across stretches, gaps, an id twice, texts without runs; no list of runs is shuffled or written."""
    texts = {-1: "minus one", 0: "minus ones", 254: "abcdef", 255: "abcdefg", 256: "abcdefgh", 257: None, 258: "--", 511: "ab", 512: "ab", 600: "alone"}
    rows = [*texts.items(), (256, "abcdefghi"), (None, "no id")]
    got = sorted((r.a, r.b, round(r.jaccard, 6)) for r in retrieval.next_jaccard(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect())
    assert got == [(-1, 0, 0.75), (254, 255, 0.5), (255, 256, 0.5), (255, 256, round(2 / 3, 6)), (256, 257, 0.0), (256, 257, 0.0), (257, 258, 0.0), (511, 512, 1.0)]
    from quarry.catalog import QUERIES

    plan = QUERIES["content_shingle_jaccard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array<bigint>" not in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_what_is_left_of_a_greedy_choice_is_walked_in_one_task(spark, monkeypatch):
    """Rounds alone, a walk alone and a walk after rounds take the same edges; few edges take no round."""
    rnd = random.Random(9)
    rows = [(rnd.randrange(2), rnd.randrange(8), 100 + rnd.randrange(8), rnd.randrange(5) / 4, rnd.choice([True, False, None])) for _ in range(60)] + [(None, 1, 1, 0.5, False), (0, 3, 3, 2.0, False)]
    df = spark.createDataFrame(rows, "part int, a int, b int, weight double, same_doc boolean")
    got = []
    for most in (0, 30, 1 << 19):
        monkeypatch.setattr(graph, "WALK", most)
        got.append(sorted(map(tuple, graph.cap_degree(df, "part", 2).collect()), key=repr))
    assert got[0] == got[1] == got[2]
    written = []
    monkeypatch.setattr(graph, "cut", lambda d: written.append(1) or staging.cut(d))
    graph.cap_degree(df, "part", 4)
    assert len(written) == 2
