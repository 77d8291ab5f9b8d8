"""Steps of the graph queries that must not grow faster than their input, held against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import quarry.plans  # noqa: F401
from quarry.catalog import QUERIES
from quarry.operators import graph, retrieval

SF = "/root/testdata/sf0.001"


def test_posting_candidates_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(graph, "STRETCH", 8)
    random.seed(3)
    rows = sorted({(random.randrange(200), f"k{random.randrange(3)}") for _ in range(300)})
    got = {(r.a, r.b): r.votes for r in graph.posting_candidates(spark.createDataFrame(rows, "id long, key string"), "id", "key", 6, 1000).collect()}
    want = Counter()
    for k in ("k0", "k1", "k2"):
        ids = [i for i, x in rows if x == k]
        want.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 : i + 4])
    assert got == dict(want)


def test_posting_candidates_join_no_pairs(spark):
    rows = [(i, "k") for i in range(30)]
    plan = graph.posting_candidates(spark.createDataFrame(rows, "id long, key string"), "id", "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_symmetric_bm25_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCKS", 3)
    random.seed(5)
    docs = [(i, " ".join(f"w{random.randrange(12)}" for _ in range(random.randrange(1, 9)))) for i in range(12)]
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12) if random.random() < 0.6]
    post = retrieval.postings(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    got = {(r.a, r.b): r.lexical for r in graph.symmetric_bm25(spark.createDataFrame(pairs, "a long, b long"), post, "id").collect()}
    tf = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    avg = sum(sum(c.values()) for c in tf.values()) / 12
    w = lambda i, t: math.log(1 + (12 - df[t] + 0.5) / (df[t] + 0.5)) * tf[i][t] * 2.5 / (tf[i][t] + 1.5 * (0.25 + 0.75 * sum(tf[i].values()) / avg))
    want = {(a, b): sum(0.5 * (w(a, t) + w(b, t)) for t in tf[a].keys() & tf[b].keys()) for a, b in pairs}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_percentiles_are_exact(spark):
    random.seed(7)
    values = [(round(random.gauss(0, 1), random.choice([1, 6])),) for _ in range(3001)] + [(0.0,)] * 500 + [(None,)]
    df = spark.createDataFrame(values, "v double")
    want = df.agg(F.percentile("v", [0.05, 0.5, 0.95])).first()[0]
    assert all(abs(x - y) < 1e-12 for x, y in zip(graph.percentiles(df, "v", [0.05, 0.5, 0.95]), want, strict=True))
    assert graph.percentiles(df.where("v is null"), "v", [0.05]) == [None]


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_percentiles_of_few_values(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double").coalesce(1)
    want = df.agg(F.percentile("v", [0.05, 0.95])).first()[0]
    assert all(abs(x - y) < 1e-12 for x, y in zip(graph.percentiles(df, "v", [0.05, 0.95]), want, strict=True))


def test_degree_cap_is_one_walk_and_takes_an_edge_given_twice_once(spark):
    random.seed(11)
    rows = sorted({(a, b): (0, a, b, random.randrange(20) / 10, random.random() < 0.5) for a, b in ((random.randrange(30), random.randrange(30)) for _ in range(400)) if a < b}.values())
    n, inside, want = defaultdict(int), defaultdict(int), set()
    for _, a, b, _, same in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if max(n[a], n[b]) < 5 and not (same and max(inside[a], inside[b]) >= 2):
            want.add((a, b))
            for x in (a, b):
                n[x] += 1
                inside[x] += same
    got = graph.cap_degree(spark.createDataFrame(rows + rows[:50], "part int, a int, b int, weight double, same_doc boolean"), "part", 5).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["sparse_profile", "query_node_signals", "route_descend", "routing_recall"])
def test_terms_of_groups_shuffle_no_row_a_text(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "postings", lambda *_: pytest.fail("a row a text and term"))
    assert QUERIES[name](spark, SF).count() > 0


def test_sparse_rows_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "Alpha beta alpha a1 7"), (2, None), (3, "")], "doc_id long, text string")
    got = retrieval.sparse_rows(docs, "doc_id", "text", "[a-z].*[0-9]|[0-9].*[a-z]")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = retrieval.sparse_weights(retrieval.postings(docs, "doc_id", "text").where("term <> 'a1'"), "doc_id", stems=False)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 3


def test_pagerank_of_hubs_keeps_edges_in_place(spark):
    """Told which edges lead to hubs, the ranks are the same, and a round shuffles rows by hubs and buckets, not by edges."""
    from quarry.operators import staging

    up = [(f"o{i}", f"s{i * 7 % 5}", float(i % 3 + 1)) for i in range(400)] + [(f"o{i}", f"s{i * 3 % 4}", 2.0) for i in range(0, 400, 2)]
    e = spark.createDataFrame([*up, *[(b, a, w) for a, b, w in up], ("o1", None, 1.0), ("o2", "end", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("o1", 1.0), ("o7", 2.0), ("nowhere", 1.0)], "id string, weight double")
    want = {r.id: round(r.r, 10) for r in graph.pagerank(e, seeds, rounds=3).collect()}
    for hub in (F.col("dst").startswith("s"), F.lit(True), F.lit(False)):
        got = graph.pagerank(e, seeds, rounds=3, to_hub=hub)
        assert {r.id: round(r.r, 10) for r in got.collect()} == want and None in want and "nowhere" in want
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true" and not [t for t in spark.catalog.listTables() if t.name.startswith("quarry_")]
    with staging.bucketed(spark, 8, "part") as put:
        a = put(spark.range(100).selectExpr("cast(id % 10 as int) part", "id"))
        b = spark.range(100).selectExpr("cast(id % 10 as int) part", "id", "id other").repartition(8, "part")
        plan = a.join(b.hint("shuffle_hash"), ["part", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("at_once", [1 << 17, 3])
def test_all_pairs_bm25_has_every_pair_of_a_key(spark, monkeypatch, at_once):
    """Each pair that shares a key once, with the value of symmetric_bm25; keys and ids that are null and texts without terms among them."""
    monkeypatch.setattr(graph, "BLOCKS", 3)
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", at_once)
    random.seed(11)
    docs = [(i, " ".join(f"w{random.randrange(12)}" for _ in range(random.randrange(1, 9))) if i else "...") for i in range(60)]
    keys = [(i, f"k{random.randrange(30)}") for i in range(60) for _ in range(2)] + [(i, "hot") for i in range(40)] + [(50, None), (51, None), (None, "hot"), (0, "hot")]
    post = retrieval.postings(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    got = [(r.a, r.b, r.lexical) for r in graph.all_pairs_bm25(spark.createDataFrame(keys, "id long, key string"), post, "id", "key").collect()]
    of = defaultdict(set)
    for i, k in keys:
        if k and i is not None:
            of[k].add(i)
    want = {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    assert len(got) == len(want) and {g[:2] for g in got} == want
    plain = {(r.a, r.b): r.lexical for r in graph.symmetric_bm25(spark.createDataFrame(sorted(want), "a long, b long"), post, "id").collect()}
    assert all(abs(plain[a, b] - x) < 1e-9 for a, b, x in got)


def test_knowledge_edges_of_units_far_apart_in_a_list(spark, tmp_path):
    """Units that share one word only are held against each other wherever they stand in its list."""
    docs = [(i, "shared " * 5 if i in (0, 39) else "shared " + " ".join(f"own{i}x{j}" for j in range(30)), f"source {i}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.a, r.b) for r in QUERIES["knowledge_edges"](spark, str(tmp_path)).collect()]
    assert max(b - a for a, b in got) > 24
    assert max(Counter(i for e in got for i in e).values()) <= 32


def test_buckets_of_a_graph_follow_its_edges(spark, monkeypatch):
    """A bucket gets a bounded number of edges, so what its joins hold does not grow with the graph; ranks stay the same."""
    edges = spark.createDataFrame([(f"o{i}", f"s{i % 3}", 1.0 + i) for i in range(60)], "src string, dst string, weight double")
    edges = edges.union(edges.select("dst", "src", "weight"))
    seeds = spark.createDataFrame([("o1", 1.0)], "id string, weight double")
    seen, bucketed = [], graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda s, n, c: seen.append(n) or bucketed(s, n, c))
    ranks = []
    for most in (graph.BUCKET_EDGES, 10):
        monkeypatch.setattr(graph, "BUCKET_EDGES", most)
        ranks.append({r.id: round(r.r, 9) for r in graph.pagerank(edges, seeds, rounds=2, to_hub=F.col("dst").startswith("s")).collect()})
    assert seen == [8, 12] and ranks[0] == ranks[1]
