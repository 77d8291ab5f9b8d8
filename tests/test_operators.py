"""Facts and edge cases of single operators."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import quarry.plans  # noqa: F401
from quarry.catalog import QUERIES
from quarry.functions import text as X
from quarry.functions.embedding import embed
from quarry.operators import chunking, graph, memory, relational, retrieval, similarity, temporal
from quarry.operators.anchors import extract
from quarry.plans.retrieval_plan import features, plan
from quarry.sources import files, sinks, web


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_md5_bucket(spark):
    assert one(spark, X.md5_bucket(F.col("w")), w="word") == 532592


def test_roots(spark):
    for word, root in {"studies": "study", "running": "runn", "agreed": "agreed", "files": "file", "class": "class", "operations": "oper", "cat": "cat", "valued": "valu"}.items():
        assert one(spark, X.ascii_root(F.col("w")), w=word) == root, word


def test_minhash_against_plain_definition(spark):
    text = "one two three four five six seven"
    tokens = text.split()
    shingles = {" ".join(tokens[i : i + 5]) for i in range(3)}
    want = [min(int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:8], 16) for s in shingles) for i in range(128)]
    got = {r.id: list(r.sig) for r in similarity.minhash(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string"), "id", "t").collect()}
    assert got[1] == want and got[2] == [0] * 128 and got[3] == [0] * 128


def test_minhash_of_many_shingles_of_any_length(spark, monkeypatch):
    """Blocks of shingles across texts; shingles around and beyond one block of MD5; no library call for each of the others."""
    calls = []
    real = hashlib.md5
    monkeypatch.setattr(similarity.hashlib, "md5", lambda x: (calls.append(x), real(x))[1])
    groups = [{b"x" * k for k in (0, 1, 49, 50, 51, 52, 55, 60, 64, 130)}, {"日本 đợi".encode()}, {b"w%d" % i for i in range(500)}]
    flat = [(n, s) for n, g in enumerate(groups) for s in sorted(g)]
    out = np.full((3, 128), 2**32 - 1, np.uint32)
    similarity._least_heads([s for _, s in flat], np.array([n for n, _ in flat]), out)
    assert calls and min(map(len, calls)) > 51
    want = [[min(int(real(b"%d:" % i + s).hexdigest()[:8], 16) for s in g) for i in range(128)] for g in groups]
    assert out.tolist() == want
    monkeypatch.undo()
    texts = [" ".join(f"w{i * j % 97}" for j in range(i % 50)) for i in range(1500)] + ["long" * 30 + " a b c d e"]
    plain = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    got = {r.id: list(r.sig) for r in similarity.minhash(spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1), "id", "t", 3).collect()}
    for n, t in enumerate(texts):
        assert got[n] == ([min(int(real(f"{i}:{s}".encode()).hexdigest()[:8], 16) for s in plain(t.split())) for i in range(3)] if t else [0] * 3), n


def test_near_duplicates_align_short_texts(spark):
    base = [f"t{i}" for i in range(30)]
    at = lambda *places: " ".join("zz" if i in places else w for i, w in enumerate(base))
    long = " ".join(base + [f"u{i}" for i in range(60)])
    df = spark.createDataFrame([(1, at(), [1.0, 0.0]), (2, at(14, 20), [0.0, 1.0]), (3, "other words " * 9, [1.0, 0.05]), (4, long, None), (5, None, None)], "id long, t string, v array<double>")
    got = {r.id: (r.match_id, round(r.similarity, 6)) for r in similarity.near_duplicates(df, "id", "t").collect()}
    assert got == {2: (1, round(28 / 30, 6))}
    got = {r.id: r.match_id for r in similarity.near_duplicates(df, "id", "t", vec="v", dim=2).collect()}
    assert got == {2: 1, 3: 1}


def test_diff_signals():
    t = lambda s: s.lower().replace(".", " .").split()
    assert similarity.diff_signals(t("limit is 25 MiB"), t("limit is 10 MiB"))[0]
    assert not any(similarity.diff_signals("the cache is not enabled".split(), "the cache is disabled".split()))
    assert similarity.diff_signals("token is valid".split(), "token is invalid".split())[1]


def test_asof_join_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("a", 4, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 3, 10), ("a", 3, 11), ("a", 5, 12)], "k string, d int, v int")
    got = {r.id: r.v for r in relational.asof_join(left, right, "k", "t", "d", ["v"]).collect()}
    assert got == {1: 12, 2: None, 3: None, 4: 11}


def test_version_chain_does_not_depend_on_arrival(spark):
    rows = [("d", 3, 1, 30), ("d", 1, 2, 10), ("d", 2, 3, 20), ("d", 2, 4, 21)]
    df = spark.createDataFrame(rows, "doc string, s int, arrival int, id int").withColumn("s", F.make_timestamp(F.lit(2020), F.lit(1), F.col("s"), F.lit(0), F.lit(0), F.lit(0)))
    got = {r.id: (r.valid_from.day, r.valid_to.day, r.supersedes_id) for r in temporal.version_chain(df, "doc", "s", "arrival", "id").collect()}
    assert got == {10: (1, 2, None), 20: (2, 2, 10), 21: (2, 3, 20), 30: (3, 31, 21)}


def test_budget_pack_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 80), (1, 3, 40)], "q int, r int, t int")
    assert sorted(r.r for r in retrieval.pack(df, "q", [F.asc("r")], "t", 100).collect()) == [1, 3]


def test_mmr_collapses_copies_and_spreads_documents(spark):
    a, b = "alpha beta gamma delta epsilon", "wholly different words stand here"
    df = spark.createDataFrame([(1, 1, "d1", 1.0, 0, a), (1, 2, "d1", 0.99, 1, a), (1, 3, "d2", 0.9, 2, b)], "q int, id int, doc string, score double, rank int, text string")
    assert [(r.id, r.place) for r in retrieval.mmr(df, "q", 3).orderBy("place").collect()] == [(1, 1), (3, 2)]


def _long(places: dict[int, str]) -> str:
    """A text of 20,000 characters without repeated runs, with other words at some places."""
    s = "".join(f"{i:x}".rjust(5, "q") for i in range(4000))
    for at, word in places.items():
        s = s[:at] + word + s[at + len(word) :]
    return s


def test_shingles_cover_whole_texts(spark):
    """Between the first, middle and last thousands of characters as well."""
    texts = [_long({}), _long({3000: "x" * 400, 9000: "y" * 400, 16000: "z" * 400})]
    runs = [{t[i : i + 6] for i in range(len(t) - 5)} for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: set(r.s) for r in df.select("id", retrieval.shingles(F.col("t")).alias("s")).collect()}
    assert [len(got[i]) for i in (0, 1)] == [len(r) for r in runs] and len(got[0] & got[1]) == len(runs[0] & runs[1])


def test_mmr_tells_long_texts_apart_anywhere(spark):
    """Long texts that differ between the first, middle and last thousands only are no copies."""
    a = _long({})
    b = _long({1500 + i: "x7w" for i in range(0, 3000, 6)} | {14000 + i: "x7w" for i in range(0, 4000, 6)})
    df = spark.createDataFrame([(1, 1, "d1", 1.0, 0, a), (1, 2, "d2", 0.9, 1, b), (1, 3, "d3", 0.8, 2, a)], "q int, id int, doc string, score double, rank int, text string")
    assert [r.id for r in retrieval.mmr(df, "q", 3).orderBy("place").collect()] == [1, 2]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_degree_cap(spark):
    rows = [(0, 1, i, 1.0 - i / 100, False) for i in range(2, 8)]
    got = graph.cap_degree(spark.createDataFrame(rows, "part int, a int, b int, weight double, same_doc boolean"), "part", 3).collect()
    assert sorted(r.b for r in got) == [2, 3, 4]


def test_graph_queries_take_documents_of_any_length(spark, tmp_path):
    words = " ".join(f"term{i}" for i in range(400))
    rows = [(1, words, "a", len(words)), (2, words + " more", "a", len(words) + 5), (3, "term1 term2", "a", None), (4, "term1 term2 other", "b", 17)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.votes for r in QUERIES["posting_candidates"](spark, str(tmp_path)).collect()}
    assert {(1, 2), (1, 3), (2, 3), (3, 4)} == set(got) and got[1, 2] == 64
    edges = {(r.a, r.b) for r in QUERIES["knowledge_edges"](spark, str(tmp_path)).collect()}
    assert (1, 2) in edges
    assert {1, 2} <= {r.id for r in QUERIES["tree_partition"](spark, str(tmp_path)).collect()}


def test_pagerank_keeps_mass_near_the_seed(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    r = {x.id: x.r for x in graph.pagerank(e, spark.createDataFrame([("a", 1.0)], "id string, weight double"), rounds=20).collect()}
    assert r["a"] > r["c"] and abs(sum(r.values()) - 1) < 1e-6


def test_ppr_walks_all_orders(spark, tmp_path):
    spark.createDataFrame([(1, 7, 2.0), (5000, 7, 1.0), (5000, 8, 1.0)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.rank for r in QUERIES["ppr"](spark, str(tmp_path)).collect()}
    flow = {"o1": [("s7", 1.0)], "o5000": [("s7", 0.5), ("s8", 0.5)], "s7": [("o1", 2 / 3), ("o5000", 1 / 3)], "s8": [("o5000", 1.0)]}
    want = {"o1": 1.0}
    for _ in range(30):
        new = {"o1": 0.4}
        for a, m in want.items():
            for b, p in flow[a]:
                new[b] = new.get(b, 0.0) + 0.6 * m * p
        want = new
    assert got == {k: round(v, 8) for k, v in want.items()}


def test_blocks_and_units(spark):
    text = "# Title\n\npara one\nline two\n\n## Part\n- a\n- b\n\n| x | y |\n|---|---|\n\n```\ncode\n```\n"
    b = chunking.parse(text)
    assert [x["block_type"] for x in b] == ["heading", "paragraph", "heading", "list", "table", "code"]
    assert b[3]["section_path"] == "Title > Part" and chunking.parse(None) == []
    d = chunking.blocks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    u = chunking.units(d, "id", 8).orderBy("unit_no").collect()
    assert u[0].block_from == 0 and u[-1].block_to == 5


def test_anchors():
    got = {(k, label) for k, label, *_ in extract("See https://x.org/a. Mail a.b@c.org about ADR-12 with Anna Maria Weber on 2024-01-05.")}
    assert {("uri", "https://x.org/a"), ("email", "a.b@c.org"), ("numeric", "ADR-12"), ("date_code", "2024-01-05"), ("name", "Anna Maria Weber")} <= got


def test_episodes(spark):
    rows = [(1, i, float(i * 60 + (4000 if i > 3 else 0)), "we talk about the same database index") for i in range(6)]
    got = {r.turn: r.episode for r in memory.episodes(spark.createDataFrame(rows, "c int, turn int, s double, text string"), "c", "s", "turn", "text", "s").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_plan():
    assert (plan("List 20 files about budgets", 12).count, plan("budgets", 12).count, plan("budgets", 500).count) == (20, 12, 50)
    assert features("changes since 05/01/2024").dates == ("05/01/2024", "2024-01-05") and features("latest release").temporal


def test_embedding_is_a_unit_vector():
    v = embed("Some words")
    assert abs(v @ v - 1) < 1e-9 and embed("") @ embed(None) == 0


def test_decode():
    assert files.decode("﻿hé".encode()) == "hé" and files.decode(b"\x00\x01") is None and files.decode("naïve".encode("cp1252")) == "naïve"
    assert files.decode("中文文本内容".encode("gb18030")) == "中文文本内容"


def test_publish_and_rollback(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    first = sinks.publish(spark.range(3).toDF("a"), root)
    assert sinks.publish(spark.range(5).toDF("a"), root, 5) != first and sinks.read_published(spark, root).count() == 5
    assert sinks.rollback(spark, root) == first and sinks.read_published(spark, root).count() == 3


def test_web(spark):
    d = spark.createDataFrame([(1, "https://x.org/a/b?q", "<html><title> A\n b </title><script>no</script><p>text</p></html>")], "id int, url string, html string")
    r = web.page_text(d, "id", "url", "html").first()
    assert (r.title, r.file_name) == ("A b", "x.org-a-b.md") and "no" not in r.body.split() and "text" in r.body


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.near_duplicates(none, "doc_id", "text").count() == 0
    assert retrieval.bm25_search(none, "doc_id", "text", none.withColumnsRenamed({"doc_id": "q"}), "q", "text", 3).count() == 0
    assert isinstance(relational.time_histogram(spark.createDataFrame([], "ts timestamp"), "ts", 4).toPandas(), pd.DataFrame)
