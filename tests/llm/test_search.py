"""Ranked search against every document scored from its text, with its edge cases."""

import random

import duckdb
import pytest

from quarry.llm import lexical_search

from .test_llm import ODD, SCHEMA, SF


def found(docs, queries, k=10):
    got = lexical_search.search(lexical_search.build_index(docs), queries, "item_id", "text", k).collect()
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got)


def test_against_brute_force_and_sql(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = lexical_search.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(con.execute(lexical_search.ORACLE).fetchall()) == sorted(want)
    assert found(docs, items) == sorted(want)


@pytest.mark.parametrize("block_docs, block_entries, block_bytes", [(1, 1 << 16, 8 << 20), (7, 40, 700), (128, 1 << 16, 8 << 20)])
def test_blocks_and_parts_of_any_size(spark, monkeypatch, block_docs, block_entries, block_bytes):
    """Common and rare words, copies that tie, blocks of several sizes and queries in several parts give the same rows."""
    rnd = random.Random(block_docs)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(60)], k=rnd.randint(0, 30)))) for i in range(150)]
    rows += [(1000 + i, rows[3][1] + " W5") for i in range(30)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 9)))) for i in range(12)]
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(lexical_search, "BLOCK_ENTRIES", block_entries)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block_bytes)
    rnd.shuffle(rows)
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert got == sorted(lexical_search.brute_force(rows, items, 4))


def test_few_blocks_are_decoded_and_sent_at_once(spark, monkeypatch):
    """However many documents a file holds: row groups and Arrow batches of the index stay small."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 1)
    docs = spark.createDataFrame([(i, f"word w{i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    index = lexical_search.build_index(docs)
    groups = [f.row_group(i).num_rows for f in (pq.ParquetFile(p.removeprefix("file:")).metadata for p in index.inputFiles()) for i in range(f.num_row_groups)]
    assert sum(groups) == 200 and max(groups) <= lexical_search.AT_ONCE
    lexical_search.search(index, spark.createDataFrame([(1, "w7 word")], "item_id long, text string"), "item_id", "text")
    sizes = index.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) <= lexical_search.AT_ONCE


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """One document answers best; the blocks of the others are never opened."""
    import numpy as np
    import pyarrow as pa

    bags = lambda *texts: [np.unique(lexical_search.WordHashes().of(lexical_search.words_of(t)), return_counts=True) for t in texts]
    part = lambda b: [(own, lexical_search.term_parts(tf.astype(np.int64), int(tf.sum()), 3, 9).astype(np.int32)) for own, tf in b]
    blocks = [lexical_search._block([i], part(bags(t))) for i, t in enumerate(["x filler filler", "x y z", "x x filler"])]
    queries = lexical_search.Queries(["x y z"])
    queries.weigh(np.ones(len(queries.terms), np.int64), 3)
    opened, sums = [], queries.sums
    monkeypatch.setattr(queries, "sums", lambda rows, n, numbers, parts: opened.append(n) or sums(rows, n, numbers, parts))
    one = pa.Table.from_batches(blocks).combine_chunks().to_batches()
    out = list(lexical_search._score(queries, np.zeros(1, np.int64), 1)(iter(one)))
    assert out[0].column(1).to_pylist() == [1] and len(opened) == 3 + 1  # three bounds, one block


def test_edges(spark):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    items = [(1, "TWO one nowhere"), (None, "one"), (1, "TWO one nowhere"), (2, None), (3, ""), (4, "日本語 done"), (5, "nowhere")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(lexical_search.build_index(odd), queries, "item_id", "text").collect()
    want = lexical_search.brute_force([r[:2] for r in ODD], items)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=key) == sorted(want, key=key)
    assert {r.doc_id for r in got if r.item_id == 4} == {8} and not [r for r in got if r.item_id in (2, 3, 5)]
    assert lexical_search.search(lexical_search.build_index(none), queries, "item_id", "text").count() == 0
    assert lexical_search.search(lexical_search.build_index(odd), queries.limit(0), "item_id", "text").count() == 0
