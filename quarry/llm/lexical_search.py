"""Ranked lexical search with block-max pruning.

The index has a row a block: up to 128 documents that lie next to each other, as a forward index (for each document its terms
and what each adds to a score before it is weighed), and for each term of the block the largest of these values and the
number of documents.  A search reads the maxima of all blocks first.  A query's bound on a block is the sum of its weighed
maxima; blocks are sorted by it, and the best few of each query give a first threshold, its k-th best score there.
One pass over the blocks then scores those whose bound reaches the threshold, in order of the bound, with a
threshold that rises on the way.  A block below it can hold no document of the k best, so the result is exact.

Terms are kept as 64-bit hashes.  Queries go to every task in parts of ``BLOCK_BYTES``, so their number is not bounded;
what a task sends on is k rows a query.  Only sums go to the driver: two numbers of the corpus, and a frequency, a few
bounds and a threshold for each query of a part.

Edge cases: null and empty texts have no terms and are found by nothing; a query without terms finds nothing; every row of the
queries is a query of its own, repeated and null ids included; repeated documents are found each; null doc_ids come
first among equal scores; an empty table finds nothing.  Only the named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, small_batches, stage, table
from .decontamination import words_of

K = 10
#: Documents and entries of a block; one document alone may have more entries.
BLOCK_DOCS, BLOCK_ENTRIES = 128, 1 << 16
AT_ONCE = 16  # blocks that a task decodes, or sends to Python, at once; each may come to more than a megabyte
BLOCK_BYTES = 2 << 20  # of query texts that go to every task
FIRST_BLOCKS = 3  # a query, for its first threshold


def collection_sizes(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            n = [len(words_of(t)) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["n", "l"])

    row = docs.select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def term_parts(tf, n, n_docs: int, n_terms: int):
    """What a term adds to a document's score before it is weighed."""
    m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


_INDEX = "doc_ids array<bigint>, ends array<int>, terms array<bigint>, parts array<int>, block_terms array<bigint>, block_parts array<int>, block_df array<int>"


def _block(ids: list, bags: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    terms, parts = (np.concatenate([b[j] for b in bags]) for j in (0, 1))
    order = np.argsort(terms, kind="stable")
    own, first, df = np.unique(terms[order], return_index=True, return_counts=True)
    most = np.maximum.reduceat(parts[order], first) if len(own) else parts
    columns = [(ids, pa.int64()), (np.cumsum([len(b[0]) for b in bags]), pa.int32()), (terms.view(np.int64), pa.int64()), (parts, pa.int32()), (own.view(np.int64), pa.int64()), (most, pa.int32()), (df, pa.int32())]
    return pa.record_batch([pa.array([x], pa.list_(kind)) for x, kind in columns], [c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of the documents (doc_id, text), in the order in which they are read."""
    n_docs, n_terms = collection_sizes(docs)

    def run(batches):
        known, ids, bags, size = WordHashes(), [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = known.of(words_of(text))
                if not len(words):
                    continue
                own, tf = np.unique(words, return_counts=True)
                if ids and (len(ids) >= BLOCK_DOCS or size + len(own) > BLOCK_ENTRIES):
                    yield _block(ids, bags)
                    ids, bags, size = [], [], 0
                ids.append(doc_id)
                bags.append((own, term_parts(tf.astype(np.int64), len(words), n_docs, n_terms).astype(np.int32)))
                size += len(own)
        if ids:
            yield _block(ids, bags)

    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX).withColumn("block_id", F.monotonically_increasing_id()), rows=AT_ONCE)


class Queries:
    """The queries of one part: sorted terms, and for each term the queries that ask for it."""

    def __init__(self, texts: list[str | None]):
        known = WordHashes()
        bags = [np.unique(known.of(words_of(t))) for t in texts]  # of each query, once each
        self.n = len(bags)
        flat = np.concatenate([*bags, np.empty(0, np.uint64)]).view(np.int64)
        order = np.argsort(flat, kind="stable")
        self.terms, first = np.unique(flat[order], return_index=True)
        self.asked, self.starts = np.repeat(np.arange(self.n), [len(b) for b in bags])[order], np.append(first, len(flat))
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``terms``, numbers of the query terms) of those that a query asks for."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[at] == terms)
        return here, at[here]

    def sums(self, rows: np.ndarray, n_rows: int, numbers: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """rows x queries: the weighed parts of each, summed up as integers."""
        n = self.starts[numbers + 1] - self.starts[numbers]
        which = np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        added = np.bincount(np.repeat(rows, n) * self.n + self.asked[which], np.repeat(self.weights[numbers] * parts, n), n_rows * self.n)
        return added.astype(np.int64).reshape(n_rows, self.n)  # doubles hold integers of this size exactly

    def bounds(self, terms: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Of each query on a block with these maxima; a weight below zero can only lower a score."""
        here, numbers = self.find(terms)
        keep = self.weights[numbers] > 0
        return self.sums(np.zeros(keep.sum(), np.int64), 1, numbers[keep], parts[here][keep].astype(np.int64))[0]


class Best:
    """The k best (score, doc_id) of each query so far; equal scores by ascending doc_id, null first."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.rows = k, floor, [[] for _ in range(n)]

    def threshold(self) -> np.ndarray:
        return np.array([max(f, -r[-1][0]) if len(r) == self.k else f for f, r in zip(self.floor.tolist(), self.rows, strict=True)], np.int64)

    def add(self, q: int, scores: np.ndarray, ids: list) -> None:
        new = [(-s, d is not None, d or 0) for s, d in zip(scores.tolist(), ids, strict=True)]
        self.rows[q] = sorted([*self.rows[q], *new])[: self.k]


def _values(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def _score(queries: Queries, floor: np.ndarray, k: int):
    """The k best of each query in a task: blocks by their bounds, down to where every bound is below the threshold."""

    def run(batches):
        best = Best(queries.n, k, floor)
        for b in batches:
            bounds = [queries.bounds(_values(b.column(4), i), _values(b.column(5), i)) for i in range(b.num_rows)]
            for i in sorted(range(b.num_rows), key=lambda i: -int(bounds[i].max(initial=0))):
                open_ = np.flatnonzero((bounds[i] >= best.threshold()) & (bounds[i] > 0))
                if not len(open_):
                    continue
                ids, ends = b.column(0)[i].as_py(), _values(b.column(1), i)
                here, numbers = queries.find(_values(b.column(2), i))
                rows = np.searchsorted(ends, here, "right")
                scores = queries.sums(rows, len(ids), numbers, _values(b.column(3), i)[here].astype(np.int64))
                least = best.threshold()
                for q in open_.tolist():
                    at = np.flatnonzero((scores[:, q] >= least[q]) & (scores[:, q] > 0))
                    if len(at):
                        best.add(q, scores[at, q], [ids[j] for j in at])
        found = [(q, d if known else None, -s) for q, rows in enumerate(best.rows) for s, known, d in rows]
        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else [[], [], []], (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["q", "doc_id", "score"])

    return run


_FOUND = "q int, doc_id bigint, score bigint"
_COLUMNS = [c.split()[0] for c in _INDEX.split(", ")]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))  # k rows from each task
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _part(index: DataFrame, n_docs: int, texts: list[str | None], k: int) -> DataFrame:
    queries = Queries(texts)

    def frequencies(batches):
        for b in batches:
            df = np.zeros(len(queries.terms), np.int64)
            for i in range(b.num_rows):
                here, numbers = queries.find(_values(b.column(0), i))
                df[numbers] += _values(b.column(1), i)[here]
            at = np.flatnonzero(df)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["t", "df"])

    df = np.zeros(len(queries.terms), np.int64)
    for r in index.select("block_terms", "block_df").mapInArrow(frequencies, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():  # a row a query term
        df[r["t"]] = r["df"]
    queries.weigh(df, n_docs)

    def leading(batches):
        """The FIRST_BLOCKS blocks of the best bounds in the task, for each query."""
        bounds, blocks = np.zeros((FIRST_BLOCKS + 1, queries.n), np.int64), np.zeros((FIRST_BLOCKS + 1, queries.n), np.int64)
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                bounds[-1], blocks[-1] = queries.bounds(_values(b.column(1), i), _values(b.column(2), i)), block
                order = np.argsort(-bounds, axis=0, kind="stable")
                bounds, blocks = np.take_along_axis(bounds, order, 0), np.take_along_axis(blocks, order, 0)
        row, q = np.nonzero(bounds[:-1])
        yield pa.record_batch([pa.array(q, pa.int32()), pa.array(blocks[row, q], pa.int64()), pa.array(bounds[row, q], pa.int64())], ["q", "block_id", "bound"])

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block_id"))
    first = index.select("block_id", "block_terms", "block_parts").mapInArrow(leading, "q int, block_id bigint, bound bigint").withColumn("_p", place).where(F.col("_p") <= FIRST_BLOCKS)
    first = F.broadcast(stage(first.select("block_id").distinct()))  # FIRST_BLOCKS numbers a query of this part
    floor = np.zeros(queries.n, np.int64)
    seeds = index.join(first, "block_id", "left_semi").select(*_COLUMNS).mapInArrow(_score(queries, floor, k), _FOUND)
    for r in _ranked(seeds, k).where(F.col("rank") == k).collect():  # a row a query
        floor[r["q"]] = r["score"]
    return _ranked(index.select(*_COLUMNS).mapInArrow(_score(queries, floor, k), _FOUND), k)


def search(index: DataFrame, queries: DataFrame, query_id: str, text: str, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each row of queries."""
    spark = index.sparkSession
    small_batches(spark, AT_ONCE)
    n_docs = index.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    asked = stage(queries.select(F.col(query_id).alias("_id"), F.col(text).alias("_text")).withColumn("_n", F.monotonically_increasing_id()))
    n_parts = int((asked.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 64)).first()[0] or 0) // BLOCK_BYTES) + 1
    kind = queries.schema[query_id].dataType.simpleString()
    found = []
    for p in range(n_parts):
        rows = asked.where(F.pmod(F.xxhash64("_n"), F.lit(n_parts)) == p).orderBy("_n").collect()  # BLOCK_BYTES of them
        names = spark.createDataFrame([(i, r["_id"]) for i, r in enumerate(rows)], f"q int, {query_id} {kind}")
        found.append(_part(index, n_docs, [r["_text"] for r in rows], k).join(F.broadcast(names), "q").select(query_id, "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), "item_id", "text")


#: Plain DuckDB SQL for the same rows: every document against every item.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
bt AS MATERIALIZED (SELECT DISTINCT q, unnest(w) AS term FROM b),
p AS MATERIALIZED (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM bt) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
c AS (SELECT q, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM p JOIN f USING (term) JOIN bt USING (term), s GROUP BY q, rid, doc_id),
r AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN b USING (q) WHERE rank <= 10
"""


def brute_force(docs: list[tuple], queries: list[tuple], k: int = K) -> list[tuple]:
    """(query id, rank, doc_id, score), every document scored from the text, for tests."""
    from collections import Counter

    bags = [(d, Counter(words_of(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in bags), sum(c.total() for _, c in bags)
    df = Counter(w for _, c in bags for w in c)
    out = []
    for q, text in queries:
        scored = []
        for d, c in bags:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * int(term_parts(c[w], c.total(), n_docs, n_terms)) for w in set(words_of(text)) if w in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(q, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scored)[:k])]
    return out
