"""Sparse and dense retrieval, fusion, reranking, diversity and budgets.  Queries are rows; nothing loops on the driver."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from .staging import cut

K1, B = 1.5, 0.75
#: Bytes of queries that go to every task at once.
BLOCK_BYTES = 8 << 20
#: Cells that a task works on at once.
AT_ONCE = 1 << 20

# ---- sparse -----------------------------------------------------------------------------------


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, doc_len): one row a distinct term of a text."""
    words = docs.select(id_col, F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0)).alias("w"))
    each = words.select(id_col, F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return each.groupBy(id_col, "term", "doc_len").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, group: str, text: str) -> DataFrame:
    """(group, term, tf double): occurrences in all texts of a group, summed up where texts are read; no row a text and term is shuffled."""
    each = docs.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0))).alias("term"))
    return each.groupBy(group, "term").agg(F.count("*").cast("double").alias("tf"))


def document_frequencies(post: DataFrame, n_docs: int) -> DataFrame:
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _blocks(queries: DataFrame, key: str, size: Column) -> list[DataFrame]:
    """The queries in parts of about BLOCK_BYTES, by hash of the key; one part if they are that small."""
    total = queries.agg(F.sum(size)).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


class Best:
    """The k best scores of each query so far; ``keep`` marks the scores that may be among them (ties included)."""

    def __init__(self, n: int, k: int, floor: float):
        self.k, self.floor, self.best = k, floor, np.full((n, k), -np.inf)

    def keep(self, scores: np.ndarray) -> np.ndarray:
        """scores: rows x queries."""
        both = np.concatenate([self.best, scores.T], axis=1)
        self.best = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        return (scores >= self.best.min(axis=1)) & (scores > self.floor)


def _ranked(found: list[DataFrame], query: str, id_col: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), id_col))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_search(docs: DataFrame, id_col: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    """The k best texts of each query.

    A block of queries (of checked size) goes to every task.  One pass over the texts keeps, of each, its length and its
    counts of query terms; frequencies come from those rows; a second pass over them scores a text against all queries
    of the block at once and lets through only what may be among a query's k best so far.  No posting is
    shuffled, so a word that stands in every text is no hot key.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(X.WORD), F.lit(0))
    id_type, q_type = docs.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    found = []
    for block in _blocks(queries.select(query_id, query_text), query_id, F.octet_length(query_text) + 64):
        rows = block.select(query_id, F.array_distinct(words(F.col(query_text))).alias("w")).where("w is not null").collect()
        number: dict[str, int] = {}
        asked: list[list[int]] = []
        for q, r in enumerate(rows):
            for w in r["w"]:
                if w not in number:
                    number[w] = len(asked)
                    asked.append([])
                asked[number[w]].append(q)
        counted = cut(docs.select(id_col, words(F.col(text)).alias("w")).mapInArrow(_counts(number, id_col), f"{id_col} {id_type}, doc_len int, terms array<int>, tf array<int>"))
        stats = counted.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl")).first()
        df = np.zeros(len(asked))
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row a query term
            df[r["t"]] = r["df"]
        idf = np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        names = pa.array([r[query_id] for r in rows], to_arrow_type(queries.schema[query_id].dataType))
        score = _scores(asked, idf, stats["avgdl"] or 1.0, names, k, query_id, id_col)
        found.append(counted.where(F.size("terms") > 0).mapInArrow(score, f"{query_id} {q_type}, {id_col} {id_type}, score double"))
    return _ranked(found, query_id, id_col, k)


def _counts(number: dict[str, int], id_col: str):
    def run(batches):
        get = number.get
        for b in batches:
            lengths, terms, tf = [], [], []
            for w in b.column(1).to_pylist():
                n = Counter(map(get, w or ()))
                n.pop(None, None)
                lengths.append(None if w is None else len(w))  # a null text has no part in the mean
                terms.append(list(n.keys()))
                tf.append(list(n.values()))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int32()), *lists], [id_col, "doc_len", "terms", "tf"])

    return run


def _scores(asked: list[list[int]], idf: np.ndarray, avgdl: float, names: pa.Array, k: int, query_id: str, id_col: str):
    starts = np.concatenate([[0], np.cumsum([len(a) for a in asked])]).astype(np.int64)
    flat = np.array([q for a in asked for q in a], np.int64)

    def scored(b: pa.RecordBatch) -> np.ndarray:
        """texts x queries."""
        terms, tf = b.column(2), b.column(3)
        t, f = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(float)
        row = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
        w = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * b.column(1).to_numpy()[row] / avgdl))
        n = starts[t + 1] - starts[t]
        which = np.repeat(starts[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(row, n) * len(names) + flat[which]
        return np.round(np.bincount(cell, np.repeat(w, n), b.num_rows * len(names)), 6).reshape(b.num_rows, len(names))

    def run(batches):
        best = Best(len(names), k, 0.0)
        for whole in batches:
            if not whole.num_rows:
                continue
            # as many texts at a time as their pairs of (term, query) and their scores stay bounded
            t, counts = whole.column(2).flatten().to_numpy(), np.diff(whole.column(2).offsets.to_numpy())
            pairs = np.concatenate([[0], np.cumsum(starts[t + 1] - starts[t])])[np.concatenate([[0], np.cumsum(counts)])]
            load = np.cumsum(np.diff(pairs) + len(names)) // AT_ONCE
            ends = [*(np.flatnonzero(np.diff(load)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip([0, *ends], ends):
                b = whole.slice(lo, hi - lo)
                s = scored(b)
                doc, query = np.nonzero(best.keep(s))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), b.column(0).take(pa.array(doc)), pa.array(s[doc, query])], [query_id, id_col, "score"])

    return run


def sparse_weights(post: DataFrame, id_col: str, avg_len: float = 256.0, stems: bool = True) -> DataFrame:
    """(id, bucket, weight): saturated term weights filed under MD5 buckets, stems at 0.55, the larger of a collision."""
    w = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / avg_len))
    d = post.withColumn("w", w)
    whole = d.select(id_col, F.col("term").alias("t"), F.round("w", 4).alias("w"))
    if stems:
        whole = whole.union(d.select(id_col, X.index_stem(F.col("term")).alias("t"), F.round(F.col("w") * 0.55, 4)).where("t IS NOT NULL"))
    return whole.groupBy(id_col, X.md5_bucket(F.col("t")).alias("bucket")).agg(F.max("w").alias("weight"))


#: Words whose bucket a task remembers.
REMEMBERED = 1 << 18


def sparse_rows(docs: DataFrame, id_col: str, text: str, without: str, avg_len: float = 256.0) -> DataFrame:
    """(id, bucket, weight): sparse_weights, without stems, of texts whose ids are unique; words that match ``without`` have no row.

    A text has all its words in one row, so they are counted and filed there and nothing is shuffled.
    """
    run = _filed(re.compile(without), avg_len, id_col)
    words = docs.select(id_col, F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0)).alias("w"))
    found = words.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, bucket bigint, weight double")
    return found.withColumn("weight", F.round("weight", 4))  # rounding keeps the order, so the larger of a collision stays the larger


def _filed(without: re.Pattern, avg_len: float, id_col: str):
    def run(batches):
        buckets: dict[str, int] = {}
        for b in batches:
            of, filed, weights = [], [], []
            for row, words in enumerate(b.column(1).to_pylist()):
                best: dict[int, int] = {}
                for w, n in Counter(words or ()).items():
                    k = buckets.get(w)
                    if k is None:
                        if len(buckets) >= REMEMBERED:
                            buckets.clear()
                        k = buckets[w] = -1 if without.search(w) else int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % X.BUCKETS
                    if n > best.get(k, 0):  # of one text's words the more frequent one weighs more
                        best[k] = n
                best.pop(-1, None)
                tf = np.fromiter(best.values(), float, len(best))
                of.append(np.full(len(best), row))
                filed.append(np.fromiter(best, np.int64, len(best)))
                weights.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words or ()) / avg_len)))
            if of:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(of))), pa.array(np.concatenate(filed)), pa.array(np.concatenate(weights))], [id_col, "bucket", "weight"])

    return run


def query_weights(query: str, framing: frozenset[str] = frozenset()) -> list[tuple[str, float]]:
    """Token weights of one query: sublinear in repeats; in long queries framing words count 0.2, digits and names 2.2."""
    words = re.findall(r"\w+", query)
    names = {w.lower() for i, w in enumerate(words) if i and len(w) >= 2 and w != w.lower()}
    low = [w.lower() for w in words]
    kept = [w for w in low if w not in X.STOPWORDS] or low
    out = []
    for word, n in sorted(Counter(kept).items()):
        weight = 1 + 0.35 * math.log(n)
        if len(kept) >= 6:
            special = any(c.isdigit() for c in word) or word in names
            weight *= 0.2 if word in framing else 2.2 if special else 1.0
        out.append((word, round(weight, 4)))
    return out


def okapi(turns: DataFrame, thread: str, turn_id: str, text: str, queries: DataFrame, query_text: str) -> DataFrame:
    """Scores of every turn of a thread against that thread's query, with frequencies inside the thread.

    At least 10 documents and 8 words a document are assumed; stopwords weigh 0.1; a repeated query term a quarter more each time.
    """
    p = postings(turns.withColumn("_k", F.struct(thread, turn_id)), "_k", text).select(F.col(f"_k.{thread}").alias(thread), F.col(f"_k.{turn_id}").alias(turn_id), "term", "tf", "doc_len")
    words = F.size(F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0)))
    stats = turns.groupBy(thread).agg(F.greatest(F.lit(10), F.count("*")).alias("n"), F.greatest(F.lit(8.0), F.sum(words) / F.count("*")).alias("avgdl"))
    df = p.groupBy(thread, "term").agg(F.count("*").alias("df"))
    q = queries.select(thread, F.explode(F.regexp_extract_all(F.lower(query_text), F.lit(X.WORD), F.lit(0))).alias("term")).groupBy(thread, "term").agg(F.count("*").alias("qtf"))
    stop = F.col("term").isin(X.STOPWORDS)
    idf = F.when(stop, 0.1).otherwise(F.log(1 + (F.greatest(F.lit(0), F.col("n") - F.col("df")) + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    hit = p.join(q, [thread, "term"]).join(df, [thread, "term"]).join(stats, thread)
    return hit.groupBy(thread, turn_id).agg(F.sum(idf * (1 + 0.25 * (F.col("qtf") - 1)) * tf).alias("bm25"))


# ---- dense ------------------------------------------------------------------------------------


def vector_topk(queries: DataFrame, vectors: DataFrame, query_id: str, id_col: str, vec: str, k: int) -> DataFrame:
    """The k nearest vectors of each query by cosine, scores moved into [0, 1]; exact.

    A block of queries (of checked size) goes to every task, a batch of vectors meets it in one matrix product, and only scores that
    may be among a query's k best so far leave the task.
    """
    id_type, q_type = vectors.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    found = []
    for block in _blocks(queries.select(query_id, vec), query_id, F.size(vec) * 8 + 64):
        rows = block.where(F.col(vec).isNotNull()).collect()
        names = pa.array([r[query_id] for r in rows], to_arrow_type(queries.schema[query_id].dataType))
        near = _nearest(unit_rows([r[vec] for r in rows]), names, k, query_id, id_col)
        found.append(vectors.select(id_col, vec).where(F.col(vec).isNotNull()).mapInArrow(near, f"query_id {q_type}, {id_col} {id_type}, score double"))
    return _ranked(found, "query_id", id_col, k)


def unit_rows(vectors: list, dim: int | None = None) -> np.ndarray:
    """Vectors of one length as rows of length 1; those of another length or without one are zeros."""
    dim = dim or (len(vectors[0]) if vectors else 1)
    m = np.array([v if v is not None and len(v) == dim else [0.0] * dim for v in vectors], float).reshape(len(vectors), dim)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(n > 1e-12, m / np.where(n > 1e-12, n, 1), m)


def _nearest(q: np.ndarray, names: pa.Array, k: int, query_id: str, id_col: str):
    at_once = max(1, AT_ONCE // max(1, len(names)))

    def run(batches):
        best, own = Best(len(names), k, -np.inf), names.to_pylist()
        place = {x: i for i, x in enumerate(own)}
        for whole in batches:
            for b in (whole.slice(i, at_once) for i in range(0, whole.num_rows, at_once)):
                s = np.round((unit_rows(b.column(1).to_pylist(), q.shape[1]) @ q.T + 1) / 2, 6)
                for i, x in enumerate(b.column(0).to_pylist()):
                    if x in place:  # a vector is no neighbour of its own
                        s[i, place[x]] = -np.inf
                row, query = np.nonzero(best.keep(s))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), b.column(0).take(pa.array(row)), pa.array(s[row, query])], ["query_id", id_col, "score"])

    return run


# ---- fusion -----------------------------------------------------------------------------------


def rrf(lists: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over lists ranked from 1."""
    return reduce(DataFrame.unionByName, lists).groupBy(*keys).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def interleave(lists: list[DataFrame], key: str) -> DataFrame:
    """Round-robin merge by (rank, list), the first place of a key counts; ``place`` from 1."""
    tagged = [d.withColumn("_list", F.lit(i)) for i, d in enumerate(lists)]
    first = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min(F.struct("rank", "_list")).alias("_at"))
    return first.select(key, F.row_number().over(Window.orderBy("_at")).alias("place"))  # two short lists


def doc_aware_rank(sections: DataFrame, query: str, doc: str) -> DataFrame:
    """0.5 * rank + 0.5 * (document's place + 2 * place inside the document), ranks from 0."""
    w = Window.partitionBy(query)
    first = sections.withColumn("_first", F.min("rank").over(Window.partitionBy(query, doc)))
    placed = first.withColumn("_doc", F.dense_rank().over(w.orderBy("_first")) - 1).withColumn("_in", F.row_number().over(Window.partitionBy(query, doc).orderBy("rank")) - 1)
    return placed.withColumn("effective_rank", 0.5 * F.col("rank") + 0.5 * (F.col("_doc") + 2 * F.col("_in"))).drop("_first", "_doc", "_in")


def group_by_document(sections: DataFrame, query: str, doc: str, limit: int, relative: float = 0.5, absolute: float = 0.2) -> DataFrame:
    """The best section of each document; after the first, those below max(absolute, relative * best) go."""
    best = Window.partitionBy(query, doc).orderBy(F.desc("score"), "rank")
    one = sections.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    w = Window.partitionBy(query)
    place = F.row_number().over(w.orderBy(F.desc("score"), "rank", doc))
    kept = one.withColumn("_top", F.max("score").over(w)).withColumn("_p", place)
    kept = kept.where((F.col("_p") == 1) | (F.col("score") >= F.greatest(F.lit(absolute), relative * F.col("_top"))))
    return kept.withColumn("place", F.row_number().over(w.orderBy("_p"))).where(F.col("place") <= limit).drop("_top", "_p")


def min_max(df: DataFrame, group: str, col: str, out: str) -> DataFrame:
    """Scaled to [0, 1] in each group; in a flat group 1 where positive, else 0."""
    w = Window.partitionBy(group)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.when(hi - lo > 1e-12, (F.col(col) - lo) / (hi - lo)).otherwise(F.when(F.col(col) > 0, 1.0).otherwise(0.0)))


def lexical_relevance(phrase: Column, terms: Column, heading: Column, text: Column) -> Column:
    """0.55 for the phrase, 0.2 for it in the heading, 0.35 and 0.15 for the share of terms in text and heading; at most 1."""
    share = lambda s: F.aggregate(terms, F.lit(0), lambda n, x: n + F.contains(s, F.concat(F.lit(" "), x, F.lit(" "))).cast("int")) / F.greatest(F.size(terms), F.lit(1))
    whole = F.contains(text, phrase)
    score = F.when(whole, 0.55).otherwise(0.0) + F.when(whole & F.contains(heading, phrase), 0.2).otherwise(0.0) + 0.35 * share(text) + 0.15 * share(heading)
    return F.least(F.lit(1.0), score)


def fuse(semantic_rank: Column, lexical: Column, semantic: Column, top_semantic: Column) -> Column:
    """0.56 of the normalised reciprocal rank, 0.32 of the lexical score, 0.12 of the semantic score over the best."""
    return 0.56 * (61.0 / (60 + semantic_rank)) + 0.32 * lexical + 0.12 * F.when(top_semantic > 0, semantic / top_semantic).otherwise(0.0)


# ---- selection --------------------------------------------------------------------------------


def _runs(s: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of 6 characters (3 in a text of fewer than 6; the whole of a text of fewer than 3)."""
    if not s:
        return np.empty(0, np.int64)
    x = np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.uint64)
    k = min(len(x), 6 if len(x) >= 6 else 3)
    h = np.full(len(x) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ x[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _run_hashes(s: pd.Series) -> pd.Series:
    return s.map(_runs)


def shingles(text: Column) -> Column:
    """Hashes of the distinct 6-character runs of the lexical form (3 when short), of whole texts.

    The runs of a text are hashed at once, by the code points of the whole text; cutting them out one by one would walk it anew for each.
    """
    return _run_hashes(X.lexical(text))


#: Bits of an id inside one stretch: rows of neighbouring ids that meet in one task.
STRETCH_BITS = 8


def next_jaccard(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(a, b, jaccard) of each text and those of the next id (integers), over their runs; 0 where one has none.

    Texts travel once, to the stretch of their id (the first of a stretch to the one before it as well), and are hashed there in order of
    ids: a task holds the runs of two ids, and no run is shuffled or written.
    """
    kind, at = docs.schema[id_col].dataType.simpleString(), F.shiftright(F.col(id_col), STRETCH_BITS)
    stretches = F.when(F.shiftleft(at, STRETCH_BITS) == F.col(id_col), F.array(at - 1, at)).otherwise(F.array(at))
    dealt = docs.where(F.col(id_col).isNotNull()).select(id_col, X.lexical(F.col(text)).alias("_t"), F.explode(stretches).alias("_g"))
    return dealt.repartition("_g").sortWithinPartitions("_g", id_col).mapInArrow(_next_pairs, f"a {kind}, b {kind}, jaccard double")


def _next_pairs(batches):
    before: tuple = (None, None, [])
    here: tuple = (None, None, [])  # stretch, id, runs of each text of that id
    for batch in batches:
        out: list[tuple] = []
        for n, t, g in zip(*(c.to_pylist() for c in batch.columns)):
            if (g, n) != here[:2]:
                before, here = here, (g, n, [])
            runs = _runs(t)
            if before[0] == g and before[1] == n - 1:
                for other in before[2]:
                    both = len(np.intersect1d(other, runs, assume_unique=True))
                    out.append((before[1], n, both / (len(other) + len(runs) - both) if both else 0.0))
            here[2].append(runs)
        a, b, share = zip(*out) if out else ((), (), ())
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(share, pa.float64())], ["a", "b", "jaccard"])


def mmr(candidates: DataFrame, query: str, limit: int, diversity: float = 0.3, duplicate: float = 0.98, per_doc: int | None = None, penalty: float = 0.05) -> DataFrame:
    """Greedy marginal relevance inside each query's bounded candidate list (columns id, doc, score, rank, text).

    Near-equal texts collapse first; then (1 - d) * score - d * (largest similarity to a chosen one) ** 2 - penalty for
    each chosen section of the same document decides.  The order depends on earlier choices, hence one pass a query.
    """
    with_sets = candidates.withColumn("_s", shingles(F.col("text")))
    q_type, id_type, doc_type = (with_sets.schema[c].dataType.simpleString() for c in (query, "id", "doc"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["rank", "id"]).to_dict("records")
        for r in rows:
            r["_s"] = frozenset(r["_s"])
        sim = lambda a, b: len(a["_s"] & b["_s"]) / len(a["_s"] | b["_s"]) if a["_s"] and b["_s"] else 0.0
        unique = []
        for r in rows:
            if all(sim(r, u) < duplicate for u in unique):
                unique.append({**r, "_worst": 0.0})
        chosen: list[dict] = []
        docs: Counter = Counter()
        while unique and len(chosen) < limit:
            free = [r for r in unique if per_doc is None or docs[r["doc"]] < per_doc]
            if not free:
                break
            best = max(free, key=lambda r: ((1 - diversity) * min(1.0, max(0.0, r["score"])) - diversity * r["_worst"] ** 2 - penalty * docs[r["doc"]], -r["rank"]))
            unique.remove(best)
            chosen.append(best)
            docs[best["doc"]] += 1
            for r in unique:
                r["_worst"] = max(r["_worst"], sim(r, best))
        return pd.DataFrame([(r[query], r["id"], r["doc"], i + 1) for i, r in enumerate(chosen)], columns=[query, "id", "doc", "place"])

    return with_sets.groupBy(query).applyInPandas(run, f"{query} {q_type}, id {id_type}, doc {doc_type}, place int")


def pack(sections: DataFrame, query: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows that fit a token budget, in order; one that is too large is passed over and the next is tried."""
    seat = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    rows = F.array_sort(F.collect_list(F.struct(F.col("_seat"), F.col(tokens).cast("long").alias("_t"), F.struct(*sections.columns).alias("_row"))))
    folded = sections.withColumn("_seat", seat).groupBy(query).agg(rows.alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("CAST(array() AS array<int>)").alias("kept"))
    step = lambda a, r: F.when(
        a["used"] + r["_t"] <= budget, F.struct((a["used"] + r["_t"]).alias("used"), F.concat(a["kept"], F.array(r["_seat"])).alias("kept"))
    ).otherwise(a)
    kept = folded.select("_rows", F.aggregate("_rows", start, step)["kept"].alias("_kept"))
    each = kept.select(F.explode("_rows").alias("r"), "_kept").where(F.array_contains("_kept", F.col("r._seat")))
    return each.select("r._row.*")


def superseded_filter(df: DataFrame, query: str, text: str, asks_history: Column) -> DataFrame:
    """Drop texts marked as superseded unless the query asks for history or every hit of it is."""
    marked = F.lower(text).rlike(r"superseded|\[deprecated\]|\[obsolete\]|đã thay thế")
    d = df.withColumn("_m", marked).withColumn("_all", F.min(F.col("_m").cast("int")).over(Window.partitionBy(query)) == 1)
    return d.where(~F.col("_m") | F.col("_all") | asks_history).drop("_m", "_all")
