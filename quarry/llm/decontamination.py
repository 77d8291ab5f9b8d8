"""Benchmark decontamination by winnowing.

Of every 6 consecutive 5-word hashes the smallest is kept, in documents and in benchmark items alike, so any
10 words in a row that both hold leave them at least one fingerprint in common.  The fingerprints
are joined; a document that shares one with an item is compared with that item along the diagonals of the
common fingerprints, which extends each hit to its full length.  Items of fewer than 10 words are one
window each: their whole hash is looked up among all runs of that many words.

Benchmarks are small beside a corpus.  Up to ``most_bytes`` of item text (its size is checked) the items' fingerprints go to
every task as a sorted table, and one pass over the texts joins, extends and marks: nothing is shuffled.  A larger
benchmark meets the documents in a shuffled join of fingerprints, then pair by pair; the rows are the same.

Edge cases: null or empty texts have no words and no hits; an item without words is no window; rows that
repeat an item_id count as one item, with the windows of each; a null item_id counts as ''; repeated
documents get a row each; null and repeated doc_ids are told apart by their texts; an empty benchmark leaves every
document clean.  Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, fresh, gram_hashes, small_batches, table, with_struct

SPAN, GRAM = 10, 5
MOST_BYTES = 16 << 20  # of item texts and ids that may go to every task
#: Bytes to lower-cased word bytes: digits, letters and all of UTF-8's bytes from 0x80 on; the rest separates.
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
FIELD = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))]
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


def winnow(words: np.ndarray, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the smallest k-gram of each window; the last of equals, as published."""
    h = gram_hashes(words, k)
    w = span - k + 1
    if len(h) < w:
        return h[:0], np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.arange(len(windows)) + (w - 1) - np.argmin(windows[:, ::-1], axis=1))
    return h[at], at


def window_minima(words: np.ndarray, span: int = SPAN, k: int = GRAM) -> np.ndarray:
    """The smallest k-gram hash of each window, in order of the windows."""
    h = gram_hashes(words, k)
    n = len(h) - (span - k)
    if n <= 0:
        return h[:0]
    low = h[:n].copy()
    for j in range(1, span - k + 1):
        np.minimum(low, h[j : j + n], out=low)
    return low


def fingerprints(rows: DataFrame, id_col: str, short: tuple[int, ...], span: int = SPAN, item: bool = False) -> DataFrame:
    """(id, fps): distinct fingerprints of each text; for items, those of the lengths they are matched by."""
    small_batches(rows.sparkSession)

    def run(batches):
        known = WordHashes()
        for b in batches:
            flat, ends = [], [0]
            for text in b.column(1).to_pylist():
                w = known.of(words_of(text))
                if item:
                    fps = [gram_hashes(w, len(w))] if 0 < len(w) < span else [np.unique(window_minima(w, span))]
                else:
                    fps = [np.unique(window_minima(w, span)), *[np.unique(gram_hashes(w, n)) for n in short]]
                flat += fps
                ends.append(ends[-1] + sum(map(len, fps)))
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], [id_col, "fps"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, fps array<bigint>")


def short_lengths(bench: DataFrame, span: int = SPAN) -> tuple[int, ...]:
    """Word counts below ``span`` that items have: at most span - 1 numbers."""
    n = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    return tuple(sorted(r[0] for r in bench.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < span)).distinct().collect()))


def hits_in(doc: np.ndarray, item: np.ndarray, span: int = SPAN, k: int = GRAM) -> np.ndarray:
    """Starts in ``doc`` of the item's windows: common fingerprints, each extended along its diagonal."""
    size = min(span, len(item))
    if not size or len(doc) < size:
        return np.empty(0, np.int64)
    if len(item) < span:
        h, at = gram_hashes(item, len(item)), np.zeros(1, np.int64)
        own = gram_hashes(doc, len(item))
    else:
        h, at = winnow(item, span, k)
        own = gram_hashes(doc, k)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
    diagonals = set()
    for p in np.flatnonzero(hi > lo):
        diagonals.update((p - at[lo[p] : hi[p]]).tolist())
    found = []
    for d in diagonals:
        a, z = max(0, d), min(len(doc), d + len(item))
        same = np.concatenate([[0], np.cumsum(doc[a:z] == item[a - d : z - d])])
        found.append(a + np.flatnonzero(same[size:] - same[:-size] == size))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


class Index:
    """All items' word hashes, and a sorted table (fingerprint, item) for each length that fingerprints come in."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN):
        known = WordHashes()
        self.span, self.names = span, [i for i, _ in items]
        self.words = [known.of(words_of(t)) for _, t in items]
        rows: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if len(w):
                fps = gram_hashes(w, len(w)) if len(w) < span else np.unique(window_minima(w, span))
                rows.setdefault(min(len(w), span), []).append((fps, np.full(len(fps), i)))
        self.tables = {}
        for n, parts in rows.items():
            fps, owner = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
            order = np.argsort(fps, kind="stable")
            self.tables[n] = fps[order], owner[order]

    def candidates(self, w: np.ndarray) -> list[int]:
        found: set[int] = set()
        for n, (fps, owner) in self.tables.items():
            own = window_minima(w, self.span) if n == self.span else gram_hashes(w, n)
            at = np.searchsorted(fps, own)
            hit = np.unique(own[fps[np.minimum(at, len(fps) - 1)] == own])
            for lo, hi in zip(np.searchsorted(fps, hit, "left"), np.searchsorted(fps, hit, "right"), strict=True):
                found.update(owner[lo:hi].tolist())
        return sorted(found)


def _verdict(n_words: int, items: set[str], spans: list) -> dict:
    """Spans may overlap; they are merged."""
    hit = np.zeros(n_words + 1, np.int64)
    for a, z in spans:
        hit[a] += 1
        hit[z] -= 1
    covered = np.cumsum(hit[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return {"n_words": n_words, "n_hit": int(covered.sum()), "items": sorted(items), "spans": edges.reshape(-1, 2).tolist()}


def _spans(doc: np.ndarray, item: np.ndarray, span: int) -> list[tuple[int, int]]:
    size = min(span, len(item))
    return [(a, a + size) for a in hits_in(doc, item, span).tolist()]


def _look_up(index: Index):
    def make():
        known = WordHashes()

        def f(texts):
            out = []
            for text in texts.to_pylist():
                w = known.of(words_of(text))
                items, spans = set(), []
                for i in index.candidates(w):
                    if here := _spans(w, index.words[i], index.span):
                        items.add(index.names[i])
                        spans += here
                out.append(_verdict(len(w), items, spans))
            return out

        return f

    return make


def _pairwise(docs: DataFrame, bench: DataFrame, span: int) -> DataFrame:
    """(doc, items, spans) of the documents that are hit; doc is (doc_id, hash of the text), so rows that share it are equal."""
    doc = F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc")
    keyed = docs.select(doc, "text")
    theirs = fingerprints(bench, "item_id", (), span, item=True).select("item_id", F.explode("fps").alias("fp"))
    ours = fingerprints(keyed, "doc", short_lengths(bench, span), span).select("doc", F.explode("fps").alias("fp"))
    pairs = ours.join(theirs, "fp").select("doc", "item_id").distinct()
    texts = keyed.join(pairs.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    both = pairs.join(bench.select("item_id", F.col("text").alias("item")), "item_id").join(texts, "doc").select("doc", "item_id", "text", "item")

    def run(batches):
        known = WordHashes()
        for b in batches:
            spans = [_spans(known.of(words_of(t)), known.of(words_of(i)), span) for t, i in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["doc", "item_id", "spans"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    hits = both.mapInArrow(run, f"doc {keyed.schema['doc'].dataType.simpleString()}, item_id string, spans array<array<int>>")
    return hits.groupBy("doc").agg(F.collect_set("item_id").alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))


def annotate(docs: DataFrame, bench: DataFrame, name: str = "_decontamination", span: int = SPAN, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All of docs, and a struct of n_words, n_hit, items (ids that occur) and spans (word ranges hit)."""
    bench = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.length("text") > 0)
    size = bench.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if size <= most_bytes:
        return with_struct(docs, ["text"], name, FIELD, _look_up(Index([tuple(r) for r in bench.collect()], span)))
    items, spans = fresh(docs, "items"), fresh(docs, "spans")
    found = _pairwise(docs, bench, span).select("doc", F.col("items").alias(items), F.col("spans").alias(spans))
    on = docs["doc_id"].eqNullSafe(found["doc.doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(found["doc.hash"])
    both = docs.join(found, on, "left").select(*[docs[c] for c in docs.columns], items, spans)

    def make():
        return lambda texts, names, ranges: [_verdict(len(words_of(t)), set(n or ()), r or []) for t, n, r in zip(texts.to_pylist(), names.to_pylist(), ranges.to_pylist(), strict=True)]

    return with_struct(both, ["text", items, spans], name, FIELD, make).drop(items, spans)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("_decontamination")
    out = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", d["n_words"].alias("n_words"), d["n_hit"].alias("n_hit"), F.size(d["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(d["items"], ","), 256).alias("items_sha256"), (d["n_hit"] > 0).alias("contaminated"),
    )


#: Plain DuckDB SQL for the same rows: every window of every text, word for word.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wi AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
h AS MATERIALIZED (SELECT rid, i, k, item FROM (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wi) WHERE len(w) >= k)) JOIN wi USING (k, win)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def brute_force(docs: list[tuple], bench: list[tuple], span: int = SPAN) -> dict:
    """doc_id -> (n_words, n_hit, n_items, sha256) by plain comparison of word lists, for tests."""
    windows: dict[tuple, set] = {}
    for item_id, text in bench:
        w = words_of(text)
        for i in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + span]), set()).add("" if item_id is None else str(item_id))
    out = {}
    for doc_id, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[key]
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out
