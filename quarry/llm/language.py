"""Language identification by the nearest of several TF-IDF centroids per language.

A text's vector counts its 1-, 2- and 3-character runs (lower case, anything but letters is one space), hashed
into DIMS cells, damped, weighted by inverse document frequency and normalised.  Document frequencies
cover every row that may be learnt from; the centroids come from a bounded sample (PER_LANGUAGE ids of each
language, smallest hash first; of rows that share an id, the smallest text), clustered by cosine into at most CENTROIDS
per language.  The sample reaches the driver as count vectors of DIMS cells, whatever the length of its texts.  The
nearest centroid names the language; a text whose cosine to it is below what REJECT of that centroid's own texts
reach is flagged ``rejected`` (its nearest language is named all the same).

Edge cases: a null text, or one without a letter, is 'und' with score 0 and rejected; with nothing to learn
from, every text is; rows without a language are never learnt from; a null doc_id is held out; repeated
rows get a row each.  Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, smallest, table, with_struct
from .toxicity import held_out

DIMS, PER_LANGUAGE, CENTROIDS, REJECT = 1 << 12, 400, 4, 0.002


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of character runs; none if the text has no letter."""
    if not text:
        return None
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if low.isascii():
        letters = (c >= 97) & (c <= 122)
    else:
        values, back = np.unique(c, return_inverse=True)
        letters = np.array([chr(v).isalpha() for v in values])[back]
    if not letters.any():
        return None
    c = np.where(letters, c, np.uint32(32))
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0xC2B2AE3D)
    keys = np.concatenate([c * np.uint32(0x165667B1), two, three])
    return np.bincount((keys ^ (keys >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIMS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each cell occurs, and the number of texts: DIMS + 1 sums, added up task by task first."""
    small_batches(docs.sparkSession)

    def run(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if (x := counts(text)) is not None:
                    df += x > 0
                    n += 1
        yield pa.record_batch([pa.array([*range(DIMS), DIMS], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["cell", "df"])

    rows = docs.select("text").mapInArrow(run, "cell int, df long").groupBy("cell").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r["cell"]] = r["df"]
    return out[:DIMS], int(out[DIMS])


class Model:
    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], floors: np.ndarray):
        self.idf, self.centroids, self.langs, self.floors = idf.astype(np.float32), centroids.astype(np.float32), langs, floors

    def vector(self, x: np.ndarray) -> np.ndarray:
        v = np.log1p(x.astype(np.float32)) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = counts(text) if self.langs else None
        if x is None:
            return "und", 0.0, True
        cos = self.centroids @ self.vector(x)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[best], score, bool(score < self.floors[best])


def cluster(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the mean's nearest text and then the farthest texts; returns centroids and members."""
    centres = [v[int(np.argmax(v @ v.mean(axis=0)))]]
    while len(centres) < min(k, len(v)):
        near = np.max(v @ np.array(centres).T, axis=1)
        if near.min() > 0.999:
            break
        centres.append(v[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(20):
        own = np.argmax(v @ c.T, axis=1)
        new = np.array([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c, np.argmax(v @ c.T, axis=1)


def fit(sample: list[tuple[str, np.ndarray]], df: np.ndarray, n: int) -> Model:
    """From (language, counts) of texts, and the cells' document frequencies over n texts."""
    idf = np.log((1 + n) / (1 + df)) + 0.1
    blank = Model(idf, np.zeros((0, DIMS)), [], np.zeros(0))
    found = [(lang, blank.vector(x)) for lang, x in sample]
    centroids, langs, floors = [], [], []
    for lang in sorted({lang for lang, _ in found}):
        v = np.array([x for name, x in found if name == lang])
        c, own = cluster(v, CENTROIDS)
        for i in range(len(c)):
            if (own == i).any():
                centroids.append(c[i])
                langs.append(lang)
                floors.append(float(np.quantile(v[own == i] @ c[i], REJECT)) * 0.5)
    return Model(idf, np.array(centroids).reshape(-1, DIMS), langs, np.array(floors))


def sample_counts(learn: DataFrame) -> list[tuple[str, np.ndarray]]:
    """(language, counts) of the bounded sample, in order of its ids' hashes."""
    small_batches(learn.sparkSession)
    key = F.md5(F.concat(F.lit("lang:"), F.col("doc_id").cast("string")))
    ids = smallest(learn.select("lang", key.alias("_k")).distinct(), PER_LANGUAGE, "lang")
    ids = F.broadcast(ids.select(F.col("lang").alias("_l"), F.col("_k").alias("_i")))  # PER_LANGUAGE narrow rows for each language name
    rows = learn.select("lang", "text", key.alias("_k")).join(ids, (F.col("lang") == F.col("_l")) & (F.col("_k") == F.col("_i")))
    rows = rows.groupBy("_k", "lang").agg(F.min("text").alias("text"))  # combined in each task first: a hot id is one row

    def run(batches):
        for b in batches:
            found = [counts(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([None if x is None else x.astype("<i4").tobytes() for x in found], pa.binary())], ["k", "lang", "counts"])

    out = rows.mapInArrow(run, "k string, lang string, counts binary").where("counts is not null").collect()
    out.sort(key=lambda r: (r["k"], r["lang"]))
    return [(r["lang"], np.frombuffer(r["counts"], "<i4")) for r in out]


def train(docs: DataFrame) -> Model:
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    df, n = document_frequencies(learn)
    return fit(sample_counts(learn), df, n)


FIELD = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def annotate(docs: DataFrame, model: Model, name: str = "_language") -> DataFrame:
    def make():
        def f(texts):
            out = [model.predict(t) for t in texts.to_pylist()]
            return pa.array([{"lang": a, "score": s, "rejected": r} for a, s, r in out], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

        return f

    return with_struct(docs, ["text"], name, FIELD, make)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    x = F.col("_language")
    return annotate(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"), x["rejected"].alias("rejected"))
