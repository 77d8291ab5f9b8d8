"""Quality rules with risk-controlled thresholds.

Base rules (too few words, too many repeated 3-word windows) come first.  For the rest, a logistic score over
counted features, learnt from half of the labelled rows, ranks texts; the other half, the holdout, chooses a
cutoff for each stratum (language): walking from the laxest cutoff to stricter ones, a cutoff passes while the exact
(Clopper-Pearson) upper bound of the share of good texts it rejects stays at or below ALPHA.  The walk is a fixed
sequence, so all cutoffs of its passing prefix hold at once; strata share the error DELTA (Bonferroni), so with
probability 1 - DELTA no stratum loses more than ALPHA of its good texts.  Among those that pass, the one that
rejects most bad texts for the good ones it costs is taken.  A stratum without evidence rejects nothing.

Edge cases: a null text counts nothing and fails the base rule, as does an empty one; a null language is a stratum
of its own; a stratum unseen in the holdout keeps what the base rules keep; without labels of both kinds the base rules
decide alone; labels that repeat a doc_id with another verdict each count; a null doc_id gets a verdict like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, gram_hashes, smallest, stage, table, with_struct

MIN_WORDS, MAX_REPEAT = 50, 50  # words; per cent of words in repeated windows
ALPHA, DELTA, GRID = 0.02, 0.05, 200
MAX_FIT = 20_000  # labelled rows that the score is fitted on
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELD = T.StructType([T.StructField(c, T.LongType()) for c in [*BASE, "n_lines", "n_distinct", "n_upper", "n_digits"]])


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """Words inside k-word windows that the text holds twice or more."""
    g = gram_hashes(h, k)
    if not len(g):
        return 0
    _, back, n = np.unique(g, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[back] > 1)
    hit = np.zeros(len(h) + 1, np.int64)
    np.add.at(hit, at, 1)
    np.subtract.at(hit, at + k, 1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def features(text: str | None, known: WordHashes) -> tuple[int, ...]:
    if not text:
        return (0,) * len(FIELD)
    raw = text.encode()
    h = known.of(raw.split())
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    chars = len(text) - int(b[[9, 10, 11, 12, 13, 32]].sum())
    return (len(h), chars, int(b[[ord(c) for c in SYMBOLS]].sum()), dup, repeated_words(h), lines, len(np.unique(h)), int(b[65:91].sum()), int(b[48:58].sum()))


def measure(docs: DataFrame, name: str = "_quality") -> DataFrame:
    def make():
        known = WordHashes()

        def f(texts):
            cols = list(zip(*[features(t, known) for t in texts.to_pylist()], strict=True)) or [()] * len(FIELD)
            return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], FIELD.names)

        return f

    return with_struct(docs, ["text"], name, FIELD, make)


def _inputs(q) -> list:
    """Features of the score, each between 0 and about 1, for a struct column or for a dict of arrays."""
    words = F.greatest(q["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(q["word_chars"], F.lit(1)).cast("double")
    share = [q["n_symbols"] / words, q["n_symbols"] / chars, q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)), q["n_repeat_words"] / words, q["n_distinct"] / words]
    return [F.least(x.cast("double"), F.lit(2.0)) for x in [*share, q["n_upper"] / chars, q["n_digits"] / chars, chars / words / 10, words / F.greatest(q["n_lines"], F.lit(1)) / 100]]


def base_failed(q):
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT * q["n_words"])


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz).

    The number of terms grows with the square root of a and b, so ten million labels take some thousands.
    """
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny = 1e-300
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    c, out, m = 1.0, d, 0
    while m < 1_000_000:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) * out / a


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest share under which k or fewer of n still has probability delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(1 - mid, n - k, k + 1) > delta else (lo, mid)
    return hi


def within_risk(k: int, n: int, alpha: float, delta: float) -> bool:
    """binomial_upper(k, n, delta) <= alpha, with one evaluation: k or fewer of n has probability delta at most under alpha."""
    return 0 < n and k < n and beta_cdf(1 - alpha, n - k, k + 1) <= delta


def choose_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int:
    """Histograms of the holdout's score buckets -> number of lowest buckets to reject (0: none)."""
    n, worth = int(good.sum()), (0.0, 0)
    lost = caught = 0
    for i in range(len(good) - 1):
        lost, caught = lost + int(good[i]), caught + int(bad[i])
        if not within_risk(lost, n, alpha, delta):
            break
        gain = caught / max(1, bad.sum()) - 5 * lost / max(1, n)
        if gain > worth[0] + 1e-12:
            worth = (gain, i + 1)
    return worth[1]


def _half() -> F.Column:
    return F.crc32(F.concat(F.lit("half:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) % 2


def fit_score(rows: list) -> np.ndarray | None:
    """Logistic weights (last: bias) over standardised inputs, folded back to raw inputs."""
    from .toxicity import _logistic

    if not rows:
        return None
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], float)
    if y.min() == y.max():
        return None
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = _logistic((x - mean) / sd, y, ridge=1.0)
    return np.concatenate([w[:-1] / sd, [w[-1] - (w[:-1] * mean / sd).sum()]])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, name: str = "_quality") -> DataFrame:
    """doc_id, the stratum, the counted struct, ``_base_failed``, ``_score`` and ``_kept``: a row for each row of docs.

    Every text is read once; what is counted is written, and labels meet those narrow rows, never the texts.
    """
    spark = docs.sparkSession
    measured = stage(measure(docs.select("doc_id", stratum, "text"), name).drop("text"))
    q = F.col(name)
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y is not null").distinct()
    known = measured.where(~base_failed(q)).join(lab, F.col("doc_id") == F.col("_id"))
    known = stage(known.select("doc_id", F.col(stratum).alias("_stratum"), "_y", F.array(*_inputs(q)).alias("_x"), _half().alias("_h")))
    # equal rows (one id, one verdict, one text's counts) teach once, so a hot id is one row of the sample
    rows = known.where("_h = 0").select("doc_id", "_x", "_y").distinct()
    key = F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("_y"), F.lit(":"), F.col("_x").cast("string")))
    sample = sorted(smallest(rows.select(key.alias("_k"), F.lit(0).alias("_all"), "_x", "_y"), MAX_FIT, "_all").collect(), key=lambda r: r["_k"])
    w = fit_score([[*r["_x"], r["_y"]] for r in sample])
    if w is None:
        return measured.withColumn("_base_failed", base_failed(q)).withColumn("_score", F.lit(1.0)).withColumn("_kept", ~base_failed(q))

    def score(x: list):
        z = F.lit(float(w[-1]))
        for a, b in zip(x, w[:-1].tolist(), strict=True):
            z = z + a * F.lit(b)
        return 1 / (1 + F.exp(-z))

    bucket = lambda s: F.least(F.floor(s * GRID), F.lit(GRID - 1)).cast("int")
    held = known.where("_h = 1").select("_stratum", "_y", bucket(score([F.col("_x")[i] for i in range(len(w) - 1)])).alias("_b"))
    tally = held.groupBy("_stratum", "_y", "_b").count().collect()  # strata x 2 x GRID rows at most
    strata = sorted({r["_stratum"] for r in tally}, key=lambda s: (s is None, s))
    cuts = []
    for s in strata:
        h = np.zeros((2, GRID), np.int64)
        for r in tally:
            if r["_stratum"] == s:
                h[r["_y"]][r["_b"]] += r["count"]
        cuts.append((s, choose_cutoff(h[1], h[0], alpha, delta / len(strata))))
    kind = T.StructType([T.StructField("_s", docs.schema[stratum].dataType), T.StructField("_cut", T.IntegerType())])
    cut = spark.createDataFrame(cuts, kind)
    out = measured.join(F.broadcast(cut), F.col(stratum).eqNullSafe(F.col("_s")), "left").drop("_s")  # a row for each stratum
    failed, s = base_failed(q), score(_inputs(q))
    out = out.withColumn("_base_failed", failed).withColumn("_score", s)
    return out.withColumn("_kept", ~F.col("_base_failed") & (bucket(F.col("_score")) >= F.coalesce("_cut", F.lit(0)))).drop("_cut")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    q = F.col("_quality")
    return judge(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", *[q[c].alias(c) for c in BASE], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_score").alias("score"), "lang"
    )
