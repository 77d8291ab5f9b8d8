"""Toxicity by a gap-weighted subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel compares words: a unit is a word (white space around it), with signs inside it left out, or a run of single
characters that spaces pull apart.  A unit's features are its 3-character subsequences within SPAN characters
(a mark stands before its first), each weighted DECAY ** (characters spanned); the kernel is their
cosine, so inserted or missing characters change it little.  A sentence is as toxic as its worst unit.

Training takes sentences of a bounded sample of labelled texts (MAX_TEXTS of each class, MAX_BYTES in all).  A label marks a
text, so which sentence of a toxic text earns it is learnt (multiple-instance learning): the first guess weighs subsequences
by their log odds of standing in toxic texts; then, ROUNDS times, each toxic text gives the sentence whose worst unit scores
highest as a positive example, every sentence of the other texts is a negative one, and a squared-hinge machine is fitted over
Nystroem features, whose landmarks are units of the positive sentences and of ordinary ones, spread by the kernel itself.
A text's evidence is its three worst units and how many are on the toxic side; a logistic curve over these, fitted to the
labelled texts, is its score.  Over landmarks L with coefficients a, sum_j a_j K(s, L_j) is one weight for each
subsequence, so a unit is scored by table lookups, in time linear in its length, and each distinct unit once in a task's memory.

Edge cases: a null, empty or wordless text scores as a unit without features; units longer than
UNIT characters are read in overlapping windows; without enough positive labels every score is near 0; repeated rows get
a row each; a null doc_id counts as held out; of rows that share an id the smallest text is learnt from; an id with
both labels counts as toxic; labels are null-safe.  Extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, smallest, table, with_struct

SPAN, DECAY, UNIT = 6, 0.6, 24
MAX_TEXTS, MAX_BYTES = 2000, 24 << 20  # labelled texts of each class, and bytes of all of them, that training reads
TOXIC_LANDMARKS, PLAIN_LANDMARKS, ROUNDS, LEAST, CLOSE = 160, 64, 4, 3, 0.8
CACHE = 120_000
MARK = "^"
_CODES = 64
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is a multiple of 5; those rows are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def units_of(text: str | None) -> set[str]:
    """Distinct units of a text: words in lower case, letters and digits only, long ones in windows."""
    if not text:
        return set()
    low = text.lower()
    words = set(low.split())
    if sum(1 for w in words if len(w) == 1) > 2:
        words.update(m.replace(" ", "") for m in _SPACED.findall(low))
    out = set()
    for w in words:
        if not w.isalnum():
            w = "".join([c for c in w if c.isalnum()])
        if len(w) <= UNIT:
            out.add(w)
        else:
            out.update(w[i : i + UNIT] for i in range(0, len(w) - UNIT // 2, UNIT // 2))
    out.discard("")
    return out


def sentences_of(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


def _char_codes(text: str) -> np.ndarray:
    """a-z are 1 to 26, 0-9 are 27 to 36, the mark before a unit is 37, other characters share 38 to 63; 0 parts units."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = 38 + (c * np.uint32(2654435761) >> np.uint32(16)) % 26
    out = np.where(c == 94, 37, out)
    out = np.where((c >= 97) & (c <= 122), c - 96, out)
    out = np.where((c >= 48) & (c <= 57), c - 21, out)
    return np.where(c == 10, 0, out).astype(np.int64)


_OFFSETS = [(i, j, DECAY ** (j + 1)) for j in range(2, SPAN) for i in range(1, j)]


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit number, subsequence, weight), summed over equal subsequences of a unit."""
    pad = "\n" * SPAN
    codes = _char_codes(pad.join(units) + pad)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    owner = np.repeat(np.arange(len(units)), lengths + SPAN)
    n = len(codes) - SPAN
    keys, weights = [], []
    for i, j, w in _OFFSETS:
        a, b, c = codes[:n], codes[i : n + i], codes[j : n + j]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        keys.append((owner[at] << 18) | (a[at] << 12) | (b[at] << 6) | c[at])
        weights.append(np.full(len(at), w))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, keys, weights
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, weights = keys[first], np.add.reduceat(weights, first)
    return keys >> 18, keys & ((1 << 18) - 1), weights


def _normalised(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, key, w = subsequences(units)
    norm = np.sqrt(np.bincount(owner, w * w, len(units)))
    return owner, key, w / norm[owner] if len(owner) else w


class Model:
    """f(unit) = <beta, features> + bias; a text's score is logistic in ``evidence`` of its units' f."""

    def __init__(self, beta: np.ndarray, bias: float, landmarks: list[str]):
        self.beta, self.bias, self.landmarks = beta, bias, landmarks
        self.mean, self.scale, self.text = np.zeros(5), np.ones(5), np.array([0, 0, 0, 0, 0, -5.0])

    def units(self, units: list[str], batch: int = 4000) -> np.ndarray:
        out = [np.empty(0)]
        for i in range(0, len(units), batch):
            owner, key, w = _normalised([MARK + u for u in units[i : i + batch]])
            out.append(np.bincount(owner, w * self.beta[key], len(units[i : i + batch])) + self.bias)
        return np.concatenate(out)

    def evidence(self, f: np.ndarray) -> np.ndarray:
        low = self.bias - 1
        top = np.full(3, low)
        best = np.sort(f if len(f) <= 3 else np.partition(f, len(f) - 3)[-3:])[::-1]
        top[: len(best)] = np.clip(best, low, 2)
        return np.array([*top, np.log1p((f > 0).sum()), np.log1p(len(f))])

    def score(self, f: np.ndarray) -> float:
        x = (self.evidence(f) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.text[:-1] + self.text[-1], -40, 40))))


def log_odds(units: list[str], df: np.ndarray, batch: int = 4000) -> np.ndarray:
    """For each subsequence, the log odds that it comes from a toxic text; df counts texts by class and unit.  Rare ones are drawn to 0."""
    seen = np.zeros((2, 1 << 18))
    for i in range(0, len(units), batch):
        owner, key, _ = _normalised([MARK + u for u in units[i : i + batch]])
        for t in (0, 1):
            seen[t] += np.bincount(key, df[t][i : i + batch][owner], 1 << 18)
    total = seen.sum(axis=1, keepdims=True)
    prior = seen.sum(axis=0) / max(1.0, total.sum())
    share = (seen + 20 * prior) / (total + 20)
    return np.log(np.maximum(share[1], 1e-12) / np.maximum(share[0], 1e-12))


def spread(units: list[str], most: int) -> list[str]:
    """At most ``most`` of the units, in order, passing over those that the kernel finds close to a chosen one."""
    owner, key, w = _normalised([MARK + u for u in units])
    used, key = np.unique(key, return_inverse=True)
    first = np.searchsorted(owner, np.arange(len(units) + 1))
    chosen, table = [], np.zeros((most, len(used)), np.float32)
    for i, u in enumerate(units):
        k, x = key[first[i] : first[i + 1]], w[first[i] : first[i + 1]]
        if len(k) and len(chosen) < most and (not chosen or (table[: len(chosen), k] @ x).max() < CLOSE):
            table[len(chosen), k] = x
            chosen.append(u)
    return chosen


def _squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Primal support vector machine by Newton steps over the rows inside the margin (last column: bias)."""
    w = np.zeros(z.shape[1])
    eye = np.eye(z.shape[1]) * ridge * weight.sum()
    eye[-1, -1] = 1e-9
    for _ in range(30):
        margins = np.concatenate([z[i : i + 4000] @ w for i in range(0, len(z), 4000)])
        on = np.flatnonzero(y * margins < 1)
        gram, target = eye.copy(), np.zeros(z.shape[1])
        for i in range(0, len(on), 4000):  # a few rows at a time in double precision
            here = on[i : i + 4000]
            zo = z[here].astype(float)
            gram += zo.T @ (zo * weight[here][:, None])
            target += zo.T @ (y[here] * weight[here])
        new = np.linalg.solve(gram, target)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def kernel(a: str, b: str) -> float:
    """The kernel of two units, from their features; tests hold it against its definition."""
    _, ka, wa = _normalised([MARK + a])
    _, kb, wb = _normalised([MARK + b])
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return float((wa[i] * wb[j]).sum())


class Nystroem:
    """Features of units from their kernels with the landmarks: K(unit, landmarks) K(landmarks, landmarks)^(-1/2), up to a rotation."""

    def __init__(self, landmarks: list[str]):
        owner, key, w = _normalised([MARK + u for u in landmarks])
        self.landmarks, self.used = landmarks, np.unique(key)
        self.small = np.full(1 << 18, -1)
        self.small[self.used] = np.arange(len(self.used))
        self.table = np.zeros((len(self.used), len(landmarks)))
        self.table[self.small[key], owner] = w
        values, vectors = np.linalg.eigh(self.table.T @ self.table)
        self.root = vectors / np.sqrt(np.maximum(values, 1e-4))

    def features(self, units: list[str], batch: int = 2000) -> np.ndarray:
        out = np.ones((len(units), len(self.landmarks) + 1), np.float32)
        for at in range(0, len(units), batch):
            part = units[at : at + batch]
            owner, key, w = _normalised([MARK + u for u in part])
            on = np.flatnonzero(self.small[key] >= 0)
            k = np.zeros((len(part), len(self.landmarks)))
            for i in range(0, len(on), 20_000):
                here = on[i : i + 20_000]
                rows, first = np.unique(owner[here], return_index=True)
                k[rows] += np.add.reduceat(self.table[self.small[key[here]]] * w[here][:, None], first, axis=0)
            out[at : at + batch, :-1] = k @ self.root
        return out

    def model(self, solved: np.ndarray) -> Model:
        beta = np.zeros(1 << 18)
        beta[self.used] = self.table @ (self.root @ solved[:-1])
        return Model(beta, float(solved[-1]), self.landmarks)


class Bags:
    """Unit numbers of many sentences or texts, one after the other."""

    def __init__(self, lists: list[list[int]]):
        lists = [x for x in lists if x]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.units = np.fromiter((u for x in lists for u in x), np.int32, int(self.sizes.sum()))

    def worst(self, f: np.ndarray) -> Counter:
        """How many bags have each unit as their unit of the highest f (the first of equals)."""
        if not len(self.sizes):
            return Counter()
        of = f[self.units]
        starts = np.cumsum(self.sizes) - self.sizes
        top = np.flatnonzero(of == np.repeat(np.maximum.reduceat(of, starts), self.sizes))
        _, first = np.unique(np.repeat(np.arange(len(starts)), self.sizes)[top], return_index=True)
        units, n = np.unique(self.units[top[first]], return_counts=True)
        return Counter(dict(zip(units.tolist(), n.tolist(), strict=True)))


def fit(texts: list[str], toxic: list[bool]) -> Model:
    number: dict[str, int] = {}
    whole, plain = [], []
    for t, y in zip(texts, toxic, strict=True):
        own = [sorted(number.setdefault(u, len(number)) for u in units_of(s)) for s in sentences_of(t)]
        whole.append(np.array(sorted({u for s in own for u in s}), np.int32))
        plain += [] if y else own
    plain = Bags(plain)
    units, truth = list(number), np.array(toxic, bool)
    del number
    told_by = Bags([b.tolist() for b, y in zip(whole, toxic, strict=True) if y])
    if len(told_by.sizes) < LEAST:
        return Model(np.zeros(1 << 18), -1.0, [])
    df = np.zeros((2, len(units)), np.float32)
    for b, y in zip(whole, toxic, strict=True):
        df[int(y)][b] += 1
    f = Model(log_odds(units, df), 0.0, []).units(units)
    del df
    model = Model(np.zeros(1 << 18), -1.0, [])
    give_back()
    for _ in range(ROUNDS):
        told, held = told_by.worst(f), plain.worst(f)
        common = sorted(held, key=lambda i: hash_of(units[i]))
        landmarks = spread([units[i] for i, _ in sorted(told.items(), key=lambda x: (-x[1], hash_of(units[x[0]])))], TOXIC_LANDMARKS)
        landmarks += spread([units[i] for i in common if i not in told][: 8 * PLAIN_LANDMARKS], PLAIN_LANDMARKS)
        map_ = Nystroem(landmarks)
        y = np.array([1.0] * len(told) + [-1.0] * len(held))
        weight = np.array([*told.values(), *held.values()], float)
        weight /= np.where(y > 0, weight[: len(told)].sum(), max(1.0, weight[len(told) :].sum()))
        model = map_.model(_squared_hinge(map_.features([units[i] for i in (*told, *held)]), y, weight))
        f = model.units(units)
    x = np.array([model.evidence(f[b]) for b in whole])
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.text = _logistic((x - model.mean) / model.scale, truth.astype(float))
    return model


def hash_of(unit: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(unit)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MAX_TEXTS, most_bytes: int = MAX_BYTES) -> list[tuple[str, bool]]:
    """At most ``most`` texts of each class and ``most_bytes`` bytes of each class's half, smallest hash of the id first; held-out rows never."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    key = F.md5(F.concat(F.lit("tox:"), F.col("_id").cast("string")))
    ids = smallest(lab.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_k", key), most, "_y")
    ids = F.broadcast(ids)  # at most 2 * most narrow rows
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).groupBy("_y", "_k").agg(F.min("text").alias("text"))  # a hot id is one row
    upto = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("_y").orderBy("_k"))  # of those few rows
    rows = texts.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes // 2).select("_k", "text", "_y").collect()
    rows.sort(key=lambda r: r["_k"])
    return [(r["text"] or "", bool(r["_y"])) for r in rows]


FIELD = T.DoubleType()


def annotate(docs: DataFrame, model: Model, name: str = "_toxicity") -> DataFrame:
    """All of docs, and the score (0 to 1) of each text."""

    def make():
        known: dict[str, float] = {}

        def f(texts):
            nonlocal known
            if len(known) > CACHE:
                known = {}
            bags = [units_of(t) for t in texts.to_pylist()]
            new = list({u for b in bags for u in b if u not in known})
            known.update(zip(new, model.units(new).tolist(), strict=True))
            return pa.array([model.score(np.fromiter(map(known.__getitem__, b), float, len(b))) for b in bags], pa.float64())

        return f

    return with_struct(docs, ["text"], name, FIELD, make)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    texts, toxic = [t for t, _ in sample], [y for _, y in sample]
    del sample
    give_back()
    model = fit(texts, toxic)
    del texts
    give_back()
    return model


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = annotate(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))
