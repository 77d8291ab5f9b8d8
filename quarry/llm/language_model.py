"""Scoring by a log-bilinear neural language model.

The model predicts a slot from the three tokens before it: the slots are the ``VOCABULARY`` most frequent tokens and, for all others,
64 classes by how a word ends.  Each slot has a vector as context and one as target; a context vector is the sum of its
tokens' vectors, each through a matrix of its place, and a slot's score is the product with its target vector
plus a bias.  A word outside the vocabulary gets its class's probability times its share of the class by training counts, one
added; a word that training never saw is one more word of its class.  So the probabilities of all words add up to 1.

Training is noise-contrastive, in numpy: slots drawn from the unigram distribution are told from real ones, which needs no sum over
slots.  Every position of every training text is used once, a third in each round; in a round each task starts from the same
parameters, and the steps of all tasks are averaged, weighed by their positions, as integers, in Spark.  Scoring
takes the full softmax; a context's sum over all slots comes from tables of exponentials, once while a task remembers it.

Counts cover every training token.  What goes to the driver has a fixed size: the vocabulary, the classes' sums, the parameters.
Counts of the ``FREQUENT`` most frequent words go to every task; the other words, each too rare to be a hot key, meet their counts in
a shuffled join.

Edge cases: a null or empty text is the end token alone; null doc_ids are never held out; repeated rows are texts of their own;
without training texts every token has c = 0, N = V = 0, and the model is the untrained one; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, frequent_from, give_back, small_batches, stage, table

VOCABULARY, CLASSES, CONTEXT, DIMS = 448, 64, 3, 16
SLOTS = VOCABULARY + CLASSES
#: Context slot of the places before a text.
START = SLOTS
ROUNDS, BATCH, NOISE, RATE = 3, 1024, 96, 0.2
#: Words whose counts may go to every task.
FREQUENT = 1 << 19
AT_ONCE, GROUP = 128, 1 << 16  # contexts whose softmax is taken at once, tokens whose contexts are told apart at once
NORM_BITS = 21  # contexts whose sum is remembered in a task, as a power of two
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
STEP = 1 << 20  # parameters' steps are added up as multiples of 1 / STEP


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


class WordKeys(WordHashes):
    """A word's key: 58 bits of its hash, then its class, a hash of its last two bytes."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = k = xxhash.xxh64_intdigest(word) & ~(CLASSES - 1) | zlib.crc32(word[-2:]) % CLASSES
        return k


#: No word is empty, so this key is free for the end of a text.
END = int(np.uint64(WordKeys()[b""]).view(np.int64))


@cache
def _classes() -> np.ndarray:
    """The class of a word by its last two bytes; from 1 << 16 on, of words of one byte."""
    ends = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([b]) for b in range(256)]
    return np.array([zlib.crc32(x) % CLASSES for x in ends], np.uint64)


def word_keys(words: pa.Array) -> np.ndarray:
    """The keys of different words, none of them empty, as WordKeys has them."""
    import xxhash

    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.empty(0, np.uint8)
    last, before = data[ends[1:] - 1].astype(np.int64), data[np.maximum(ends[1:] - 2, 0)].astype(np.int64)
    kind = _classes()[np.where(np.diff(ends) > 1, before * 256, 1 << 16) + last]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))
    return (hashes & ~np.uint64(CLASSES - 1) | kind).view(np.int64)


def token_keys(texts: pa.Array) -> list[np.ndarray]:
    """The keys of each text's words, and END.  Arrow cuts the texts and numbers their different words, so each of these is hashed once."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = cut.flatten(), cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
    real = pc.binary_length(words).to_numpy() > 0
    if not real.all():  # white space at an end of a text
        words, ends = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]
    own = words.dictionary_encode()
    keys = np.insert(word_keys(own.dictionary)[own.indices.to_numpy()], ends, END)
    return np.split(keys, (ends + np.arange(1, len(ends) + 1))[:-1]) if len(ends) else []


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def bags(docs: DataFrame) -> DataFrame:
    """(row, doc_id, held_out, keys, tf, places): the distinct tokens of each text, how often they stand in it, and where."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        for b in batches:
            keys, tf, ends, places = [], [], [0], []
            for tokens in token_keys(b.column(2)):
                own, place, n = np.unique(tokens, return_inverse=True, return_counts=True)
                keys.append(own)
                tf.append(n.astype(np.int32))
                ends.append(ends[-1] + len(own))
                places.append(place.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((keys, pa.int64()), (tf, pa.int32()))]
            yield pa.record_batch([b.column(0), b.column(1), *lists, pa.array(places, pa.binary())], ["doc_id", "held_out", "keys", "tf", "places"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, keys array<bigint>, tf array<int>, places binary")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()))


def _each(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("tf").alias("tf"))))


def token_counts(rows: DataFrame) -> DataFrame:
    """(key, c) of the training tokens."""
    return stage(_each(rows.where(~F.col("held_out"))).groupBy("key").agg(F.sum("tf").alias("c")))


class Lexicon:
    """The slots, and what the counts say about them; of fixed size."""

    def __init__(self, counts: DataFrame):
        n, v = counts.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = n or 0, v
        top = counts.orderBy(F.desc("c"), "key").limit(VOCABULARY).collect()
        self.keys = np.sort(np.array([r["key"] for r in top], np.int64))
        found = {r["key"]: r["c"] for r in top}
        mass = np.zeros(SLOTS)
        mass[: len(top)] = [found[k] for k in self.keys.tolist()]
        self.share = np.ones(CLASSES)  # of a class: its words' counts, one added to each, and one unseen word
        rest = counts.where(~F.col("key").isin(self.keys.tolist())).groupBy(F.pmod("key", F.lit(CLASSES)).cast("int").alias("k"))
        for r in rest.agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
            self.share[r["k"]] += r["c"] + r["n"]
            mass[VOCABULARY + r["k"]] = r["c"]
        self.unigram = (mass + 1) / (mass.sum() + SLOTS)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        rest = VOCABULARY + (keys & (CLASSES - 1))
        if not len(self.keys):
            return rest
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, rest)


class Model:
    """Parameters in one flat array, and views of it."""

    SHAPES = (("context", (SLOTS + 1, DIMS)), ("target", (SLOTS, DIMS)), ("bias", (SLOTS,)), ("matrix", (CONTEXT, DIMS, DIMS)))

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(math.prod(shape) for _, shape in cls.SHAPES)

    @classmethod
    def start(cls, unigram: np.ndarray) -> Model:
        m = cls(np.random.default_rng(13).normal(0, 0.1, cls.size()).astype(np.float32))
        m.bias[:] = np.log(unigram)
        m.matrix[:] = np.eye(DIMS) + m.matrix * 0.1
        return m

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.context[contexts[:, i]] @ self.matrix[i] for i in range(CONTEXT))

    def log10(self, contexts: np.ndarray, slots: np.ndarray, norms: Norms | None = None) -> np.ndarray:
        """log10 of the slots' normalised probabilities; the normaliser of a context is worked out once while it is remembered."""
        norms = Norms(self, 0) if norms is None else norms
        code = contexts[:, 0].astype(np.int64)
        for i in range(1, CONTEXT):
            code = code * (SLOTS + 1) + contexts[:, i]
        own = self.bias[slots] + sum(x[contexts[:, i], slots] for i, x in enumerate(norms.logs))
        return (own.astype(float) - norms.of(code)) / math.log(10)


class Norms:
    """Logs of the sums over all slots, by context; 1 << bits of those met before are remembered, each at a place that its code gives.

    A slot's score is a sum of one number for each place of the context, so its exponential is a product of numbers from tables.
    """

    def __init__(self, model: Model, bits: int = NORM_BITS):
        self.bits, self.bias = bits, model.bias
        self.codes, self.norms = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.float32)
        self.logs = [model.context @ m @ model.target.T for m in model.matrix]
        self.near = sum(float(np.abs(x).max()) for x in [*self.logs, model.bias]) < 60  # no product can overflow
        self.factors = [np.exp(x) for x in self.logs] if self.near else []
        if self.near:
            self.factors[0] *= np.exp(model.bias)

    def of(self, code: np.ndarray) -> np.ndarray:
        place = (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
        out, new = self.norms[place], np.flatnonzero(self.codes[place] != code)
        if len(new):
            codes, at = np.unique(code[new], return_inverse=True)
            found = self.worked_out(codes)
            out[new] = found[at]
            place = (codes * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
            last = np.unique(place[::-1], return_index=True)[1]  # one code a place
            self.codes[place[::-1][last]], self.norms[place[::-1][last]] = codes[::-1][last], found[::-1][last]
        return out

    def worked_out(self, codes: np.ndarray) -> np.ndarray:
        rest, slots = codes, []
        for _ in range(CONTEXT):
            rest, slot = np.divmod(rest, SLOTS + 1)
            slots.insert(0, slot)
        norm = np.empty(len(codes), np.float32)
        product, factor = (np.empty((AT_ONCE, SLOTS), np.float32) for _ in range(2))
        for a in range(0, len(codes), AT_ONCE):
            at = [x[a : a + AT_ONCE] for x in slots]
            if self.near:
                x, y = product[: len(at[0])], factor[: len(at[0])]
                self.factors[0].take(at[0], axis=0, out=x, mode="clip")
                for f, i in zip(self.factors[1:-1], at[1:-1], strict=True):
                    x *= f.take(i, axis=0, out=y, mode="clip")
                norm[a : a + AT_ONCE] = np.log(np.einsum("ij,ij->i", x, self.factors[-1].take(at[-1], axis=0, out=y, mode="clip")))
            else:
                scores = self.bias + sum(f[i] for f, i in zip(self.logs, at, strict=True))
                top = scores.max(axis=1)
                norm[a : a + AT_ONCE] = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
        return norm


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values added up by row."""
    d = values.shape[1]
    at = rows.astype(np.int64)[:, None] * d + np.arange(d)
    return np.bincount(at.reshape(-1), values.reshape(-1), n * d).reshape(n, d).astype(np.float32)


def contrast(model: Model, past: np.ndarray, contexts: np.ndarray, slots: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
    """One step: real slots against noise that all positions of the batch share.  ``past`` sums up squared gradients."""
    h = model.hidden(contexts)
    target, drawn = model.target[slots], model.target[noise]
    up = np.einsum("ij,ij->i", h, target)  # how far each is from being told apart, in place
    up += model.bias[slots] - log_noise[slots]
    down = h @ drawn.T
    down += model.bias[noise] - log_noise[noise]
    np.negative(down, out=down)
    with np.errstate(over="ignore"):
        for x in (up, down):
            np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
    grad = Model(np.zeros_like(model.flat))
    grad.target[:] = _summed(slots, up[:, None] * h, SLOTS)
    np.subtract.at(grad.target, noise, down.T @ h)
    np.add.at(grad.bias, slots, up)
    np.subtract.at(grad.bias, noise, down.sum(axis=0))
    back = up[:, None] * target - down @ drawn
    for i in range(CONTEXT):
        own = _summed(contexts[:, i], back, SLOTS + 1)
        grad.matrix[i] = model.context.T @ own
        grad.context += own @ model.matrix[i].T
    g = grad.flat / len(slots)
    past += g * g
    model.flat += RATE * g / np.sqrt(past + 1e-6)


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the most frequent words, at most FREQUENT, in order of the keys."""
    rows = counts.where(F.col("c") >= frequent_from(counts, "c", FREQUENT)).select("key", "c").toArrow()
    keys, c = (rows.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(keys)
    return keys[order], c[order]


_SLOTS = "n_tokens bigint, logs double, rare_logs double, n_known bigint, slots binary, keys array<bigint>, tf array<int>"


def slot_rows(rows: DataFrame, lexicon: Lexicon, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Each text as the slots of its tokens, two bytes each; what its frequent words add to its sums; and its other words (keys, tf)."""
    names, counts = known

    def run(batches):
        log = np.log10(counts + 1.0)
        for b in batches:
            if not b.num_rows:
                continue
            keys, tf = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
            ends = b.column(3).offsets.to_numpy() - b.column(3).offsets[0].as_py()
            total = lambda x, first=ends[:-1]: np.add.reduceat(x, first)  # noqa: E731  every text has its end
            slots, n = lexicon.slots(keys).astype("<u2"), total(tf.astype(np.int64))
            at = np.minimum(np.searchsorted(names, keys), max(0, len(names) - 1))
            here = names[at] == keys if len(names) else np.zeros(len(keys), bool)
            added = np.where(here, log[at], 0.0) * tf if len(names) else np.zeros(len(keys))
            out = [slots[x:y][np.frombuffer(p, "<u2" if len(p) == 2 * k else "<u4")].tobytes() for x, y, p, k in zip(ends, ends[1:], b.column(5).to_pylist(), n.tolist(), strict=False)]
            left = pa.array(np.concatenate([[0], np.cumsum(total((~here).astype(np.int32)))]), pa.int32())
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~here], kind)) for x, kind in ((keys, pa.int64()), (tf, pa.int32()))]
            sums = [pa.array(x) for x in (n, total(added), total(added * (slots >= VOCABULARY)), total(tf * here).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *sums, pa.array(out, pa.binary()), *rest], ["row", "doc_id", "held_out", *[c.split(" ")[0] for c in _SLOTS.split(", ")]])
        give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.select("row", "doc_id", "held_out", "keys", "tf", "places").mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, {_SLOTS}"))


class Flat:
    """The texts of a batch one after the other, CONTEXT start signs before each, so that what stands before a token is found by its place."""

    def __init__(self, texts: list[bytes]):
        start = np.full(CONTEXT, START, "<u2").tobytes()
        self.slots = np.frombuffer(b"".join(x for t in texts for x in (start, t)), "<u2")
        self.n = np.array([len(t) // 2 for t in texts], np.int64)
        self.first = np.cumsum(self.n + CONTEXT) - self.n  # of each text

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Row i: the slots of the CONTEXT tokens before place at[i], the nearest first."""
        return np.stack([self.slots[at - 1 - i] for i in range(CONTEXT)], axis=1)

    def places(self, turn: int | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """All tokens' places, or of every text those whose number and row fall on the turn."""
        within = np.arange(int(self.n.sum())) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        at = within + np.repeat(self.first, self.n)
        return at if turn is None else at[(within + np.repeat(rows, self.n)) % ROUNDS == turn]


def _learn(flat: np.ndarray, lexicon: Lexicon, turn: int):
    """The steps of a task in one round, times its positions; the number of positions stands last."""

    def run(batches):
        model, past, total = Model(flat.copy()), np.full_like(flat, 1e-3), 0
        log_noise = np.log(NOISE * lexicon.unigram).astype(np.float32)
        rng, contexts, slots, size = None, [], [], 0

        def steps(c, w):
            for a in range(0, len(w), BATCH):
                noise = np.searchsorted(edges, rng.random(NOISE), "right")
                contrast(model, past, c[a : a + BATCH], w[a : a + BATCH], noise, log_noise)

        edges = np.cumsum(lexicon.unigram)[:-1]
        for b in batches:
            if not b.num_rows:
                continue
            rows, texts = b.column(0).to_numpy(), Flat(b.column(1).to_pylist())
            rng = rng or np.random.default_rng([turn, int(rows[0])])
            at = texts.places(turn, rows)
            contexts.append(texts.contexts(at))
            slots.append(texts.slots[at])
            size += len(at)
            if size >= 8 * BATCH:
                c, w, whole = np.concatenate(contexts), np.concatenate(slots), size // BATCH * BATCH
                order = rng.permutation(size)
                steps(c[order[:whole]], w[order[:whole]])
                contexts, slots, total, size = [c[order[whole:]]], [w[order[whole:]]], total + whole, size - whole
        if size:
            steps(np.concatenate(contexts), np.concatenate(slots))
            total += size
        if total:
            moved = np.rint((model.flat - flat).astype(float) * STEP).astype(np.int64) * total
            yield pa.record_batch([pa.array([np.append(moved, total)], pa.list_(pa.int64()))], ["moved"])

    return run


def train(rows: DataFrame, lexicon: Lexicon) -> Model:
    """From (row, held_out, slots)."""
    model = Model.start(lexicon.unigram)
    learn = rows.where(~F.col("held_out")).select("row", "slots")
    for turn in range(ROUNDS):
        moved = learn.mapInArrow(_learn(model.flat, lexicon, turn), "moved array<bigint>").select(F.posexplode("moved").alias("at", "moved"))
        sums = np.zeros(Model.size() + 1)
        for r in moved.groupBy("at").agg(F.sum("moved").alias("moved")).collect():  # a row a parameter
            sums[r["at"]] = r["moved"]
        if sums[-1]:
            model = Model((model.flat + sums[:-1] / sums[-1] / STEP).astype(np.float32))
    return model


def slot_scores(rows: DataFrame, model: Model, lexicon: Lexicon) -> DataFrame:
    """rows without their slots and words, with slot_score: log10 of the slots' probabilities, and for words outside the vocabulary less log10 of the class's sum."""
    flat, share = model.flat, np.concatenate([np.zeros(VOCABULARY), np.log10(lexicon.share)])
    rows = rows.drop("keys", "tf")
    kept = [c for c in rows.columns if c != "slots"]

    def run(batches):
        m = Model(flat)
        norms = Norms(m)
        for b in batches:
            found = []
            for group in _groups(b.column(len(kept)).to_pylist()):
                t = Flat(group)
                at = t.places()
                slots = t.slots[at]
                found += np.add.reduceat(m.log10(t.contexts(at), slots, norms) - share[slots], np.cumsum(t.n) - t.n).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(found, pa.float64())], [*kept, "slot_score"])
        give_back()

    return rows.select(*kept, "slots").mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", slot_score double")


def _groups(texts: list[bytes]):
    """Runs of texts of about GROUP tokens."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t) // 2
        if size >= GROUP:
            yield own
            own, size = [], 0
    if own:
        yield own


def rest_sums(rows: DataFrame, counts: DataFrame, known: tuple[np.ndarray, np.ndarray], lexicon: Lexicon) -> DataFrame:
    """(row, logs, rare_logs, n_known) of the words that are not among the frequent ones: sums of log10(c + 1), and tokens with c > 0.

    None of them is a hot key: each is rarer than all the frequent ones.
    """
    least = int(known[1].min()) if len(known[1]) else None
    rare = counts if least is None else counts.where(F.col("c") < least)
    log = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    outside = F.when(~F.col("key").isin(lexicon.keys.tolist()), log).otherwise(0.0)
    each = _each(rows, "row").join(rare, "key", "left").groupBy("row")
    return each.agg(F.sum(log).alias("_logs"), F.sum(outside).alias("_rare"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("_known"))


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, Lexicon, Model]:
    """(bags, counts, lexicon, model)."""
    rows = bags(docs)
    counts = token_counts(rows)
    lexicon = Lexicon(counts)
    return rows, counts, lexicon, train(slot_rows(rows, lexicon, frequent(counts)), lexicon)


def score(docs: DataFrame) -> DataFrame:
    """A row a document: held_out, n_tokens, n_known, train_tokens, base_score (counts alone) and score (the model), both log10."""
    rows = bags(docs)
    counts = token_counts(rows)
    lexicon, known = Lexicon(counts), frequent(counts)
    slots = slot_rows(rows, lexicon, known)
    return totals(slot_scores(slots, train(slots, lexicon), lexicon), rest_sums(slots, counts, known, lexicon), lexicon)


def totals(scored: DataFrame, rest: DataFrame, lexicon: Lexicon) -> DataFrame:
    both = scored.join(rest, "row", "left")
    with_rest = lambda c, r: F.col(c) + F.coalesce(r, F.lit(0))
    return both.select(
        "doc_id", "held_out", "n_tokens", with_rest("n_known", "_known").alias("n_known"), F.lit(lexicon.n).cast("long").alias("train_tokens"),
        (with_rest("logs", "_logs") - F.col("n_tokens") * math.log10(lexicon.n + lexicon.v + 1)).alias("base_score"), (F.col("slot_score") + with_rest("rare_logs", "_rare")).alias("score"),
    )


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(docs: list[tuple], model: Model, lexicon: Lexicon) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), token by token, for tests."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    lists = [[*words_of(t), b""] for _, t in docs]
    counts = Counter(w for words, out in zip(lists, held, strict=True) if not out for w in words)
    n, v = counts.total(), len(counts)
    keys = WordKeys()
    slot = lambda w: int(lexicon.slots(np.array([keys[w]], np.uint64).view(np.int64))[0])
    out = []
    for (d, _), words, h in zip(docs, lists, held, strict=True):
        before, total = [START] * CONTEXT, 0.0
        for w in words:
            hidden = sum(model.context[before[i]].astype(float) @ model.matrix[i].astype(float) for i in range(CONTEXT))
            scores = model.target.astype(float) @ hidden + model.bias
            s = slot(w)
            total += (scores[s] - np.log(np.exp(scores).sum())) / math.log(10)
            if s >= VOCABULARY:
                total += math.log10((counts[w] + 1) / lexicon.share[s - VOCABULARY])
            before = [s, *before[:-1]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((d, h, len(words), sum(counts[w] > 0 for w in words), n, base, total))
    return out
