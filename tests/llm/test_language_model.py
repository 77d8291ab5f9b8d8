"""Language-model scores against counts and probabilities worked out token by token, with their edge cases."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_model as lm

from .test_llm import ODD, SCHEMA, SF


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return [(r.doc_id, r.text) for r in docs.collect()], lm.score(docs).collect(), lm.fit(docs)


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[2:4])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-4)


def test_against_brute_force(scored):
    rows, got, (*_, lexicon, model) = scored
    same(got, lm.brute_force(rows, model, lexicon))


def test_held_out_texts_score_above_counts_alone(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > out[1] + 0.1 * out[2]


def test_probabilities_of_all_words_add_up_to_one(scored):
    rows, _, (_, counts, lexicon, model) = scored
    known = [(r.key, r.c) for r in counts.collect()]
    slots = lexicon.slots(np.array([k for k, _ in known], np.int64))
    rng = np.random.default_rng(1)
    for context in rng.integers(0, lm.SLOTS + 1, (5, lm.CONTEXT)):
        p = 10 ** model.log10(np.repeat(context[None], lm.SLOTS, 0), np.arange(lm.SLOTS))
        word = [p[s] if s < lm.VOCABULARY else p[s] * (c + 1) / lexicon.share[s - lm.VOCABULARY] for s, (_, c) in zip(slots.tolist(), known, strict=True)]
        unseen = sum(p[lm.VOCABULARY + k] / lexicon.share[k] for k in range(lm.CLASSES))
        empty = p[len(lexicon.keys) : lm.VOCABULARY].sum()  # places of the vocabulary that no token takes
        assert math.fsum(word) + unseen + empty == pytest.approx(1, abs=1e-4)


def test_words_of_a_batch_have_the_keys_of_each_text():
    odd = [None, "", " ", "\n a\tB ", "x\x0b y", "É é\xa0z\x1cq", "  ", " a", "the The the", "日本 x"]
    known = lm.WordKeys()
    for texts in (pa.array(odd), pa.array(odd)[3:8], pa.array(["a b"] * 300), pa.array([None], pa.string()), pa.array([], pa.string())):
        want = [[*known.of(lm.words_of(t)).view(np.int64).tolist(), lm.END] for t in texts.to_pylist()]
        assert [k.tolist() for k in lm.token_keys(texts)] == want


@pytest.mark.parametrize(("scale", "bits"), [(1, 0), (1, 12), (40, 12)])
def test_a_context_is_summed_up_once_while_it_is_remembered(monkeypatch, scale, bits):
    """With few and many places, and where exponentials would overflow."""
    rng = np.random.default_rng(6)
    model = lm.Model((lm.Model.start(np.full(lm.SLOTS, 1 / lm.SLOTS)).flat + rng.normal(0, 0.3, lm.Model.size()).astype(np.float32)) * np.float32(scale))
    contexts, slots = rng.integers(0, lm.SLOTS + 1, (300, lm.CONTEXT))[rng.integers(0, 300, 2000)], rng.integers(0, lm.SLOTS, 2000)
    norms, asked = lm.Norms(model, bits), []
    assert norms.near == (scale == 1)
    whole = norms.worked_out
    monkeypatch.setattr(norms, "worked_out", lambda codes: asked.append(len(codes)) or whole(codes))
    hidden = sum(model.context[contexts[:, i]].astype(float) @ model.matrix[i].astype(float) for i in range(lm.CONTEXT))
    scores = hidden @ model.target.T.astype(float) + model.bias
    top = scores.max(axis=1)
    want = (scores[np.arange(2000), slots] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))) / math.log(10)
    for _ in range(2):
        assert model.log10(contexts, slots, norms) == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert asked[0] <= 300 and (sum(asked[1:]) < 60 or not bits)


def test_steps_follow_the_gradient_of_the_contrastive_loss():
    """The step's direction against differences of the loss itself."""
    rng = np.random.default_rng(3)
    unigram = np.full(lm.SLOTS, 1 / lm.SLOTS)
    model = lm.Model.start(unigram)
    contexts, slots, noise = rng.integers(0, lm.SLOTS + 1, (40, lm.CONTEXT)), rng.integers(0, lm.SLOTS, 40), rng.integers(0, lm.SLOTS, 7)
    log_noise = np.log(7 * unigram).astype(np.float32)

    def loss(flat):
        m = lm.Model(flat.astype(float))
        h = m.hidden(contexts)
        real = (h * m.target[slots]).sum(axis=1) + m.bias[slots] - log_noise[slots]
        fake = h @ m.target[noise].T + m.bias[noise] - log_noise[noise]
        return -(np.log(1 / (1 + np.exp(-real))).sum() + np.log(1 - 1 / (1 + np.exp(-fake))).sum()) / len(slots)

    past, before = np.zeros_like(model.flat), model.flat.copy()
    lm.contrast(model, past, contexts, slots, noise, log_noise)
    size, sign = np.sqrt(past), np.sign(model.flat - before)
    for at in [*np.argsort(-past)[:20], *rng.choice(np.flatnonzero(past > 1e-10), 40)]:
        step = np.zeros(len(before))
        step[at] = 1e-4
        slope = (loss(before + step) - loss(before - step)) / 2e-4
        assert abs(slope) == pytest.approx(size[at], rel=0.02, abs=1e-6) and np.sign(-slope) == sign[at]


@pytest.mark.parametrize("frequent", [0, 50])
def test_rare_words_meet_their_counts_by_a_shuffle(monkeypatch, scored, frequent):
    """With few or no words among the frequent ones."""
    rows, _, (bags, counts, lexicon, model) = scored
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    known = lm.frequent(counts)
    slots = lm.slot_rows(bags, lexicon, known)
    assert len(known[0]) <= frequent
    same(lm.totals(lm.slot_scores(slots, model, lexicon), lm.rest_sums(slots, counts, known, lexicon), lexicon).collect(), lm.brute_force(rows, model, lexicon))


def test_edges(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    *_, lexicon, model = lm.fit(odd)
    same(lm.score(odd).collect(), lm.brute_force([r[:2] for r in ODD], model, lexicon))
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if lm.zlib.crc32(str(i).encode()) % 7 == 2)
    (only,) = lm.score(spark.createDataFrame([(held, "none to learn from")], "doc_id long, text string")).collect()
    assert only.held_out and (only.n_tokens, only.n_known, only.train_tokens) == (5, 0, 0) and only.base_score == 0 and only.score < 0
