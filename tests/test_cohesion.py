"""Topic segments and search units against plain versions: the whole similarity matrix, every way to cut."""

import itertools
import math
import random

import numpy as np
import pytest

from quarry.operators import cohesion as C
from quarry.operators.chunking import parse

SF = "/root/testdata/sf0.001"


def plain_cuts(tokens, bags, most, least):
    """All cells of the matrix, ranks cell by cell, the programme over all starts."""
    m = len(bags)
    df = {g: sum(g in b for b in bags) for b in bags for g in b}
    x = [{g: n * math.log(1 + m / df[g]) for g, n in b.items()} for b in bags]
    smooth = []
    for i in range(m):
        v = dict(x[i])
        for j in (i - 1, i + 1):
            if 0 <= j < m:
                for g, w in x[j].items():
                    v[g] = v.get(g, 0) + C.SMOOTH * w
        smooth.append(v)
    norm = [math.sqrt(sum(w * w for w in v.values())) for v in smooth]
    sim = [[1.0 if i == j else round(min(1.0, sum(w * smooth[j].get(g, 0) for g, w in smooth[i].items()) / (norm[i] * norm[j])), 12) for j in range(m)] for i in range(m)]

    def rank(i, j):
        near = [sim[p][q] for p in range(max(0, i - 2), min(m, i + 3)) for q in range(max(0, j - 2), min(m, j + 3)) if (p, q) != (i, j)]
        return sum(s < sim[i][j] for s in near) / len(near)

    ranks = [[rank(i, j) for j in range(m)] for i in range(m)]
    best, back = [0.0] + [-math.inf] * m, [0] * (m + 1)
    for b in range(1, m + 1):
        for a in range(b - 1, -1, -1):
            size = sum(tokens[a:b])
            if size > most and b - a > 1:
                break
            inside = sum(ranks[i][j] for i in range(a, b) for j in range(a, b)) / (b - a) ** 2
            score = best[a] + size * inside - C.CUT - (C.SHORT * max(0, least - size) if m > 2 else 0)
            if score > best[b] + 1e-9:
                best[b], back[b] = score, a
    out, at = [], m
    while at:
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


@pytest.mark.parametrize("most, least", [(60, 12), (360, 48), (15, 4)])
def test_cuts_equal_those_of_the_whole_matrix(spark, most, least):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 400 and 6000").orderBy("doc_id").limit(25).collect()
    cut = 0
    for r in rows:
        s = C.spans(r.text, most)[:60]
        tokens, bags = [C.estimate(x) for x in s], [C._grams(x) for x in s]
        if len(s) > 1:
            got = C.cuts(tokens, bags, most, least)
            assert got == plain_cuts(tokens, bags, most, least)
            cut += len(got) > 1
    assert cut > 5


def test_topics_are_told_apart():
    rnd = random.Random(2)
    topic = lambda words: " ".join(f"{' '.join(rnd.choices(words, k=9)).capitalize()}." for _ in range(8))
    a, b = "harbour vessel cargo anchor sailor mast tide pilot".split(), "enzyme protein membrane nucleus genome cell mitosis plasma".split()
    s = C.spans(f"{topic(a)} {topic(b)}", 100)
    ends = [z for _, z in C.cuts([C.estimate(x) for x in s], [C._grams(x) for x in s], 100, 20)]
    assert len(s) == 16 and any(abs(z - 8) <= 1 for z in ends[:-1])  # smoothing may move a border by a sentence


def test_spans_and_odd_texts():
    assert C.spans("Rule 5.\nPay 3.14 now. Then go! 你好。 再见", 50) == ["Rule 5. Pay 3.14 now.", "Then go! 你好。", "再见"]
    assert C.spans("one, two, three, four five six", 4) == ["one, two,", "three,", "four five six"]
    assert C.segments(None) == C.segments(" \n ") == [] and C.segments(" short ") == ["short"]
    long = "word " * 2000
    assert C.segments(long) == [long.strip()]
    assert " ".join(C.segments("Aa bb cc. " * 3000)).split() == ("Aa bb cc. " * 3000).split()
    assert C.estimate("") == 0 and C.estimate("...") == 1 and C.estimate("你好 two") == 3


def test_segments_of_every_document_keep_its_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got: dict = {}
    for r in C.prose_segments(docs, "doc_id", "text").collect():
        got.setdefault(r.doc_id, {})[r.segment] = r.text
        assert r.tokens == C.estimate(r.text)
    for r in docs.collect():
        own = got.get(r.doc_id, {})
        assert sorted(own) == list(range(len(own))) and " ".join(own[i] for i in sorted(own)).split() == (r.text or "").split()


def plain_section(tokens, vectors, lead, budget):
    """Every way to cut, scored as a whole."""
    m = len(tokens)
    near = [float(vectors[i] @ vectors[i + 1]) for i in range(m - 1)]
    mean = sum(near) / len(near)
    limit = max(C.FLOOR, min(C.CEILING, mean - C.SPREAD * math.sqrt(sum((x - mean) ** 2 for x in near) / len(near))))

    def gain(a, b):
        if b - a == 1:
            return -0.35 * max(0, C.SMALL - tokens[a])
        size = sum(tokens[a:b]) + (lead if a == 0 and lead + tokens[0] <= budget else 0)
        centre = sum(vectors[k] * math.sqrt(max(1, tokens[k])) for k in range(a, b))
        to = [float(vectors[k] @ centre) / math.sqrt(float(centre @ centre)) for k in range(a, b)]
        weakest, small = min(near[a : b - 1]), min(tokens[a:b]) < C.SMALL
        if size > budget or not (weakest >= limit and min(to) >= limit or small and weakest >= C.WEAK and size <= C.GOOD):
            return -math.inf
        return sum(t * max(0, s - limit) for t, s in zip(tokens[a:b], to)) + 4 * (b - a - 1) - 0.08 * max(0, size - C.GOOD)

    ways = (tuple(zip((0, *c), (*c, m))) for n in range(m) for c in itertools.combinations(range(1, m), n))
    return max(sum(gain(a, b) for a, b in w) for w in ways), gain


def test_sections_are_cut_best():
    rng = np.random.default_rng(4)
    joined = 0
    for _ in range(60):
        m = int(rng.integers(2, 9))
        v = np.cumsum(rng.normal(size=(m, 6)) * rng.choice([0.2, 0.6, 1.0]), axis=0) + rng.normal(size=6) * 2
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        tokens, lead = [int(x) for x in rng.integers(5, 200, m)], int(rng.integers(0, 60))
        best, gain = plain_section(tokens, v, lead, 400)
        got = C.section_cuts(tokens, v, lead, 400)
        assert sum(gain(a, b) for a, b in got) == pytest.approx(best) and [a for a, _ in got[1:]] == [b for _, b in got[:-1]]
        joined += len(got) < m
    assert joined > 10
    assert C.section_cuts([200, 100, 300, 50], None, 150, 400) == [(0, 1), (1, 3), (3, 4)]


def test_units_headings_tables_and_overlap():
    table = "| a | b |\n| - | - |\n" + "\n".join(f"| {i} | x |" for i in range(200))
    text = f"# Top\n\nintro words here\n\n## Data\n\n{table}\n\n## Last\n\n" + "Long prose goes on and on. " * 60
    got = C.units(parse(text), 100, 5)
    assert got[0]["text"] == "# Top\n\nintro words here" and [u["unit"] for u in got] == list(range(len(got)))
    rows = [u for u in got if u["text"].startswith("| a | b |\n| - | - |")]
    assert len(rows) > 3 and all(u["is_part"] for u in rows) and [r for u in rows for r in u["text"].split("\n")[2:]] == table.split("\n")[2:]
    prose = [u["text"] for u in got if "prose" in u["text"]]
    assert len(prose) > 2 and all(b.split()[:5] == a.split()[-5:] for a, b in zip(prose, prose[1:]))
    assert C.units(parse("# only\n## heads"), 100)[0]["text"] == "# only\n\n## heads" and C.units(parse("")) == []
    assert all(u["tokens"] <= 100 for u in C.units(parse(text), 100, 0) if not u["text"].startswith("|"))


def test_units_of_every_document_cover_its_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = C.search_units(docs, "doc_id", "text", 120).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.unit)):
        by.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        blocks = parse(d.text)
        own = by.get(d.doc_id, [])
        assert sorted({i for u in own for i in range(u.block_from, u.block_to + 1)}) == list(range(len(blocks)))
        assert all(x.block_to <= y.block_from for x, y in zip(own, own[1:])) and not any(x.block_to == y.block_from and not y.is_part for x, y in zip(own, own[1:]))


def test_products_and_dealing(spark):
    """Products of sentences hold no column for a gram of one sentence, and one file is no single task."""
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 3, (20, 300)) * (rng.random((20, 300)) < 0.05)
    rows, grams = np.nonzero(dense)
    assert np.allclose(C._products(grams, dense[rows, grams].astype(float), rows, 20), dense @ dense.T)
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string").coalesce(1)
    for made in (C.prose_segments(one, "id", "text"), C.search_units(one, "id", "text")):
        assert "RoundRobinPartitioning" in made._jdf.queryExecution().executedPlan().toString() and made.count() == 2
