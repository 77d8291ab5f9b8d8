"""Alignment of two tokenizers against two pointers over whole-text encodings, with its edge cases."""

import hashlib
import random

import pytest

from quarry.llm import alignment

from .test_llm import ODD, SCHEMA, SF

PATHS = alignment.default_tokenizers()
STRANGE = [
    "  a b", "a  b", " ", "\n", "a\n\nb c", "it's 's 'll  x\t y", "日本語 テスト 🙂", "<|endoftext|> x <s> </s> <0x0A> <unk>", "▁x y", "x \n y",
    "é́ ñ", "a\x00b", "tab\there", " lead", "trail ", "١٢٣ ٤", "a\x1cb \x85 c", "word " * 3000, "x" * 5000,
]


def found(docs, texts=True):
    x = "_alignment"
    rows = alignment.annotate(docs, *PATHS, texts=texts).selectExpr("doc_id", *[f"{x}.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")]).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def want(rows):
    return sorted(alignment.brute_force(rows, *PATHS), key=repr)


def test_pieces_are_aligned_as_whole_texts_are():
    rnd, aligner = random.Random(5), alignment.Aligner(*PATHS)
    texts = STRANGE + ["".join(rnd.choices("ab 'sé\n\t日🙂▁<>|0123 ., ", k=rnd.randint(0, 25))) for _ in range(1500)]
    for i in range(0, len(texts), 40):
        for t, x in zip(texts[i : i + 40], aligner.align(texts[i : i + 40]), strict=True):
            plain = alignment.plain_groups(t, aligner.a, aligner.b)
            assert (x[0].decode() if x else "") == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain)


@pytest.mark.parametrize("frequent, cache", [(alignment.FREQUENT, alignment.CACHE_PIECES), (20, 5), (0, 100)])
def test_counts_against_brute_force(spark, monkeypatch, frequent, cache):
    """With all, some or none of the pairs sent to every task."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "CACHE_PIECES", cache)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + list(enumerate(STRANGE))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want(rows)


def test_hashes_of_groups(spark):
    docs = spark.createDataFrame([(1, "Hello wörld"), (2, None), (3, "▁")], "doc_id long, text string")
    shown, hashed = found(docs), found(docs, texts=False)
    assert [r[-1] for r in hashed] == [hashlib.sha256(shown[0][-1].encode()).hexdigest(), "", ""]


def test_edges(spark):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert found(odd) == want([r[:2] for r in ODD])
    assert found(none) == [] and alignment.annotate(odd, *PATHS).columns == [*odd.columns, "_alignment"]
    clash = odd.selectExpr("doc_id", "text", "doc_id as _row", "text as `_N_A`", "1 as pair", "2 as times", "3 as n_best", "4 as `a.b`")
    got = alignment.annotate(clash, *PATHS)
    assert got.columns == [*clash.columns, "_alignment"] and got.count() == len(ODD)
