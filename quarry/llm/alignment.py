"""Alignment of two tokenizers over a corpus.

A text with a space before it is encoded by a byte-level BPE (A) and by a sentence-piece model (B, which puts that space itself).
Both give tokens that stand for bytes.  The cumulative ends of the two token sequences are merged, two sorted lists with a
pointer each, inside mapInPandas: where both end, a group ends.  Every A and B token of a group are linked.  Spark counts the
documents that hold a pair of ids linked, joins the counts and the highest count of each A id back, and adds up each document.

Neither tokenizer joins what stands on the two sides of a single space between two other characters, so such a space begins
a token of both and ends a group.  The pieces between such spaces are therefore encoded and merged alone, once as long as a
bounded cache remembers them; a text with other white space at such a cut goes through both libraries whole.

Pairs that many documents hold would be hot keys of the join.  At most ``FREQUENT`` of the most frequent ones, counted first, go
to every task as a table; all others, each held by fewer documents than those, are joined by a shuffle.

Edge cases: a text that is null, empty, or that either tokenizer does not give back byte for byte has no tokens, no groups and an
empty ``groups``; repeated rows and null doc_ids are documents of their own; an empty table gives an empty result.  Extra columns
of the documents pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent_from, fresh, give_back, small_batches, stage, table
from .tokens import _byte_letters, _latin

#: Pairs that may go to every task.
FREQUENT = 1 << 19
CACHE_PIECES, CACHE_CHARS = 200_000, 48
#: Fixed value: the pattern by which the byte-level pre-tokenizer cuts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteBpe:
    """Ids and byte strings of a tokenizers file.  Latin pieces go through tiktoken with the same ranks where the file allows."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in _byte_letters().items()}
        letters |= {chr(b): b for b in range(256) if chr(b) not in letters and b not in letters.values()}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        size = self.library.get_vocab_size()
        self.bytes = [b""] * size
        for piece, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if i not in special and all(c in letters for c in piece) else piece.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        ranks = {self.bytes[i]: i for i in vocab.values() if i not in special}
        self.fast = None
        if plain and made == sorted(set(made)) and made[0] > max(vocab[c] for c in _byte_letters().values() if c in vocab):
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        out = [self.fast(t) if t.isascii() or _latin(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class Pieces:
    """Ids and byte strings of a sentence-piece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        #: a piece that holds a space behind another character would join what stands on both sides of it
        self.apart = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where both token sequences end: the merge of two sorted lists of ends."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # a merge of two sorted runs
    return both[1:][both[1:] == both[:-1]]


class Aligner:
    """Groups of whole texts: (group string, codes of the links, number of A tokens).  A code is a * B's size + b."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), Pieces(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.n_b, self.known, self.older = len(self.b.bytes), {}, {}
        names = [f"{i}{end}".encode() for n, ends in ((len(self.len_a), ",|"), (len(self.len_b), ",;")) for i in range(n) for end in ends]
        self.width = np.array([len(x) for x in names], np.int8)
        self.names = np.array(names, f"S{self.width.max()}").view(np.uint8).reshape(len(names), -1)

    def merge(self, units: list[str]) -> list[tuple[bytes, bytes, int] | None]:
        """Each unit, as if it stood alone behind a space; None if it does not come back byte for byte."""
        ids_a, ids_b = self.a.encode([" " + u for u in units]), self.b.encode(units)
        out: list[tuple[bytes, bytes, int] | None] = [None] * len(units)
        bytes_a, bytes_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        good = [i for i, u in enumerate(units) if u and (" " + u).encode() == b"".join(map(bytes_a, ids_a[i])) == b"".join(map(bytes_b, ids_b[i]))]
        if not good:
            return out
        a, b = (np.array([t for i in good for t in ids[i]], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = common_ends(end_a, end_b)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        n_a, n_b = (np.bincount(g, minlength=len(ends)) for g in (group_a, group_b))
        first_b = np.cumsum(n_b) - n_b
        times = n_b[group_a]
        which = np.repeat(first_b[group_a] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        codes = np.repeat(a, times) * self.n_b + b[which]
        # the group string: each id with what stands behind it, A's of a group before B's
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        signs = np.concatenate([a * 2 + last_a, 2 * len(self.len_a) + b * 2 + last_b])
        signs = signs[np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")]
        width = self.width[signs]
        text = self.names[signs][np.arange(self.names.shape[1]) < width[:, None]].tobytes()
        # where each unit ends among tokens, links and letters
        tokens_a = np.cumsum([len(ids_a[i]) for i in good])
        tokens = tokens_a + np.cumsum([len(ids_b[i]) for i in good])
        links, letters = np.cumsum(times)[tokens_a - 1].tolist(), np.cumsum(width, dtype=np.int64)[tokens - 1].tolist()
        raw, x, y = codes.astype("<i8").tobytes(), 0, 0
        for i, z, w in zip(good, links, letters, strict=True):
            out[i] = text[y : w - 1], raw[8 * x : 8 * z], len(ids_a[i])
            x, y = z, w
        return out

    def align(self, texts: list[str | None]) -> list[tuple[bytes, bytes, int] | None]:
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known  # what is met again moves back
        known, older, fresh_ = self.known, self.older, {}
        cut = [t.split(" ") if t and self.b.apart else None for t in texts]
        for parts in cut:
            for p in set(parts or ()):
                if p not in known:
                    if p in older:
                        known[p] = older[p]
                    else:
                        fresh_[p] = None
        new = [p for p in fresh_ if p and not p[0].isspace() and not p[-1].isspace()]
        for p, x in zip(new, self.merge(new), strict=True):
            fresh_[p] = x
        known.update((p, x) for p, x in fresh_.items() if x is not None and len(p) <= CACHE_CHARS)
        out: list[tuple[bytes, bytes, int] | None] = [None] * len(texts)
        whole = []
        for i, parts in enumerate(cut):
            if texts[i]:
                found = [known.get(p) or fresh_.get(p) for p in parts] if parts else [None]
                if None in found:
                    whole.append(i)
                else:
                    names, codes, n = zip(*found, strict=True)
                    out[i] = b";".join(names), b"".join(codes), sum(n)
        for i in whole:
            out[i] = self.merge([texts[i]])[0]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_ROW = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>"


def align(docs: DataFrame, path_a: str, path_b: str, names: list[str], texts: bool = True) -> DataFrame:
    """All of docs and, under ``names``: tokens, groups and links, the groups (or their SHA-256), distinct links and how often each is made."""
    spark = docs.sparkSession
    small_batches(spark)
    fields = ", ".join(f"`{n}` {c.split(' ')[1]}" for n, c in zip(names, _ROW.split(", "), strict=True))
    columns = docs.columns
    at = [c.lower() for c in columns].index("text")
    inside = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name may stand outside

    def run(frames):
        aligner = _ALIGNERS.get((path_a, path_b)) or _ALIGNERS.setdefault((path_a, path_b), Aligner(path_a, path_b))
        for frame in frames:
            rows = []
            for x in aligner.align([t if isinstance(t, str) else None for t in frame.iloc[:, at]]):
                if x is None:
                    rows.append((0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32)))
                    continue
                groups, raw, n_a = x
                n_groups, links = groups.count(b"|"), np.frombuffer(raw, "<i8")
                pairs, times = np.unique(links, return_counts=True)
                shown = groups.decode() if texts else hashlib.sha256(groups).hexdigest()
                rows.append((n_a, groups.count(b",") + 2 * n_groups - n_a, n_groups, len(links), shown, pairs, times.astype(np.int32)))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1).set_axis([*columns, *names], axis=1)
        give_back()

    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return inside.mapInPandas(run, f"{kept}, {fields}")


def pair_counts(aligned: DataFrame, pairs: str, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; whether no pair of its A id is held by more."""
    counts = stage(aligned.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.expr(f"pair div {size_b}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row an id
    return stage(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def link_sums(aligned: DataFrame, row: str, pairs: str, times: str, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of each row that has links."""
    least = frequent_from(counts, "n", FREQUENT)
    each = aligned.select(row, F.inline(F.arrays_zip(F.col(pairs).alias("pair"), F.col(times).alias("times"))))
    frequent = F.broadcast(counts.where(F.col("n") >= least))  # at most FREQUENT rows of three numbers
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    common = each.join(frequent, "pair").groupBy(row).agg(*sums)
    rare = each.join(frequent, "pair", "left_anti").join(counts.where(F.col("n") < least), "pair").groupBy(row).agg(*sums)
    return common.unionByName(rare).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def annotate(docs: DataFrame, path_a: str, path_b: str, name: str = "_alignment", texts: bool = True) -> DataFrame:
    """All of docs, and a struct of n_a, n_b, n_groups, n_links, n_best, count_sum and groups."""
    import sentencepiece

    row = fresh(docs, "row")
    names = [fresh(docs, c.split(" ")[0]) for c in _ROW.split(", ")]
    aligned = stage(align(docs, path_a, path_b, names, texts).withColumn(row, F.monotonically_increasing_id()))
    pairs, times = names[-2:]
    counts = pair_counts(aligned, pairs, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size())
    sums = link_sums(aligned, row, pairs, times, counts).withColumnsRenamed({"n_best": fresh(aligned, "best"), "count_sum": fresh(aligned, "sum")})
    both = aligned.drop(pairs, times).join(sums, row, "left")
    best, total = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in sums.columns[1:])
    shown = dict(zip(["n_a", "n_b", "n_groups", "n_links", "groups"], names, strict=False))
    fields = [*[F.col(shown[c]).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], best.alias("n_best"), total.alias("count_sum"), F.col(shown["groups"]).alias("groups")]
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*fields).alias(name))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_tokenizers(), texts=False)
    x = F.col("_alignment")
    return out.select("doc_id", *[x[c].alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], x["groups"].alias("groups_sha256"))


def plain_groups(text: str | None, a: ByteBpe, b: Pieces) -> list[tuple[list[int], list[int]]]:
    """The groups of one text by two pointers over whole-text encodings, for tests."""
    if not text:
        return []
    ids_a, ids_b = a.library.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
    raw = (" " + text).encode()
    if b"".join(a.bytes[i] for i in ids_a) != raw or b"".join(b.bytes[i] for i in ids_b) != raw:
        return []
    groups, i, j, x, y, own = [], 0, 0, 0, 0, ([], [])
    while i < len(ids_a) or j < len(ids_b):
        if x <= y and i < len(ids_a):
            x += len(a.bytes[ids_a[i]])
            own[0].append(ids_a[i])
            i += 1
        else:
            y += len(b.bytes[ids_b[j]])
            own[1].append(ids_b[j])
            j += 1
        if x == y:
            groups.append(own)
            own = ([], [])
    return groups


def brute_force(docs: list[tuple], path_a: str, path_b: str) -> list[tuple]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, group string) of each row, for tests."""
    a, b = ByteBpe(path_a), Pieces(path_b)
    found = [(d, plain_groups(t, a, b)) for d, t in docs]
    links = [[(i, j) for x, y in groups for i in x for j in y] for _, groups in found]
    held = Counter(p for own in links for p in set(own))
    most: dict[int, int] = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for (d, groups), own in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own), sum(held[p] == most[p[0]] for p in own), sum(held[p] for p in own), text))
    return out
