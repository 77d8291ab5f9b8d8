"""Token ids in a content-addressed store.

A document's ids (an end id last) are cut where a rolling hash over the last 16 ids has its low bits zero, so
equal passages are cut alike wherever they stand.  Each chunk is named by the SHA-256 of its bytes and stored
once; a document's recipe lists its chunks; the Merkle root over the list, and a manifest with a Merkle
root over each recipe file, let a reader prove what it has put together.

Files below one folder, all Parquet:
  store/     kind=chunk: key (the hash), n_ids, payload (zstd over little-endian unsigned 16-bit ids; 32-bit if the
             vocabulary needs it); kind=recipe: the recipes as encoded, not yet in order
  recipes/   part, doc_id, local_start, n_tokens, hashes, root, file_root (last row of a file); files are ranges of
             doc_id, ascending
  manifest/  part, base (ids before the file), n_docs, n_tokens, root

Edge cases: a null or empty text is the end id alone; repeated rows are documents of their own, one after the
other; null doc_ids come first; an empty table gives empty files and an empty result.  Only the named
columns are read.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_partitions, shared_dir, small_batches, table

END_ID = 2
WINDOW, MEAN_BITS, MIN_IDS, MAX_IDS = 16, 9, 128, 2048
CACHE_WORDS, CACHE_CHARS, CACHE_TAILS = 350_000, 32, 20_000
AT_ONCE = 256  # words in one call of the model


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


#: ASCII signs that the pre-tokenizer keeps together after letters (an apostrophe may begin a contraction).
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~'
#: White space other than single spaces and line ends between other characters.
_SPACES = ["  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]


#: Stands before a text's first piece, where it is in no text.
START = "\x02"
#: Texts with such white space, or with white space at an end, aren't cut by Arrow.
_ODD = "  |\n\n| \n|\n |\\A[ \n]|[ \n]\\z|[" + "".join(x for x in _SPACES if len(x) == 1) + START + "]"


def _latin(word: str) -> bool:
    try:
        return bool(word.encode("latin-1"))
    except UnicodeEncodeError:
        return False


_ID = attrgetter("id")


class _Known(dict):
    """Ids of pieces, worked out on first sight.  ``space`` is what stands before each piece in its text.

    A full table becomes the older one, and what is met again moves back from it: rare pieces go, frequent ones stay.
    """

    def __init__(self, encoder: Encoder, space: str):
        super().__init__()
        self.encoder, self.space, self.tails, self.older = encoder, space, {"": b""}, {}
        self.lead = space.translate(encoder.byte_level)
        self.tokenize, self.packed = encoder.bpe.tokenize, encoder.packed.__getitem__

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def learn(self, words: list[str]) -> None:
        """Words of Latin letters; the model gets many in one call, with a letter between them that no merge knows."""
        e = self.encoder
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            raw = self.space.encode() + (b"\xff" + self.space.encode()).join(map(str.encode, some))
            found = self.tokenize(codecs.charmap_decode(raw, "strict", e.alphabet)[0])
            ids = np.fromiter(map(_ID, found), e.kind, len(found))
            raw, at = ids.tobytes(), 0
            for w, to in zip(some, [*(np.flatnonzero(ids == e.between_id) * ids.itemsize).tolist(), len(raw)], strict=True):
                self[w], at = raw[at:to], to + ids.itemsize

    def of(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces; one that begins with START has nothing before it."""
        e, older, words, left = self.encoder, self.older, [], []
        found = list(map(self.get, pieces))
        for i in [i for i, x in enumerate(found) if x is None]:
            p = pieces[i]
            if p in older:
                self[p] = found[i] = older[p]
                continue
            left.append(i)
            if p.isalpha():
                words.append(p)
            elif (base := p.rstrip(SIGNS)) not in self and base not in older and base.isalpha():
                words.append(base)
        if e.between is not None:
            self.learn([w for w in dict.fromkeys(words) if len(w) <= CACHE_CHARS and (w.isascii() or _latin(w))])
        for i in left:
            p = pieces[i]
            found[i] = e.starts[p[1:]] if p[0] == START else self[p]
        return found

    def __missing__(self, piece: str) -> bytes:
        if piece in self.older:
            self[piece] = ids = self.older[piece]
            return ids
        e = self.encoder
        if piece.isalpha() and e.direct and (piece.isascii() or _latin(piece)):
            # ASCII letters stand for themselves in the byte-level alphabet
            word = self.lead + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(e.byte_level))
            ids = b"".join(map(self.packed, map(_ID, self.tokenize(word))))
        elif piece[:1] == "\n" and len(piece) > 1:
            ids = e.newline + e.starts[piece[1:]]
        elif e.direct and (base := piece.rstrip(SIGNS)).isalpha() and (base.isascii() or _latin(base)):
            tail = piece[len(base) :]
            if tail not in self.tails:
                if len(self.tails) > CACHE_TAILS:
                    self.tails = {"": b""}
                self.tails[tail] = e.whole(tail)
            ids = self[base] + self.tails[tail]
        else:
            ids = e.whole(self.space + piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, by the tokenizers library, with the pieces between spaces kept.

    The byte-level pre-tokenizer never joins a character other than white space with a single space or line
    end after it, so a text may be cut before each single space, and around each single line end, that
    has such characters on both sides, and the pieces encoded alone.  A piece seen before comes from a
    bounded cache.  A new one of Latin letters, with ASCII signs after them or not, is two units to the
    pre-tokenizer, which go straight to the library's BPE model; any other goes through its whole encoder.
    ``encode_all`` takes a batch of texts, and looks for each of its different pieces once.
    """

    _cut = re.compile(r"(?<=\S)(?=[ ]\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bpe = self.library.model
        parts = [self.library.normalizer is None, type(self.library.pre_tokenizer).__name__ == "ByteLevel", type(self.bpe).__name__ == "BPE"]
        self.direct = all(parts) and not self.library.pre_tokenizer.add_prefix_space
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.byte_level = _byte_letters()
        self.packed = [self.pack([i]) for i in range(self.library.get_vocab_size())]
        # 0xFF is in no UTF-8 text, so no merge should know its letter
        letter, names = self.byte_level.get(0xFF, chr(0xFF)), self.library.get_vocab()
        plain = self.direct and not any(getattr(self.bpe, a) for a in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.between = letter if plain and letter in names and sum(letter in x for x in names) == 1 else None
        self.between_id = names.get(letter)
        self.alphabet = "".join(self.byte_level.get(b, chr(b)) for b in range(256))
        self.newline = self.whole("\n")
        self.starts, self.known = _Known(self, ""), _Known(self, " ")

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'I' if self.wide else 'H'}", *ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def age(self) -> None:
        if len(self.known) + len(self.starts) > CACHE_WORDS:
            self.known.age()
            self.starts.age()

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with its end id, and how many each has.

        Arrow cuts the texts and numbers their different pieces, so that each of these is looked for once.
        """
        self.age()
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        odd = full & pc.fill_null(pc.match_substring_regex(texts, _ODD), False).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(full & ~odd), np.flatnonzero(odd)
        cut = pc.split_pattern(pc.binary_join_element_wise(START, pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), ""), " ")
        own = cut.flatten().dictionary_encode()
        ids = self.known.of(own.dictionary.to_numpy(zero_copy_only=False).tolist())
        count = np.zeros(len(texts), np.int64)
        count[plain] = np.diff(cut.offsets.to_numpy())
        ends, n = np.cumsum(count), len(ids)
        ids += [self.encode(t).tobytes() for t in texts.take(pa.array(rest)).to_pylist()] + [self.pack([end_id])]
        # an odd text is one piece, and every text has its end
        pieces = np.insert(own.indices.to_numpy(), ends[rest], np.arange(n, n + len(rest)))
        count[rest] = 1
        ends = np.cumsum(count)
        pieces = np.insert(pieces, ends, n + len(rest))
        ends += np.arange(1, len(texts) + 1)
        flat, sizes = np.frombuffer(b"".join(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.kind).itemsize
        size, start = sizes[pieces], np.cumsum(sizes) - sizes
        upto = np.cumsum(size)
        whole = flat[np.repeat(start[pieces] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        return whole, np.diff(upto[ends - 1], prepend=0)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.kind)
        self.age()
        if text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, _SPACES)):
            first, *rest = self._cut.split(text)
            if first[:1] == "\n":  # such a key stands for a line end between two other characters
                return np.frombuffer(self.whole(text), self.kind)
            rest = [p[1:] for p in rest]
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
        return np.frombuffer(self.starts[first] + b"".join(map(self.known.__getitem__, rest)), self.kind)


def _gear() -> np.ndarray:
    """A fixed pseudo-random number for each id (low half of splitmix64)."""
    x = (np.arange(1, 1 << 17, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def _marks(ids: np.ndarray, bits: int) -> np.ndarray:
    """Where a chunk may end.  The hash at i sums GEAR[id] << age over 16 ids, by four doublings; its bits from 32 on are not asked for."""
    h = GEAR[ids % np.uint32(len(GEAR))] if ids.dtype.itemsize > 2 else GEAR[ids]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero((h & np.uint32(((1 << bits) - 1) << WINDOW)) == 0) + 1


def cut_texts(ids: np.ndarray, sizes: np.ndarray, bits: int = MEAN_BITS, least: int = MIN_IDS, most: int = MAX_IDS) -> list[list[int]]:
    """Ends of each text's chunks, counted from its start; the texts' ids stand one after the other.

    No chunk ends in the first ``least`` ids of a text, and the hash of any other place looks at ids of its own text alone.
    """
    assert least >= WINDOW and bits + WINDOW <= 32
    marks, stop = _marks(ids, bits), np.cumsum(sizes)
    start = stop - sizes
    first, last = np.searchsorted(marks, start, "right").tolist(), np.searchsorted(marks, stop, "right").tolist()
    out = []
    for x, y, s, n in zip(first, last, start.tolist(), sizes.tolist(), strict=True):
        ends, at = [], 0
        for c in (marks[x:y] - s).tolist():
            while c - at > most:
                at += most
                ends.append(at)
            if c - at >= least and c < n:
                ends.append(c)
                at = c
        while n - at > most:
            at += most
            ends.append(at)
        out.append([*ends, n])
    return out


def cut_points(ids: np.ndarray, bits: int = MEAN_BITS, least: int = MIN_IDS, most: int = MAX_IDS) -> list[int]:
    return cut_texts(ids, np.array([len(ids)]), bits, least, most)[0]


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 tree; a node is sha256(1 | left | right), an odd last node moves up, no leaves: sha256(empty)."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        up = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = up + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def _shift_tables() -> list[list[int]]:
    """For each k, the linear map that 2**k zero bytes are on a CRC-32 state, as its images of 32 single bits."""
    one = []
    for i in range(32):
        v = 1 << i
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        one.append(v)
    tables = [one]
    for _ in range(40):
        m = tables[-1]
        tables.append([_times(m, x) for x in m])
    return tables


def _times(m: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


_SHIFTS = _shift_tables()


def crc32_shift(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The CRC-32 states after so many zero bytes more, each; crc(a + b) is crc32_shift(crc(a), len(b)) ^ crc(b)."""
    out, left, k = crcs.astype(np.uint32), n_bytes.astype(np.int64), 0
    while left.any():
        at = np.flatnonzero(left & 1)
        if len(at):
            x, y = out[at], np.zeros(len(at), np.uint32)
            for i, image in enumerate(_SHIFTS[k]):
                y ^= ((x >> np.uint32(i)) & np.uint32(1)) * np.uint32(image)
            out[at] = y
        left, k = left >> 1, k + 1
    return out


_ENCODERS: dict[str, Encoder] = {}
_ROW = ["kind", "key", "n_ids", "payload", "doc_id", "n_tokens", "hashes"]
SEEN = 500_000


def _encode(path: str, end_id: int):
    """Chunk rows and recipe rows of each text.  A task sends a chunk once as long as it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS[path] if path in _ENCODERS else _ENCODERS.setdefault(path, Encoder(path))
        compress = zstandard.ZstdCompressor(level=1).compress
        sha, seen = hashlib.sha256, set()
        gc.disable()  # millions of small tokens, and no cycles among them
        try:
            yield from rows(batches, enc, compress, sha, seen)
        finally:
            gc.enable()

    def rows(batches, enc, compress, sha, seen):
        for b in batches:
            chunks, recipes = [], []
            ids, sizes = enc.encode_all(b.column(1), end_id)
            size, raw, base = ids.itemsize, ids.tobytes(), 0
            for n, ends in zip(sizes.tolist(), cut_texts(ids, sizes), strict=True):
                names, at = [], 0
                for to in ends:
                    part = raw[(base + at) * size : (base + to) * size]
                    names.append(name := sha(part).digest())
                    if name not in seen:
                        seen.add(name)
                        chunks.append((name, to - at, compress(part)))
                    at = to
                recipes.append((n, names))
                base += n
            if len(seen) > SEEN:
                seen.clear()
            n, m, id_type = len(chunks), len(recipes), b.schema.field(0).type
            name, size, payload = zip(*chunks, strict=True) if chunks else ((), (), ())
            yield pa.record_batch(
                [pa.array(["chunk"] * n, pa.string()), pa.array(name, pa.binary()), pa.array(size, pa.int64()), pa.array(payload, pa.binary()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.binary()))], _ROW
            )
            keys = [sha(repr(i).encode() + merkle_root(r[1])).digest() for i, r in zip(b.column(0).to_pylist(), recipes, strict=True)]
            yield pa.record_batch(
                [pa.array(["recipe"] * m, pa.string()), pa.array(keys, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), b.column(0), pa.array([r[0] for r in recipes], pa.int64()), pa.array([r[1] for r in recipes], pa.list_(pa.binary()))], _ROW
            )

    return run


class MerklePeaks:
    """merkle_root of a long list, leaf by leaf, with one hash kept for each perfect subtree."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.peaks and self.peaks[-1][0] == height:
            leaf = hashlib.sha256(b"\x01" + self.peaks.pop()[1] + leaf).digest()
            height += 1
        self.peaks.append((height, leaf))

    def root(self) -> bytes:
        if not self.peaks:
            return merkle_root([])
        out = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            out = hashlib.sha256(b"\x01" + left + out).digest()
        return out


_RECIPE = ["part", "doc_id", "local_start", "n_tokens", "hashes", "root", "file_root"]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one recipe file, in order; the last row alone carries the file's own root."""
    part, at, tree, held = TaskContext.get().partitionId(), 0, MerklePeaks(), None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield held
        starts = at + np.concatenate([[0], np.cumsum(b.column(1).to_numpy())])
        at = int(starts[-1])
        roots = [merkle_root(h) for h in b.column(2).to_pylist()]
        for r in roots:
            tree.add(r)
        cols = [pa.array([part] * len(roots), pa.int32()), b.column(0), pa.array(starts[:-1], pa.int64()), b.column(1), b.column(2), pa.array(roots, pa.binary()), pa.nulls(len(roots), pa.binary())]
        held = pa.record_batch(cols, _RECIPE)
    if held is not None:
        last = pa.array([None] * (held.num_rows - 1) + [tree.root()], pa.binary())
        yield pa.record_batch([*held.columns[:-1], last], _RECIPE)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """(doc_id, text) -> the files described above.  One pass encodes, one shuffle by name keeps one copy of each chunk."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    row = f"kind string, key binary, n_ids long, payload binary, doc_id {id_type}, n_tokens long, hashes array<binary>"
    rows = docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id), row).repartition(n_partitions(spark), "kind", "key")
    # rows of one key are equal; of recipes, repeated documents, the number is kept
    once = rows.groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in _ROW[2:]], F.count("*").alias("copies"))
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/store")
    kept = spark.read.schema(once.schema).parquet(f"{path}/store").where("kind = 'recipe'").select("doc_id", "n_tokens", "hashes", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    ranged = kept.select("doc_id", "n_tokens", "hashes").repartitionByRange(n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "n_tokens", "hashes")
    rec = ranged.mapInArrow(_recipes, f"part int, doc_id {id_type}, local_start long, n_tokens long, hashes array<binary>, root binary, file_root binary")
    rec.write.option("compression", "zstd").parquet(f"{path}/recipes")
    rec = spark.read.schema(rec.schema).parquet(f"{path}/recipes")
    sums = rec.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("file_root").alias("root"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a recipe file
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).write.parquet(f"{path}/manifest")


def _digest(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            crcs = []
            for name, n, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = unpack.decompress(payload)
                ids = np.frombuffer(raw, kind)
                if hashlib.sha256(raw).digest() != name or len(ids) != n:
                    raise ValueError(f"chunk {name.hex()} doesn't match its name")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(crcs, pa.int64())], ["hash", "n_ids", "crc"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(5)
        counts = np.diff(lists.offsets.to_numpy())
        parts = {f: lists.flatten().field(f) for f in ("pos", "n_ids", "crc", "hash")}
        row = np.repeat(np.arange(b.num_rows), counts)
        order = np.lexsort((parts["pos"].to_numpy(), row))
        first = np.concatenate([[0], np.cumsum(counts)])
        upto = np.cumsum(parts["n_ids"].to_numpy()[order])
        ends = upto[first[1:] - 1]
        if (np.diff(np.concatenate([[0], ends])) != b.column(3).to_numpy()).any():
            raise ValueError("a recipe's chunks don't sum to its length")
        crcs = crc32_shift(parts["crc"].to_numpy()[order], 4 * (ends[row] - upto))
        hashes = parts["hash"].take(pa.array(order)).to_pylist()
        for i, root in enumerate(b.column(4).to_pylist()):
            if merkle_root(hashes[first[i] : first[i + 1]]) != root:
                raise ValueError("a recipe doesn't match its Merkle root")
        whole = np.bitwise_xor.reduceat(crcs, first[:-1]).astype(np.int64)
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(whole)], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


_STORE = "key binary, n_ids long, payload binary, kind string"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORE).parquet(f"{path}/store").where("kind = 'chunk'").select(F.col("key").alias("hash"), "n_ids", "payload")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless every recipe file has the documents, the ids and the Merkle root that the manifest says."""

    def tree(pdf):
        import pandas as pd

        pdf, peaks = pdf.sort_values("local_start"), MerklePeaks()
        for r in pdf["root"]:
            peaks.add(bytes(r))
        return pd.DataFrame([(int(pdf["part"].iloc[0]), len(pdf), int(pdf["n_tokens"].sum()), peaks.root())], columns=["part", "n_docs", "n_tokens", "root"])

    rec = spark.read.parquet(f"{path}/recipes").select("part", "local_start", "n_tokens", "root")
    have = rec.groupBy("part").applyInPandas(tree, "part int, n_docs long, n_tokens long, root binary")
    said = spark.read.parquet(f"{path}/manifest").select("part", "n_docs", "n_tokens", "root")
    if not have.exceptAll(said).isEmpty() or not said.select("part").exceptAll(have.select("part")).isEmpty():
        raise ValueError("the recipes don't match the manifest")


def read_digests(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone, every chunk and recipe verified.

    A chunk is unpacked and checked once, however many documents share it; only its name, length and CRC
    go through the join, and the CRC of a document is put together from those of its chunks.
    """
    small_batches(spark)
    verify_manifest(spark, path)
    digests = read_chunks(spark, path).mapInArrow(_digest("<u4" if wide else "<u2"), "hash binary, n_ids long, crc long")
    rec = spark.read.parquet(f"{path}/recipes")
    id_type = rec.schema["doc_id"].dataType.simpleString()
    keys = ["part", "doc_id", "local_start", "n_tokens", "root"]
    each = rec.select(*keys, F.posexplode("hashes").alias("pos", "hash")).join(digests, "hash")
    whole = each.groupBy(*keys).agg(F.collect_list(F.struct("pos", "hash", "n_ids", "crc")).alias("chunks"))
    out = whole.mapInArrow(_assemble, f"part int, doc_id {id_type}, local_start long, n_tokens long, ids_crc32 long")
    base = spark.read.parquet(f"{path}/manifest").select("part", "base")
    return out.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, ids array<int>: the documents themselves, put together from the store."""
    small_batches(spark)
    verify_manifest(spark, path)
    kind = "<u4" if wide else "<u2"

    def join(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            ids = []
            for cs in b.column(1).to_pylist():
                parts = [(c["hash"], unpack.decompress(c["payload"])) for c in sorted(cs, key=lambda c: c["pos"])]
                if any(hashlib.sha256(raw).digest() != name for name, raw in parts):
                    raise ValueError("a chunk doesn't match its name")
                ids.append(np.frombuffer(b"".join(raw for _, raw in parts), kind).astype("i4"))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rec = spark.read.parquet(f"{path}/recipes")
    each = rec.select("part", "doc_id", "local_start", F.posexplode("hashes").alias("pos", "hash")).join(read_chunks(spark, path), "hash")
    whole = each.groupBy("part", "doc_id", "local_start").agg(F.collect_list(F.struct("pos", "hash", "payload")).alias("chunks")).select("doc_id", "chunks")
    return whole.mapInArrow(join, f"doc_id {rec.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def encode_and_verify(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_store(docs, path, tokenizer or default_tokenizer(), end_id)
    return read_digests(spark, path)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_verify(table(spark, sf_dir, "documents"))
