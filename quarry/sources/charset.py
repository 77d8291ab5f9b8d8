"""Detection of encodings by a model of letter pairs.

The model is counted from texts that are known to be right, by Spark: how often two characters follow each other.  Bytes that are
neither marked nor valid UTF-8 are decoded by each candidate, and the one whose pairs around letters beyond ASCII are most likely wins;
all candidates agree on the rest.  Encodings of East Asia, two bytes a character, have a rule of their own and come first.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import _text_or_none

# Marks, longest first, and the encodings that may be meant without one.
MARKS = ((b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16"), (b"\xff\xfe", "utf-16"))
EAST_ASIAN = ("gb18030", "gbk", "big5", "shift_jis", "euc_kr")
SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "iso8859_2", "iso8859_15", "koi8_r", "mac_roman", "cp850", "cp866")
_KANA = re.compile(r"[぀-ヿ]")
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
#: Pairs that a model keeps, by frequency.
MOST_PAIRS = 50_000


def _plain(text: str) -> str:
    """Lower case; what is no letter is a space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def pair_counts(docs: DataFrame, text: str, most: int = MOST_PAIRS) -> DataFrame:
    """(pair, n): the most frequent pairs of characters of which one is beyond ASCII, and those of ASCII letters."""

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                p = _plain(t or "")
                n.update(map("".join, zip(p, p[1:])))
            yield pa.record_batch([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["pair", "n"])

    each = docs.select(text).mapInArrow(run, "pair string, n long")
    return each.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(most)


class Model:
    def __init__(self, rows: list[tuple[str, int]]):
        total = sum(n for _, n in rows) + len(rows) + 1
        self.log = {p: math.log((n + 1) / total) for p, n in rows}
        self.none = math.log(1 / total)

    def likely(self, text: str) -> float:
        """Mean log probability of the pairs with a character beyond ASCII.  Signs among letters are what wrong encodings make."""
        p = _plain(text)
        odd = [i for i, c in enumerate(text.lower()) if c > "\x7f"] if len(p) == len(text) else [i for i, c in enumerate(p) if c > "\x7f"]
        if not odd:
            return 0.0
        total = 0.0
        for i in odd:
            for a in (i - 1, i):
                pair = p[a : a + 2] if a >= 0 else " " + p[0]
                total += self.none * 1.5 if p[i] == " " else self.log.get(pair, self.none)
        return total / (2 * len(odd))


def model(counts: DataFrame) -> Model:
    return Model([tuple(r) for r in counts.collect()])  # MOST_PAIRS rows


def _unmarked_utf16(raw: bytes) -> str | None:
    """utf-16 and utf-32 without a mark show by where their zero bytes stand."""
    if len(raw) < 4 or 0 not in raw:
        return None
    share = [raw[i::4].count(0) / max(1, len(raw[i::4])) for i in range(4)]
    if min(share[0], share[1]) > 0.9 and share[3] < 0.5 or share[0] > 0.95 and share[1] > 0.8:
        return "utf-32-be"
    if share[3] > 0.95 and share[2] > 0.8:
        return "utf-32-le"
    if share[1] > 0.3 and share[3] > 0.3 and share[0] < 0.1:
        return "utf-16-le"
    return "utf-16-be" if share[0] > 0.3 and share[2] > 0.3 and share[1] < 0.1 else None


def detect(raw: bytes | None, pairs: Model) -> tuple[str, str] | None:
    """(encoding, text); None for bytes that aren't text in any way."""
    if raw is None:
        return None
    mark = next((name for m, name in MARKS if raw.startswith(m)), None)
    if mark:
        t = _text_or_none(raw.decode(mark, "replace"))
        return None if t is None else (mark, t)
    name = _unmarked_utf16(raw)
    if name:
        t = _text_or_none(raw.decode(name, "replace"))
        return None if t is None else (name, t)
    try:
        t = _text_or_none(raw.decode("utf-8"))
        return None if t is None else ("utf-8", t)
    except UnicodeDecodeError:
        pass
    found = []
    for name in EAST_ASIAN:
        t = raw.decode(name, "replace")
        n, bad, east = max(1, len(t)), t.count("�"), len(_EAST.findall(t))
        if east >= 0.05 * n and bad <= max(2, n // 100) and _text_or_none(t) is not None:
            # kana come out of Japanese bytes only; other readings of them give rare ideographs or half-width signs
            found.append((100 * bad / n - (east + len(_KANA.findall(t))) / n, EAST_ASIAN.index(name), name, t))
    single = []
    for name in SINGLE:
        try:
            t = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if _text_or_none(t) is not None:
            single.append((pairs.likely(t), -SINGLE.index(name), name, t))
    best = max(single, default=None)
    if found and (best is None or best[0] < pairs.none * 0.9):
        return min(found)[2:]
    if best:
        return best[2:]
    t = _text_or_none(raw.decode("cp1252", "replace"))
    return None if t is None else ("cp1252", t)


def decoded(content: Column, pairs: Model) -> Column:
    """Struct of encoding and text of bytes; valid UTF-8 without a mark stays in the JVM."""
    kind = T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())])

    @F.pandas_udf(kind)
    def guess(s: pd.Series) -> pd.DataFrame:
        rows = [detect(None if x is None else bytes(x), pairs) or (None, None) for x in s]
        return pd.DataFrame(rows, columns=["encoding", "text"])

    text = content.cast("string")
    plain = F.is_valid_utf8(text) & ~F.hex(F.substring(content, 1, 3)).isin("EFBBBF") & (F.instr(text, "\x00") == 0) & ~text.rlike(r"[\x01-\x08\x0b\x0e-\x1f]")
    return F.when(plain, F.struct(F.lit("utf-8").alias("encoding"), text.alias("text"))).otherwise(guess(content))
