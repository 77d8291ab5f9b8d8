"""Text scalars as Column expressions: normal forms, tokens, stems, matches, hashes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scripts written without spaces, the stopword list, page-number patterns.
CONTINUOUS = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{0e00}-\x{0eff}\x{1780}-\x{17ff}\x{1000}-\x{109f}"
STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into over after is are was were be been being have has had do does did can could "
    "this that these those it its as what when where who whom whose which why how "
    "là và của cho với trong được có đã đang sẽ các những một này đó tại về từ theo khi như bởi vì nếu thì mà để đến tới ra vào lên xuống "
    "cũng vẫn đều chỉ rất quá lắm rồi hay hoặc nhưng gì nào ai đâu sao thế bao nhiêu không chưa phải"
).split()
PAGE_NUMBER = [r"^(?i:trang|page)\s+\d+(?:\s*(?:/|(?i:of))\s*\d+)?$", r"^[-—–]\s*\d+\s*[-—–]$", r"^\d+\s*/\s*\d+$"]
WORD = r"[\p{L}\p{N}_]+"
BUCKETS = 1_000_000


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column, ascii_only: Column | None = None) -> Column:
    """NFC; only texts with a character beyond Latin-1 leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\xFF]"), _nfc(text)).otherwise(text)


def trimmed(text: Column) -> Column:
    """NFC, without white space around."""
    return F.regexp_replace(nfc(text), r"(?U)^\s+|\s+$", "")


def normalize(text: Column, keep_code: bool = False) -> Column:
    """NFC, no control or format characters but line ends and tabs, Unix line ends, trimmed."""
    clean = F.regexp_replace(nfc(text), r"[\p{C}&&[^\n\t\r]]", "")
    if keep_code:
        return F.regexp_replace(clean, r"\s+\z", "")
    return F.regexp_replace(F.regexp_replace(clean, r"\r\n?", "\n"), r"\A\s+|\s+\z", "")


def token_estimate(text: Column) -> Column:
    """Characters of scripts without spaces, plus words of what is left; at least 1 for a text that isn't empty."""
    run = f"[{CONTINUOUS}]"
    chars = F.size(F.regexp_extract_all(text, F.lit(run), F.lit(0)))
    words = F.size(F.regexp_extract_all(F.regexp_replace(text, run, " "), F.lit(r"\S+"), F.lit(0)))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), chars + words))


def lexical(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spaced(text: Column) -> Column:
    """' tok tok ', or '' without tokens."""
    t = lexical_tokens(text)
    return F.when(F.size(t) == 0, "").otherwise(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")))


def ascii_root(word: Column) -> Column:
    """English root of an ASCII word of five letters or more: plural, then one of six endings, then a final e; never below four letters."""
    w = F.when(word.rlike("^.{3,}ies$"), F.regexp_replace(word, "ies$", "y")).otherwise(F.regexp_replace(word, "^(?!.*(?:ss|us|is)$)(.{4,})s$", "$1"))
    w = F.regexp_replace(w, "^(?!.*eed$)(.{4,})(?:ations|ation|ingly|edly|ing|ed)$", "$1")
    w = F.regexp_replace(w, "^(?!.*(?:ee|le)$)(.{4,})e$", "$1")
    return F.when(word.rlike("^[A-Za-z]{5,}$"), w).otherwise(word)


def index_stem(word: Column) -> Column:
    """Stem under which the sparse index files a word a second time, or null."""
    stem = (
        F.when(word.rlike("^[a-z]{4,}ing$"), F.regexp_replace(word, "ing$", ""))
        .when(word.rlike("^[a-z]{4,}ed$") & ~word.rlike("eed$"), F.regexp_replace(word, "ed$", ""))
        .when(word.rlike("^[a-z]{4,}s$") & ~word.rlike("(ss|us|is)$"), F.regexp_replace(word, "s$", ""))
    )
    return F.when(word.rlike("^[a-z]+$") & (F.length(stem) >= 4), stem)


def md5_bucket(word: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), F.lit(BUCKETS))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def minhash_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{CONTINUOUS}]|{WORD}"), F.lit(0))


def diff_tokens(text: Column) -> Column:
    """Tokens for comparing wordings: no thousands commas, contractions written out, numbers and versions whole."""
    t = F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d{3}(?!\d))", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\bwon['’]t\b", "will not"), r"\bcan['’]?t\b|\bcannot\b", "can not")
    t = F.regexp_replace(t, r"\b(\w+)n['’]t\b", "$1 not")
    return F.regexp_extract_all(t, F.lit(rf"v?\d+(?:\.\d+)*|[{CONTINUOUS}]|{WORD}"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Words of the sparse index: thousands commas out, R&D becomes rd, runs without spaces become pairs of characters."""
    t = F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d{3}(?!\d))", "")
    t = F.regexp_replace(t, r"\b([a-z]{1,2})\s*&\s*([a-z]{1,2})\b", "$1$2")
    words = F.regexp_extract_all(t, F.lit(rf"[{CONTINUOUS}]+|[\p{{L}}\p{{N}}_&&[^{CONTINUOUS}]]+"), F.lit(0))
    pairs = lambda w: F.when(
        w.rlike(f"^[{CONTINUOUS}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: w.substr(i, F.lit(2)))
    ).otherwise(F.array(w))
    return F.flatten(F.transform(words, pairs))


def glued_parts(word: Column) -> Column:
    """fy2018 also counts as 2018: letter runs and digit runs (two or more) of a mixed token of three or more."""
    mixed = word.rlike(r"^[\p{L}\p{N}]{3,}$") & word.rlike(r"\p{L}") & word.rlike(r"\p{N}")
    return F.when(mixed, F.filter(F.regexp_extract_all(word, F.lit(r"[a-z]+|\d{2,}"), F.lit(0)), lambda p: F.length(p) >= 2)).otherwise(F.array().cast("array<string>"))


def knowledge_terms(text: Column) -> Column:
    """Pairs of characters in runs without spaces; other words of two characters or more, or of digits."""
    return F.filter(index_tokens(text), lambda w: (F.length(w) >= 2) | w.rlike(r"^\p{N}+$") | w.rlike(f"^[{CONTINUOUS}]$"))


def content_terms(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ((F.length(w) >= 2) | w.rlike(r"^\d+$")) & ~F.array_contains(stop, w)))


def is_page_number(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return t.rlike(PAGE_NUMBER[0]) | t.rlike(PAGE_NUMBER[1]) | t.rlike(PAGE_NUMBER[2])


def contextualize(path: Column, text: Column) -> Column:
    """The section path before the text, once."""
    return F.when((F.coalesce(path, F.lit("")) == "") | F.startswith(text, path), text).otherwise(F.concat(path, F.lit("\n\n"), text))


def term_matches(term: Column, spaced_text: Column) -> Column:
    """Whether a lexical term occurs in a spaced text: digit-bearing terms anywhere, others as a word, a plural, or a root."""
    compact = F.replace(spaced_text, F.lit(" "), F.lit(""))
    word = lambda t: F.contains(spaced_text, F.concat(F.lit(" "), t, F.lit(" ")))
    roots = F.transform(F.filter(F.split(F.trim(spaced_text), " "), lambda w: w.rlike("^[A-Za-z]{4,}$")), ascii_root)
    singular = (F.length(term) >= 5) & term.rlike("s$") & ~term.rlike("(ss|us|is)$") & word(F.regexp_replace(term, "s$", ""))
    plural = (F.length(term) >= 4) & ~term.rlike("s$") & word(F.concat(term, F.lit("s")))
    root = term.rlike("^[A-Za-z]{5,}$") & F.array_contains(roots, ascii_root(term))
    usual = word(term) | singular | plural | root
    return F.when((term == "") | (spaced_text == ""), False).otherwise(F.when(term.rlike(rf"\d|[{CONTINUOUS}]"), F.contains(compact, term)).otherwise(usual))


def proximity(a: Column, b: Column, spaced_text: Column) -> Column:
    """1 if two terms stand side by side, 0.65 if within max(56, their lengths + 32) characters, else 0."""
    one = lambda x, y: F.contains(spaced_text, F.concat(F.lit(" "), x, F.lit(" "), y, F.lit(" ")))
    pa, pb = F.instr(spaced_text, F.concat(F.lit(" "), a, F.lit(" "))), F.instr(spaced_text, F.concat(F.lit(" "), b, F.lit(" ")))
    far = F.greatest(F.lit(56), F.length(a) + F.length(b) + 32)
    return F.when(one(a, b) | one(b, a), 1.0).when((pa > 0) & (pb > 0) & (F.abs(pa - pb) <= far), 0.65).otherwise(0.0)


def escape_like(term: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", term)


def grep(text: Column, term: str) -> Column:
    """Case-insensitive literal match: the pattern's own wildcards are escaped."""
    return text.ilike("%" + escape_like(term) + "%")


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    return F.concat(head, F.regexp_replace(F.substring(u, F.length(head) + 1, F.length(u)), r"/+$", ""))
