"""Entity anchors of a text: typed patterns in priority order, then runs of capitalised words, without overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Patterns by class, in order of priority, with their confidence and tier.
CLASSES = [
    ("uri", r"(?:https?|[a-z][a-z0-9+.-]*)://[^\s<>\])]*[^\s<>\]).,;:!?]", 0.96, "E0"),
    ("email", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", 0.96, "E0"),
    ("uuid_ip", r"\b(?:[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,}|(?:\d{1,3}\.){3}\d{1,3})\b", 0.95, "E0"),
    ("backtick", r"`([^`\n]{2,80})`", 0.80, "E1"),
    ("bracket", r"[《「『【]([^》」』】\n]{2,80})[》」』】]", 0.92, "E0"),
    ("date_code", r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,6}(?:/[\w-]+){1,4})\b", 0.95, "E0"),
    ("api_path", r"(?<![\w$:/])/(?:[\w.{}-]+/)+[\w.{}-]*", 0.94, "E0"),
    ("numeric", r"\b(?:[A-Z]{2,12}-\d[\w-]*\b|v\d+(?:\.\d+){1,3}\b|\d+(?:\.\d+)?%(?!\w)|\d+\.\d+(?:\.\d+)*\b|(?:19|20)\d{2}\b)", 0.92, "E0"),
    ("katakana", r"[゠-ヿー]{2,40}", 0.88, "E0"),
]
_COMPILED = [(name, re.compile(p), c, tier) for name, p, c, tier in CLASSES]
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
MOST_WORDS = 7


def _capital_runs(line: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
    """Chains of capitalised words (a short lower-case word may bridge two), and lone ones that don't open the sentence."""
    free = [m for m in _WORD.finditer(line) if not any(a < m.end() and m.start() < z for a, z in taken)]
    i = 0
    while i < len(free):
        if not free[i].group()[0].isupper():
            i += 1
            continue
        j, bridged, last = i + 1, False, i
        while j < len(free) and j - i < MOST_WORDS and re.fullmatch(r"[ \t]+", line[free[j - 1].end() : free[j].start()]):
            word = free[j].group()
            if word[0].isupper() or (word.isdigit() and len(word) <= 4):
                last, j = j, j + 1
            elif not bridged and len(word) <= 6 and j + 1 < len(free) and free[j + 1].group()[0].isupper():
                bridged, j = True, j + 1
            else:
                break
        opens = re.search(r"(?:^|[.!?:]\s*)$", line[: free[i].start()]) is not None
        lone = free[i].group()
        if last > i:
            yield free[i].start(), free[last].end(), 0.95
        elif (lone.isupper() and len(lone) >= 2) or not opens:
            yield free[i].start(), free[i].end(), 0.92
        i = last + 1


def extract(text: str | None) -> list[tuple[str, str, int, int, float, str]]:
    """(class, label, start, end, confidence, tier), first come by priority, spans never overlap."""
    if not text:
        return []
    out, taken = [], []

    def put(kind, start, end, label, confidence, tier):
        if not any(a < end and start < z for a, z in taken):
            taken.append((start, end))
            out.append((kind, label, start, end, confidence, tier))

    for kind, pattern, confidence, tier in _COMPILED:
        for m in pattern.finditer(text):
            label = m.group(m.lastindex or 0).strip()
            if kind == "date_code" and label.count("/") == 1 and not re.search(r"[^\W\d_]", label):
                continue
            put(kind, m.start(), m.end(), label, confidence, tier)
    at = 0
    for line in re.split(r"[\r\n]", text):
        inside = [(a - at, z - at) for a, z in taken]
        for a, z, confidence in list(_capital_runs(line, inside)):
            put("name", at + a, at + z, line[a:z], confidence, "E0")
        at += len(line) + 1
    return sorted(out, key=lambda r: r[2])


def anchors(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind, label, start, end, confidence, tier): overlap resolution is sequential, hence a Pandas pass."""

    def run(parts):
        for pdf in parts:
            rows = [(i, *a) for i, t in zip(pdf[id_col], pdf[text], strict=True) for a in extract(t)]
            yield pd.DataFrame(rows, columns=[id_col, "kind", "label", "start", "end", "confidence", "tier"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, kind string, label string, start long, end long, confidence double, tier string")
