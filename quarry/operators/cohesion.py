"""Topic segments of prose, and search units cut by how well their blocks hold together.

A text is cut into sentences; sentences are bags of character triples and quadruples, weighed by how few sentences hold them and
smoothed over their neighbours.  Their cosines are replaced by local ranks (the share of the 5 x 5 neighbourhood that is smaller),
and a dynamic programme finds the cuts of most cohesion.  A segment has at most ``most`` tokens, so only a band around the
diagonal is ever looked at: similarities come from blocks of a few band widths, and cost grows with the text, not
with its square.

A text is one row: its state runs from sentence to sentence.  The work is on the CPU, so texts are dealt round robin first: a few
large files are then no few large tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import text as X
from ..functions.embedding import embed
from .chunking import parse

_CONTINUOUS = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m.group(1), 16)), X.CONTINUOUS) + "]")
# Where a sentence and a clause may end; a label is this short.
_SENTENCE, _CLAUSE = re.compile(r"(?<=[.!?。！？；;])\s+(?=\S)|\n+"), re.compile(r"(?<=[,，、:：；;])\s*|\s+(?=[\(\[（])")
LABEL_CHARS, LABEL_TOKENS = 12, 3
# Smoothing over neighbours, radius of local ranks, what a cut and a missing token of a short segment cost.
SMOOTH, RADIUS, CUT, SHORT = 0.25, 2, 4.5, 0.18
MOST, LEAST = 360, 48
# Fixed values of the cut of a section: bounds of its threshold, small blocks, the size that units should have.
FLOOR, CEILING, SPREAD, WEAK, SMALL, GOOD = 0.62, 0.78, 0.35, 0.52, 40, 384
BUDGET = 512


def estimate(text: str) -> int:
    """Characters of scripts without spaces and words of the rest; 0 for an empty text, else at least 1."""
    rest, n = _CONTINUOUS.subn(" ", text)
    return max(1, n + len(rest.split())) if text else 0


def spans(text: str, most: int) -> list[str]:
    """Sentences; a short label goes with what follows it, and a sentence of more than ``most`` tokens is cut into clauses."""
    pieces = [p.strip() for p in _SENTENCE.split(text) if p.strip()]
    joined: list[str] = []
    label = None
    for n, p in enumerate(pieces):
        if label is not None:
            joined.append(f"{label} {p}")
            label = None
        elif n + 1 < len(pieces) and len(p) <= LABEL_CHARS and estimate(p) <= LABEL_TOKENS:
            label = p
        else:
            joined.append(p)
    out = []
    for s in joined:
        clauses = [c.strip() for c in _CLAUSE.split(s) if c and c.strip()] if estimate(s) > most else []
        out += fill(clauses, most // 2, " ") if len(clauses) > 1 else [s]
    return out


def fill(parts: list[str], budget: int, glue: str) -> list[str]:
    """Parts joined in order while they fit a budget of tokens."""
    groups: list[list[str]] = []
    used = budget + 1
    for p in parts:
        n = max(1, estimate(p))
        if not groups or used + n > budget:
            groups.append([])
            used = 0
        groups[-1].append(p)
        used += n
    return [glue.join(g) for g in groups]


def _grams(sentence: str) -> Counter:
    s = f" {' '.join(sentence.casefold().split())} "
    return Counter([s[i : i + k] for k in (3, 4) for i in range(len(s) - k + 1)]) if len(s) > 2 else Counter([s.strip()])


def _products(grams: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Products of n sentences' weights with each other's; a gram of one sentence alone only adds to that one's square."""
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    alone = times[at] == 1
    x = np.zeros((n, int((times > 1).sum())))
    x[rows[~alone], (np.cumsum(times > 1) - 1)[at[~alone]]] = weights[~alone]
    out = x @ x.T
    out[np.arange(n), np.arange(n)] += np.bincount(rows[alone], weights[alone] ** 2, minlength=n)
    return out


def _band(bags: list[Counter], width: int) -> np.ndarray:
    """Row i, column width + d: the cosine of smoothed sentences i and i + d; NaN beyond the text."""
    m = len(bags)
    number: dict[str, int] = {}
    ends = np.cumsum([0, *map(len, bags)])
    grams = np.array([number.setdefault(g, len(number)) for b in bags for g in b], np.int64)
    df = np.bincount(grams, minlength=len(number))
    # few distinct numbers of sentences: each logarithm is taken once
    logs = np.array([math.log(1 + m / max(1, k)) for k in range(int(df.max(initial=0)) + 1)])
    weights = np.fromiter((n for b in bags for n in b.values()), float, len(grams)) * logs[df[grams]]
    out = np.full((m, 2 * width + 1), np.nan)
    step = max(64, width)
    for first in range(0, m, step):
        lo, hi = max(0, first - 1), min(m, first + step + width + 1)  # a neighbour more on both sides, for smoothing
        product = _products(grams[ends[lo] : ends[hi]], weights[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), hi - lo)
        for _ in range(2):  # smoothing of rows, then of columns
            smooth = product.copy()
            smooth[1:] += SMOOTH * product[:-1]
            smooth[:-1] += SMOOTH * product[1:]
            product = smooth.T
        norm = np.maximum(np.sqrt(np.diag(product)), 1e-300)
        last = min(m, first + step)
        here, there = slice(first - lo, last - lo), slice(first - lo, min(m, last + width) - lo)
        cosines = np.round(np.clip(product[here, there] / norm[here, None] / norm[None, there], 0, 1), 12)
        for d in range(width + 1):
            i = np.arange(first, min(last, m - d))
            c = cosines[i - first, i - first + d] if d else np.ones(len(i))
            out[i, width + d] = c
            out[i + d, width - d] = c
    return out


def _local_ranks(band: np.ndarray, width: int, most: int) -> np.ndarray:
    """Row i, column d < most: the share of the neighbours of cell (i, i + d) that are smaller."""
    m = len(band)
    own = band[:, width : width + most]
    less, count = np.zeros(own.shape), np.zeros(own.shape)
    for di in range(-RADIUS, RADIUS + 1):
        moved = np.full((m, band.shape[1]), np.nan)
        a, z = max(0, -di), min(m, m - di)
        moved[a:z] = band[a + di : z + di]
        for dj in range(-RADIUS, RADIUS + 1):
            if di or dj:
                near = moved[:, width + dj - di : width + dj - di + most]
                less += near < own
                count += ~np.isnan(near)
    return np.where(np.isnan(own), 0.0, less / np.maximum(count, 1))


def cuts(tokens: list[int], bags: list[Counter], most: int, least: int) -> list[tuple[int, int]]:
    """The segments [a, b) of most cohesion."""
    m = len(tokens)
    before = np.concatenate([[0], np.cumsum(tokens)])
    # the first sentence from which a segment may reach to b
    start = np.minimum(np.searchsorted(before, before[1:] - most, "left"), np.arange(m))
    longest = int((np.arange(1, m + 1) - start).max())
    width = longest + 2 * RADIUS
    ranks = _local_ranks(_band(bags, width), width, longest)
    ranks[:, 1:] *= 2  # a cell and its mirror image
    rows = np.cumsum(ranks, axis=1)
    best, back = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for b in range(1, m + 1):
        a = np.arange(b - 1, start[b - 1] - 1, -1)
        size, n = before[b] - before[a], b - a
        inside = np.cumsum(rows[a, n - 1])  # of the square [a, b), one row more at a time
        score = best[a] + size * inside / (n * n) - CUT
        if m > 2:
            score -= SHORT * np.maximum(0, least - size)
        top = int(np.argmax(score))  # the shortest of equals
        best[b], back[b] = score[top], a[top]
    out, at = [], m
    while at:
        out.append((int(back[at]), at))
        at = int(back[at])
    return out[::-1]


def segments(text: str | None, most: int = MOST, least: int = LEAST) -> list[str]:
    """Topic segments of a text, in order; a short text is one, an empty one none."""
    text = (text or "").strip()
    if not text or estimate(text) <= most:
        return [text] if text else []
    s = spans(text, most)
    if len(s) < 2:
        return [text]
    return [" ".join(s[a:b]) for a, b in cuts([estimate(x) for x in s], [_grams(x) for x in s], most, least)]


def _dealt(docs: DataFrame) -> DataFrame:
    return docs.repartition(max(8, 4 * docs.sparkSession.sparkContext.defaultParallelism))


def prose_segments(docs: DataFrame, id_col: str, text: str, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(id, segment, tokens, text): the topic segments of each text."""

    def run(frames):
        for f in frames:
            rows = [(i, n, estimate(s), s) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for n, s in enumerate(segments(t, most, least))]
            yield pd.DataFrame(rows, columns=[id_col, "segment", "tokens", "text"])

    return _dealt(docs.select(id_col, text)).mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, segment int, tokens int, text string")


# ---- search units -----------------------------------------------------------------------------


def section_cuts(tokens: list[int], vectors: np.ndarray | None, lead: int, budget: int) -> list[tuple[int, int]]:
    """Units [a, b) of a section's blocks, its headings' ``lead`` tokens before the first of them.

    With vectors (one a block, of length 1): neighbours stay together above a threshold that follows the section's own cosines, small
    blocks more readily, and the cuts of most cohesion win.  Without: blocks in order while they fit.
    """
    m = len(tokens)
    lead = lead if lead + tokens[0] <= budget else 0
    if vectors is None or m < 2:
        out, first, used = [], 0, lead
        for i, n in enumerate(tokens):
            if i > first and used + n > budget:
                out.append((first, i))
                first, used = i, 0
            used += n
        return [*out, (first, m)]
    near = (vectors[:-1] * vectors[1:]).sum(axis=1)
    limit = max(FLOOR, min(CEILING, float(near.mean() - SPREAD * near.std())))
    weighed = vectors * np.sqrt(np.maximum(1, tokens))[:, None]
    best, back = [0.0] + [-math.inf] * m, [0] * (m + 1)
    for b in range(1, m + 1):
        size, weakest, small, centre = 0, math.inf, False, np.zeros(vectors.shape[1])
        for a in range(b - 1, -1, -1):
            size, small, centre = size + tokens[a], small or tokens[a] < SMALL, centre + weighed[a]
            whole = size + (lead if a == 0 else 0)
            if b - a == 1:
                gain = -0.35 * max(0, SMALL - tokens[a])
            elif whole > budget:
                break
            else:
                weakest = min(weakest, float(near[a]))
                if weakest < WEAK:
                    break  # longer units hold the same gap
                norm = math.sqrt(centre @ centre) or 1.0
                to_centre = vectors[a:b] @ centre / norm
                together = weakest >= limit and to_centre.min() >= limit
                if not together and not (small and whole <= GOOD):
                    continue
                gain = float((np.array(tokens[a:b]) * np.maximum(0, to_centre - limit)).sum()) + 4.0 * (b - a - 1) - 0.08 * max(0, whole - GOOD)
            if best[a] + gain > best[b]:
                best[b], back[b] = best[a] + gain, a
    out, at = [], m
    while at:
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def oversized(kind: str, text: str, budget: int, overlap: int = 0) -> list[str]:
    """A block of more than ``budget`` tokens in parts: a table by rows under its repeated header, prose by topic, what is left by words."""
    lines = text.splitlines()
    if len(lines) > 1 and (kind == "table" or re.fullmatch(r"\s*\|.*\|\s*", lines[0])):
        head = lines[: 2 if set(lines[1].strip()) <= set("|-: ") else 1]
        rows = fill(lines[len(head) :], max(64, budget - sum(map(estimate, head))), "\n")
        return ["\n".join([*head, r]) for r in rows] or [text]
    if kind in ("code", "list") and len(lines) > 1:
        return fill(lines, budget, "\n")
    out: list[str] = []
    for s in segments(text, budget, min(LEAST, budget // 4)):
        words = s.split()
        if estimate(s) <= budget:
            out.append(s)
        elif len(words) > budget:
            out += [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]
        else:
            out += [s[i : i + budget] for i in range(0, len(s), budget)]
    if overlap:
        out = [out[0], *[f"{' '.join(x.split()[-overlap:])} {y}" for x, y in zip(out, out[1:])]]
    return out


def units(blocks: list[dict], budget: int = BUDGET, overlap: int = 0, vector=embed) -> list[dict]:
    """Search units of a document's blocks: headings go with the first unit of their section, a section is cut by cohesion."""
    out: list[dict] = []
    heads: list[dict] = []
    body: list[dict] = []

    def put(group: list[dict], text: str | None = None, part: bool = False) -> None:
        text = "\n\n".join(b["text"] for b in group) if text is None else text
        last = group[-1]
        out.append({"unit": len(out), "block_from": group[0]["ordinal"], "block_to": last["ordinal"], "page_from": group[0]["page"], "page_to": last["page"], "section_path": last["section_path"] or group[0]["section_path"], "tokens": max(1, estimate(text)), "is_part": part, "text": text})

    def close() -> None:
        if heads and not body:
            put(list(heads))
        elif body:
            lead, tokens = sum(b["tokens"] for b in heads), [b["tokens"] for b in body]
            vectors = np.array([vector(b["text"]) for b in body]) if vector is not None and len(body) > 1 else None
            for n, (a, b) in enumerate(section_cuts(tokens, vectors, lead, budget)):
                own = body[a:b]
                if n == 0 and heads:
                    if lead + sum(tokens[a:b]) <= budget:
                        own = [*heads, *own]
                    else:
                        put(list(heads))
                put(own)
        heads.clear()
        body.clear()

    for block in blocks:
        block = {**block, "tokens": max(1, estimate(block["text"]))}
        heading = block["block_type"] == "heading"
        if (heading and body) or block["tokens"] > budget:
            close()
        if block["tokens"] > budget:
            parts = oversized(block["block_type"], block["text"], budget, overlap)
            for p in parts:
                put([block], p, len(parts) > 1)
        else:
            (heads if heading else body).append(block)
    close()
    return out


def search_units(docs: DataFrame, id_col: str, text: str, budget: int = BUDGET, overlap: int = 0, by_vectors: bool = True) -> DataFrame:
    """One row a search unit of each text."""
    columns = ["unit", "block_from", "block_to", "page_from", "page_to", "section_path", "tokens", "is_part", "text"]

    def run(frames):
        for f in frames:
            rows = [(i, *(u[c] for c in columns)) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for u in units(parse(t), budget, overlap, embed if by_vectors else None)]
            yield pd.DataFrame(rows, columns=[id_col, *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    return _dealt(docs.select(id_col, text)).mapInPandas(run, f"{id_col} {kind}, unit int, block_from int, block_to int, page_from int, page_to int, section_path string, tokens int, is_part boolean, text string")
