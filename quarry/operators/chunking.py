"""Markdown blocks, search units under a token budget, sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE, _HEADING, _ROW, _ITEM = re.compile(r"^\s*(```|~~~)"), re.compile(r"^(#{1,6})\s+(.+)$"), re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*(?:[-*+]|\d+\.)\s+(.+)$")
_PAGE = re.compile(r"^(?:\f|<!--\s*page[:\s]*(\d+)\s*-->)\s*$", re.IGNORECASE)


def parse(text: str | None) -> list[dict]:
    """Blocks in order: page marks, fences, headings (a heading closes those of its level and below), table rows, lists, paragraphs."""
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    page, seen = 1, {"tbl": 0, "list": 0, "block": 0, "h": 0}
    lines = (text or "").replace("\r\n", "\n").split("\n")
    i = 0

    def put(kind: str, body: list[str], mark: str) -> None:
        seen[mark] += 1
        anchor = f"h{body[0].count('#', 0, 6)}-{seen[mark]}" if mark == "h" else f"{mark}-{seen[mark]}"
        out.append({"ordinal": len(out), "block_type": kind, "section_path": " > ".join(t for _, t in path) or "Root", "page": page, "anchor": anchor, "text": "\n".join(body)})

    def run(ok) -> list[str]:
        nonlocal i
        first = i
        while i < len(lines) and ok(lines[i]):
            i += 1
        return lines[first:i]

    while i < len(lines):
        line = lines[i]
        if not line.strip() and "\f" not in line:
            i += 1
        elif m := _PAGE.match(line):
            page = int(m.group(1)) if m.group(1) else page + 1
            i += 1
        elif m := _FENCE.match(line):
            first, i = i, i + 1
            run(lambda x, f=m.group(1): not x.strip().startswith(f))
            i += 1
            put("code", lines[first:i], "block")
        elif m := _HEADING.match(line):
            level, title = len(m.group(1)), m.group(2).strip()
            path[:] = [p for p in path if p[0] < level]
            if not (level == 1 and out and any(b["block_type"] == "heading" and b["text"] == line for b in out)):
                path.append((level, title))
            put("heading", [line], "h")
            i += 1
        elif _ROW.match(line):
            put("table", run(_ROW.match), "tbl")
        elif _ITEM.match(line):
            put("list", run(lambda x: bool(_ITEM.match(x)) or (x[:1] in " \t" and x.strip() != "")), "list")
        else:
            put("paragraph", run(lambda x: x.strip() != "" and not (_FENCE.match(x) or _HEADING.match(x) or _ROW.match(x) or _ITEM.match(x) or _PAGE.match(x))) or run(lambda x, n=[0]: n.append(1) or len(n) == 2), "block")
    return out


def blocks(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row a block.  Block state runs from line to line, hence a Pandas pass; each text is a row of its own."""
    cols = ["ordinal", "block_type", "section_path", "page", "anchor", "text"]

    def run(parts):
        for pdf in parts:
            rows = [(i, *(b[c] for c in cols)) for i, t in zip(pdf[id_col], pdf[text], strict=True) for b in parse(t)]
            yield pd.DataFrame(rows, columns=[id_col, *cols])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, ordinal int, block_type string, section_path string, page int, anchor string, text string")


def units(blocks: DataFrame, id_col: str, budget: int) -> DataFrame:
    """Greedy fill: blocks in order until the next would pass the budget or a heading opens a section; a fold inside each document."""
    from ..functions.text import token_estimate

    b = blocks.withColumn("_t", token_estimate(F.col("text")).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "_t", (F.col("block_type") == "heading").alias("_h"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("unit"), F.lit(True).alias("head"), F.expr("CAST(array() AS array<int>)").alias("units"))

    def step(a: Column, r: Column) -> Column:
        new = (a["unit"] < 0) | (r["_h"] & ~a["head"]) | (a["used"] + r["_t"] > budget)
        unit = F.when(new, a["unit"] + 1).otherwise(a["unit"])
        used = F.when(new, r["_t"]).otherwise(a["used"] + r["_t"])
        return F.struct(used.alias("used"), unit.alias("unit"), r["_h"].alias("head"), F.concat(a["units"], F.array(unit)).alias("units"))

    folded = b.groupBy(id_col).agg(rows.alias("rows")).select(id_col, F.arrays_zip("rows", F.aggregate("rows", start, step)["units"].alias("unit")).alias("z"))
    each = folded.select(id_col, F.explode("z").alias("z")).select(id_col, F.col("z.unit").alias("unit_no"), F.col("z.rows.ordinal").alias("o"), F.col("z.rows._t").alias("t"))
    return each.groupBy(id_col, "unit_no").agg(F.min("o").alias("block_from"), F.max("o").alias("block_to"), F.sum("t").alias("tokens"))


def sentences(text: Column) -> Column:
    """Pieces, trimmed, that end after . ! ? (not between digits, so decimals stay whole) or at a line end."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?![\d.!?])|\n")
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda s: s != "")
