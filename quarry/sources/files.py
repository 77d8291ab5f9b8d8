"""Files as documents: allowed kinds, routing, decoding with detection, OOXML text, JSON Lines packages."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes by the way they are read.
TEXT = "md markdown txt text html htm json yaml yml xml drawio sql epub".split()
TABLE = "csv tsv xlsx xls".split()
REMOTE = "pdf doc ppt png jpg jpeg gif bmp tiff webp".split()
INSPECT = "docx pptx odt ods odp rtf".split()
MAGIC = {"pdf": "25504446", "png": "89504E47", "zip": "504B0304"}


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def route(name: Column) -> Column:
    """remote, inspect (OOXML goes remote if it holds pictures), table, text or rejected."""
    s = suffix(name)
    return F.when(s.isin(REMOTE), "remote").when(s.isin(INSPECT), "inspect").when(s.isin(TABLE), "table").when(s.isin(TEXT), "text").otherwise("rejected")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, sha256, suffix, magic_ok: any store that Spark reads."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 4))
    ok = F.lit(True)
    for kind, mark in MAGIC.items():
        ok = F.when(suffix(F.col("path")) == kind, head == mark).otherwise(ok)
    return d.select("path", "content", F.sha2("content", 256).alias("sha256"), suffix(F.col("path")).alias("suffix"), ok.alias("magic_ok"))


def decode(raw: bytes | None) -> str | None:
    """BOM, then UTF-8, then the East Asian encoding that leaves fewest replacements and most such characters, then cp1252.

    None for bytes that aren't text: a NUL, or more than one control character in a hundred.
    """
    if raw is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return _text_or_none(raw.decode(name, "replace"))
    try:
        return _text_or_none(raw.decode("utf-8"))
    except UnicodeDecodeError:
        pass
    worth = []
    for name in ("gb18030", "big5", "shift_jis"):
        t = raw.decode(name, "replace")
        n = max(1, len(t))
        worth.append((100 * t.count("�") / n - len(re.findall(r"[぀-ヿ㐀-鿿]", t)) / n, t))
    cost, best = min(worth)
    return _text_or_none(best if cost < -0.3 else raw.decode("cp1252", "replace"))


def _text_or_none(t: str) -> str | None:
    control = sum(1 for c in t if ord(c) < 32 and c not in "\t\n\r\f")
    return None if "\x00" in t or control > 0.01 * max(1, len(t)) else t


@F.pandas_udf(T.StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(decode)


def decode_text(content: Column) -> Column:
    """UTF-8 stays in the JVM; other bytes go through detection."""
    plain = F.is_valid_utf8(content.cast("string")) & ~F.hex(F.substring(content, 1, 3)).isin("EFBBBF") & (F.instr(content.cast("string"), "\x00") == 0)
    return F.when(plain, content.cast("string")).otherwise(_decode(content))


def ooxml_text(raw: bytes) -> tuple[str, bool]:
    """Text of a DOCX, PPTX or XLSX part by part, and whether it holds pictures."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        parts = [n for n in names if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml|xl/sharedStrings\.xml", n)]
        text = []
        for n in sorted(parts, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            xml = re.sub(r"</(?:w:p|a:p|si)>", "\n", z.read(n).decode("utf-8", "replace"))
            text.append(re.sub(r"<[^>]+>", "", xml).strip())
        return "\n\n".join(text), any("/media/" in n for n in names)


def read_ooxml(files: DataFrame) -> DataFrame:
    def run(parts):
        for pdf in parts:
            rows = [(p, *ooxml_text(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "has_pictures"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, has_pictures boolean")


#: RTF groups that hold no text of the document.
_RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "object", "themedata", "xmlnstbl", "listtable", "generator"}
_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
_RTF_SIGNS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(raw: bytes) -> str:
    """Text of an RTF file: control words become line ends and signs, destinations without text of their own are left out."""
    codec, silent, skip, width = "cp1252", [False], 0, [1]
    out: list[str] = []
    pending = bytearray()

    def flush() -> None:
        if pending:
            out.append(pending.decode(codec, "replace"))
            pending.clear()

    for word, number, byte, sign, brace, text in _RTF.findall(raw.decode("latin-1")):
        if byte:
            if skip:
                skip -= 1
            elif not silent[-1]:
                pending.append(int(byte, 16))
            continue
        flush()
        if brace == "{":
            silent.append(silent[-1])
            width.append(width[-1])
        elif brace == "}":
            if len(silent) > 1:
                silent.pop()
                width.pop()
            skip = 0
        elif word in _RTF_SILENT or sign == "*":
            silent[-1] = True
        elif word == "ansicpg":
            try:
                codec = f"cp{int(number)}"
                b"".decode(codec)
            except (LookupError, ValueError):
                codec = "cp1252"
        elif word == "uc":
            width[-1] = int(number or 1)
        elif word == "u" and number:
            if not silent[-1]:
                out.append(chr(int(number) % 65536))
            skip = width[-1]
        elif word:
            out.append("" if silent[-1] else _RTF_SIGNS.get(word, ""))
        elif sign:
            out.append("" if silent[-1] else {"~": "\u00a0", "_": "-", "-": ""}.get(sign, sign))
        elif text:
            text, skip = text[skip:], max(0, skip - len(text))
            out.append("" if silent[-1] else text)
    flush()
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs of \\u become one character
    return re.sub(r"\n{3,}", "\n\n", joined).strip()


def xlsx_tables(raw: bytes, most_rows: int = 2000, most_columns: int = 50) -> list[tuple[str, str]]:
    """(sheet, Markdown table) of the sheets that have cells.  Rows and columns beyond the limits are counted in a last line, not lost unsaid."""
    from xml.etree import ElementTree

    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in e.iter() if local(t) == "t"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
            target = next((links.get(v) for k, v in sheet.attrib.items() if k.endswith("}id")), None) or ""
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names:
                continue
            rows, n_rows, width = [], 0, 0
            for row in (e for e in ElementTree.fromstring(z.read(part)).iter() if local(e) == "row"):
                cells = {}
                for i, c in enumerate(e for e in row if local(e) == "c"):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters.group()))) - 1 if letters else i
                    value = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                    kind = c.get("t")
                    if kind == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    cells[at] = value
                if any(v.strip() for v in cells.values()):
                    n_rows += 1
                    width = max(width, max(cells) + 1)
                    if len(rows) < most_rows:
                        rows.append(cells)
            if rows:
                shown = min(width, most_columns)
                clean = lambda v: re.sub(r"\s+", " ", v).strip().replace("|", "\\|")
                lines = ["| " + " | ".join(clean(r.get(i, "")) for i in range(shown)) + " |" for r in rows]
                lines.insert(1, "|" + " --- |" * shown)
                if n_rows > len(rows) or width > shown:
                    lines.append(f"({n_rows} rows and {width} columns in all)")
                out.append((sheet.get("name") or "", "\n".join(lines)))
        return out


def read_tables(files: DataFrame, most_rows: int = 2000, most_columns: int = 50) -> DataFrame:
    """(path, sheet_no, sheet, text) of XLSX files."""

    def run(parts):
        for pdf in parts:
            rows = [(p, i, n, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, (n, t) in enumerate(xlsx_tables(c, most_rows, most_columns))]
            yield pd.DataFrame(rows, columns=["path", "sheet_no", "sheet", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet_no int, sheet string, text string")


@F.pandas_udf(T.StringType())
def _rtf(s: pd.Series) -> pd.Series:
    return s.map(lambda raw: None if raw is None else rtf_text(raw))


def read_rtf(files: DataFrame) -> DataFrame:
    return files.select("path", _rtf("content").alias("text"))


def read_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An exchange package: JSON Lines of chunks, entities, events and their relations."""
    schemas = {
        "chunks": "id string, source_id string, ordinal int, heading string, content string",
        "entities": "id string, source_id string, name string, type string",
        "events": "id string, chunk_id string, parent_id string, title string, content string, category string, start_time timestamp, created_time timestamp",
        "event_entities": "event_id string, entity_id string, weight double, description string",
    }
    return {name: spark.read.schema(s).json(f"{path}/{name}.jsonl") for name, s in schemas.items()}
