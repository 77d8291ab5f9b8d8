"""Web pages as documents: title, text without tags, Markdown with a source line, file name from the address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = ("script", "style", "nav", "header", "footer")


def title(html: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.nullif(t, F.lit(""))


def strip_tags(html: Column) -> Column:
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]+>", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def file_name(url: Column) -> Column:
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    slug = F.when(path != "", F.replace(path, F.lit("/"), F.lit("-"))).when(host != "", host).otherwise("page")
    slug = F.regexp_replace(F.substring(F.regexp_replace(slug, "[^A-Za-z0-9._-]", "-"), 1, 60), "^-+|-+$", "")
    return F.concat(F.when(host != "", F.concat(host, F.lit("-"))).otherwise(""), F.when(slug == "", "page").otherwise(slug), F.lit(".md"))


def parse_urls(raw: str | list[str]) -> list[str]:
    items = raw if isinstance(raw, list) else raw.replace("\n", ",").split(",")
    return [u.strip() for u in items if u.strip()]


def page_text(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    d = pages.select(id_col, F.col(url).alias("url"), title(F.col(html)).alias("title"), strip_tags(F.col(html)).alias("body"))
    md = F.concat(F.lit("# "), F.coalesce("title", "url"), F.lit("\n\n> Nguồn: "), F.col("url"), F.lit("\n\n"), F.col("body"))
    return d.withColumn("markdown", md).withColumn("file_name", file_name(F.col("url")))
