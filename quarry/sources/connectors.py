"""Connectors: validate a configuration, discover documents, fetch them; registered by kind."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from .files import read_files
from .web import page_text, parse_urls


class Connector(Protocol):
    def validate(self, config: dict) -> list[str]: ...

    def discover(self, spark: SparkSession, config: dict) -> DataFrame: ...

    def fetch(self, spark: SparkSession, config: dict, wanted: DataFrame) -> DataFrame: ...


_KINDS: dict[str, Callable[[], Connector]] = {}


def register(kind: str):
    def put(cls):
        _KINDS[kind] = cls
        return cls

    return put


def connector(kind: str) -> Connector:
    if kind not in _KINDS:
        raise KeyError(f"no connector {kind!r}; there are {sorted(_KINDS)}")
    return _KINDS[kind]()


@register("files")
class Files:
    """Any folder that Spark reads; external_id is the path."""

    def validate(self, config: dict) -> list[str]:
        return [] if config.get("path") else ["path is missing"]

    def discover(self, spark: SparkSession, config: dict) -> DataFrame:
        return read_files(spark, config["path"], config.get("glob", "*")).selectExpr("path AS external_id", "sha256")

    def fetch(self, spark: SparkSession, config: dict, wanted: DataFrame) -> DataFrame:
        f = read_files(spark, config["path"], config.get("glob", "*")).withColumnRenamed("path", "external_id")
        return f.join(wanted.select("external_id"), "external_id", "left_semi")


@register("web")
class Web:
    """Pages from a table (page_id, url, html) that a crawler filled, limited to the configured addresses."""

    def validate(self, config: dict) -> list[str]:
        return [] if parse_urls(config.get("urls") or config.get("url") or "") else ["urls is missing"]

    def discover(self, spark: SparkSession, config: dict) -> DataFrame:
        urls = parse_urls(config.get("urls") or config.get("url") or "")
        return spark.createDataFrame([(u,) for u in urls], "external_id string")

    def fetch(self, spark: SparkSession, config: dict, wanted: DataFrame) -> DataFrame:
        pages = spark.read.parquet(config["pages"])
        d = page_text(pages, "page_id", "url", "html").withColumnRenamed("url", "external_id")
        return d.join(wanted.select("external_id"), "external_id", "left_semi")


def sync(spark: SparkSession, kind: str, config: dict, known: DataFrame) -> DataFrame:
    """Documents that a source has and the store hasn't, by external_id."""
    c = connector(kind)
    if problems := c.validate(config):
        raise ValueError("; ".join(problems))
    return c.fetch(spark, config, c.discover(spark, config).join(known.select("external_id"), "external_id", "left_anti"))
