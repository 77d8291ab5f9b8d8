"""Tabular files as Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_rows(columns: list[str]) -> Column:
    """'| a | b |' with bars escaped and line ends as spaces; nulls are empty."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV with a header, every column as text: no inference pass over the data."""
    return spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").option("escape", '"').csv(path)


def table_header(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
