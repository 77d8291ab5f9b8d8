"""The corpus pipeline: each stage takes what the one before it kept, and its decisions take effect.

A stage is (spark, docs, sf_dir) -> DataFrame; run() writes each stage's rows as Parquet in the shared folder and reads
them again for the next.  Rows whose doc_id is null pass the toxicity and decontamination stages on their
text's merits; mixing and encoding treat them as their operators say.  Near-dedup and mixing number the rows first and
decide by that number, so null and repeated ids neither multiply nor hide rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, mixing, near_dedup, tokens, toxicity
from quarry.llm.common import fresh, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh(docs, "toxicity")
    return toxicity.annotate(docs, model, score).where(F.col(score) < 0.5).drop(score)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written so that every later read sees the same, and that column's name."""
    row = fresh(docs, "row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id())), row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id, rows without one last."""
    rows, row = numbered(docs)
    groups = stage(near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")))
    # numbers join one to one and groups meet in a minimum, so a large group is no large task
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    seat = F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("seat")
    seats = stage(groups.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row").select("row", "component_id", seat))
    stays = seats.groupBy("component_id").agg(F.min("seat").alias("seat")).select("seat.row")
    gone = seats.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "decontamination")
    flagged = decontamination.annotate(docs, table(spark, sf_dir, "benchmark"), name)
    return flagged.where(F.col(name)["n_hit"] == 0).drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words: whole copies, and one more for a part of it.

    The part is taken whole, so that texts stay documents; a source overruns its target by less than one document.
    """
    rows, row = numbered(docs)
    copies, copy = fresh(rows, "copies"), fresh(rows, "copy")
    taken = mixing.mix(rows.select("doc_id", "text", "source", F.col(row).alias("_row")), carry=("_row",)).where("taken > 0")
    taken = taken.select(F.col("_row").alias(row), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(copies))
    return rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_and_verify(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_store", encode_tokens),
]
#: The stages' models and the tokenizer are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
