"""Event time, day windows, bitemporal version chains, decay, sessions by gap."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31 23:59:59"


def event_time(start: str, created: str) -> Column:
    return F.coalesce(F.col(start), F.col(created))


def demand_windows(events: DataFrame, key: str, at: str, as_of: dt.date, days: int) -> DataFrame:
    """Counts of the last ``days`` days up to as_of and of the days before those."""
    day = F.to_date(at)
    end = F.lit(as_of)
    mid, lo = F.date_sub(end, days), F.date_sub(end, 2 * days)
    return events.groupBy(key).agg(F.count(F.when((day > mid) & (day <= end), 1)).alias("current_n"), F.count(F.when((day > lo) & (day <= mid), 1)).alias("previous_n"))


def version_chain(versions: DataFrame, key: str, start: str, arrival: str, id_col: str) -> DataFrame:
    """valid_from, valid_to and supersedes of each version, whatever the order of arrival.

    Of equal starts the later arrival supersedes, which leaves the earlier one an interval of length zero.
    """
    w = Window.partitionBy(key).orderBy(start, arrival)
    end = F.lit(OPEN_END).cast(versions.schema[start].dataType)
    return versions.select(
        "*", F.col(start).alias("valid_from"), F.coalesce(F.lead(start).over(w), end).alias("valid_to"), F.lag(id_col).over(w).alias("supersedes_id"), F.row_number().over(w).alias("version_no")
    )


def decay(age_days: Column, half_life: float = 90.0) -> Column:
    """exp(-ln 2 * age / half-life); a time ahead counts as age 0."""
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0.0)) / half_life)


def sessions(events: DataFrame, key: str, at: str, gap_seconds: float, tie: str) -> DataFrame:
    """session_no per key: a new one after a gap of more than ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(at, tie)
    apart = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6
    return events.withColumn("_new", F.when(apart > gap_seconds, 1).otherwise(0)).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def year_match(query_year: Column, lo: Column, hi: Column) -> Column:
    """1 inside a node's years, 0.5 one year outside, else 0.1."""
    return F.when(query_year.between(lo, hi), 1.0).when(query_year.between(lo - 1, hi + 1), 0.5).otherwise(0.1)
