"""Registered queries over sinks, streams (as batches) and temporal operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import temporal as T
from ..sources import sinks as S

D = dt.datetime


@query("insert_once", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(t):
    return S.insert_once(t.labels.select("doc_id"), t.documents.where("lang = 'en'"), ["doc_id"])


@query("upload_registration", """
WITH v AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS d, max(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT u.o_orderkey, u.o_custkey, CASE WHEN u.o_orderstatus = v.d THEN v.v ELSE coalesce(v.v, 0) + 1 END AS version_no, coalesce(u.o_orderstatus = v.d, false) AS reused
FROM (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') u LEFT JOIN v ON u.o_custkey = v.o_custkey""")
def _(t):
    cut = F.lit(D(1997, 1, 1)).cast("timestamp_ntz")
    old = t.orders.where(F.col("o_orderdate") < cut).select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("version_no"))
    new = t.orders.where(F.col("o_orderdate") >= cut).select("o_orderkey", "o_custkey", "o_orderstatus")
    return S.register_upload(new, old, "o_custkey", "o_orderstatus").drop("o_orderstatus")


@query("orphan_points", "SELECT doc_id, doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr') AS has_row FROM labels")
def _(t):
    kept, gone = S.split_orphans(t.labels.select("doc_id"), t.documents.where("lang <> 'fr'"), "doc_id")
    return kept.withColumn("has_row", F.lit(True)).union(gone.withColumn("has_row", F.lit(False)))


@query("bitemporal_chain", """
SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, coalesce(lead(o_orderdate) OVER w, TIMESTAMP '9999-12-31 23:59:59') AS valid_to, lag(o_orderkey) OVER w AS supersedes_id, row_number() OVER w AS version_no
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def _(t):
    c = T.version_chain(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderkey")
    return c.select("o_custkey", "o_orderkey", "valid_from", "valid_to", "supersedes_id", "version_no")


@query("day_demand", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("event_time", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'R' THEN l_shipdate END, o_orderdate) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("start", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return j.select("l_orderkey", "l_linenumber", T.event_time("start", "o_orderdate").alias("t"))


@query("sessionize_gap", """
WITH g AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 1800 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, (sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session_no FROM g""")
def _(t):
    return T.sessions(t.events, "user_id", "ts", 1800, "event_id").select("user_id", "event_id", "session_no")


@query("decay_freshness", "SELECT event_type, round(avg(exp(-ln(2) * greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000, 0) / 90)), 6) AS freshness FROM events GROUP BY 1")
def _(t):
    age = (F.unix_micros(F.lit(D(2024, 2, 1)).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    return t.events.groupBy("event_type").agg(F.round(F.avg(T.decay(age)), 6).alias("freshness"))


@query("year_range_match", "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1994 AND 1995 THEN 1.0 WHEN year(o_orderdate) BETWEEN 1993 AND 1996 THEN 0.5 ELSE 0.1 END::DOUBLE AS score FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.year_match(F.year("o_orderdate"), F.lit(1994), F.lit(1995)).alias("score"))


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming.sessions import hourly_counts

    return hourly_counts(t.events)


@query("stream_session_windows", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    from ..streaming.sessions import session_windows

    return session_windows(t.events)
