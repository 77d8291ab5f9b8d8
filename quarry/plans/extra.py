"""Registered queries over sibling completion, topic scores, routed batches, cascades, branches and table rendering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import relational as R
from .text import _BM25, bm25_topk


@query("sibling_completion", f"""
WITH h AS ({_BM25}), top AS (SELECT h.item_id, d.source, max(h.score) AS parent FROM h JOIN documents d USING (doc_id) WHERE h.rank <= 2 GROUP BY 1, 2),
s AS (SELECT item_id, d.doc_id, parent, row_number() OVER (PARTITION BY item_id, d.source ORDER BY d.doc_id) - 1 AS i FROM top JOIN documents d USING (source) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.item_id = top.item_id AND h.doc_id = d.doc_id))
SELECT item_id, doc_id, round(parent * greatest(0.55::DOUBLE, 0.72::DOUBLE - 0.03::DOUBLE * i), 3) AS score FROM s WHERE i < 4""")
def _(t):
    h = bm25_topk(t)
    d = t.documents.select("doc_id", "source")
    top = h.where("rank <= 2").join(d, "doc_id").groupBy("item_id", "source").agg(F.max("score").alias("parent"))
    sib = top.join(d, "source").join(h.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
    i = F.row_number().over(Window.partitionBy("item_id", "source").orderBy("doc_id")) - 1
    return sib.withColumn("i", i).where("i < 4").select("item_id", "doc_id", F.round(F.col("parent") * F.greatest(F.lit(0.55), 0.72 - 0.03 * F.col("i")), 3).alias("score"))


@query("topic_score", r"""
SELECT doc_id, CASE WHEN contains(lower(source), 'license') THEN 12.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'apache license') THEN 8.0 ELSE 0.0 END
+ least(4.0, 1 + 0.5 * (len(string_split(lower(text), 'license')) - 1)) * (CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END) AS score FROM documents""")
def _(t):
    low = F.lower("text")
    hits = F.size(F.split(low, "license")) - 1
    s = F.when(F.contains(F.lower("source"), F.lit("license")), 12.0).otherwise(0.0) + F.when(F.contains(low, F.lit("apache license")), 8.0).otherwise(0.0)
    return t.documents.select("doc_id", (s + F.when(hits > 0, F.least(F.lit(4.0), 1 + 0.5 * hits)).otherwise(0.0)).alias("score"))


@query("topic_units_window", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 0.2 + CASE WHEN l_returnflag = 'R' THEN 12 ELSE 0 END AS score FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey) <= 16""")
def _(t):
    s = (F.col("l_quantity") * 0.2 + F.when(F.col("l_returnflag") == "R", 12).otherwise(0)).alias("score")
    d = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", s)
    return R.latest(d, "l_suppkey", [F.desc("score"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 16).withColumn("score", F.round("score", 6))


@query("routed_batch", """
WITH b AS (SELECT event_id, value, 'branch' AS origin FROM events WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 20), g AS (SELECT event_id, value, 'escape' FROM events ORDER BY value DESC, event_id LIMIT 8),
u AS (SELECT * FROM b UNION ALL SELECT * FROM g) SELECT event_id, max(value) AS value, min(origin) AS origin FROM u GROUP BY 1""")
def _(t):
    e = t.events.select("event_id", "value", "event_type")
    best = lambda d, n, o: d.orderBy(F.desc("value"), "event_id").limit(n).select("event_id", "value", F.lit(o).alias("origin"))
    u = best(e.where("event_type = 'click'"), 20, "branch").union(best(e, 8, "escape"))
    return u.groupBy("event_id").agg(F.max("value").alias("value"), F.min("origin").alias("origin"))


@query("delete_cascade", """
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), rel AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone))
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM rel WHERE l_partkey = p_partkey) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""")
def _(t):
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    left = t.lineitem.join(gone, "l_orderkey", "left_anti")
    k = F.col("l_partkey") == F.col("p_partkey")
    return t.part.join(t.lineitem, k, "left_semi").join(left, k, "left_anti").select("p_partkey")


@query("branch_segments", """
WITH RECURSIVE e AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 - (turn % 3 = 2)::INT END AS parent FROM conversations), leaf AS (SELECT conv_id, max(turn) AS turn FROM e GROUP BY 1),
r AS (SELECT e.conv_id, e.turn, e.parent, 0 AS depth FROM e JOIN leaf USING (conv_id, turn) UNION ALL SELECT e.conv_id, e.turn, e.parent, r.depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.parent)
SELECT DISTINCT conv_id, turn, depth FROM r""")
def _(t):
    parent = F.when(F.col("turn") > 0, F.col("turn") - 1 - (F.col("turn") % 3 == 2).cast("int"))
    e = t.conversations.select("conv_id", "turn", parent.alias("parent")).distinct()
    front = e.join(e.groupBy("conv_id").agg(F.max("turn").alias("turn")), ["conv_id", "turn"]).withColumn("depth", F.lit(0))
    # from leaf to root inside a conversation: its parents in order, followed in one fold
    up = F.map_from_entries(F.collect_list(F.struct("turn", "parent")))
    start = F.struct(F.col("leaf").alias("at"), F.array("leaf").alias("path"))
    step = lambda a, _x: F.when(F.element_at("up", a["at"]).isNull(), a).otherwise(F.struct(F.element_at("up", a["at"]).alias("at"), F.concat(a["path"], F.array(F.element_at("up", a["at"]))).alias("path")))
    chain = e.groupBy("conv_id").agg(up.alias("up"), F.max("turn").alias("leaf"))
    path = F.aggregate(F.sequence(F.lit(1), F.size("up")), start, step)["path"]
    return chain.select("conv_id", F.posexplode(path).alias("depth", "turn")).select("conv_id", "turn", "depth")


@query("markdown_table_rows", r"SELECT n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\|') || ' | ' || n_regionkey || ' |' AS row FROM nation")
def _(t):
    from ..sources.tables import markdown_rows

    return t.nation.select("n_nationkey", markdown_rows(["n_nationkey", "n_name", "n_regionkey"]).alias("row"))


@query("metadata_merge", "SELECT event_id, (props->>'$.k')::INT AS k, coalesce(props->>'$.origin', 'api') AS origin FROM events")
def _(t):
    m = F.map_concat(F.create_map(F.lit("origin"), F.lit("api")), F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "origin"))
    return t.events.select("event_id", F.element_at(m, "k").cast("int").alias("k"), F.element_at(m, "origin").alias("origin"))


@query("index_stems", rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents), s AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{4,}}ing$') THEN regexp_replace(word, 'ing$', '') WHEN regexp_matches(word, '^[a-z]{{4,}}ed$') AND NOT regexp_matches(word, 'eed$') THEN regexp_replace(word, 'ed$', '')
WHEN regexp_matches(word, '^[a-z]{{4,}}s$') AND NOT regexp_matches(word, '(ss|us|is)$') THEN regexp_replace(word, 's$', '') END AS stem FROM w) SELECT word, CASE WHEN length(stem) >= 4 THEN stem END AS stem FROM s""")
def _(t):
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))).alias("word")).distinct()
    return w.select("word", X.index_stem(F.col("word")).alias("stem"))
