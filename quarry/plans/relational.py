"""Registered queries over filters, joins, aggregates, windows and paging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import relational as R

D = dt.datetime


@query("filter_ast", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F','O') AND NOT (o_totalprice >= 100000 AND o_totalprice < 300000) AND o_custkey IS NOT NULL")
def _(t):
    ast = {"op": "and", "args": [
        {"op": "in", "field": "o_orderstatus", "values": ["F", "O"]},
        {"op": "not", "args": [{"op": "range", "field": "o_totalprice", "gte": 100000.0, "lt": 300000.0}]},
        {"op": "exists", "field": "o_custkey"},
    ]}
    return t.orders.where(R.filter_ast(ast)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("acl_filter", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src0','src3','src7') AND n_chars > 0")
def _(t):
    return t.documents.where((F.col("lang") == "en") & F.col("source").isin("src0", "src3", "src7") & (F.col("n_chars") > 0)).select("doc_id", "source")


@query("acl_tree_membership", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1,2,3) OR (c_mktsegment = 'BUILDING' AND c_nationkey IN (4,5))")
def _(t):
    primary, secondary = [1, 2, 3], [4, 5]
    nodes = F.when(F.col("c_mktsegment") == "BUILDING", F.array("c_nationkey")).otherwise(F.array().cast("array<int>"))
    inside = F.col("c_nationkey").isin(primary) | F.arrays_overlap(nodes, F.array(*map(F.lit, secondary)))
    return t.customer.where(inside).select("c_custkey", "c_mktsegment")


@query("ready_versions", """
SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_acctbal > 0 AND o.o_orderstatus <> 'P' AND o.o_orderdate <= TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-01' < o.o_orderdate + INTERVAL 365 DAY
  AND c.c_mktsegment IN ('BUILDING','MACHINERY') AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def _(t):
    now = F.lit(D(1996, 1, 1)).cast("timestamp_ntz")
    c = t.customer.where((F.col("c_acctbal") > 0) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")
    o = t.orders.where((F.col("o_orderstatus") != "P") & (F.col("o_orderdate") <= now) & (now < F.col("o_orderdate") + F.expr("INTERVAL 365 DAY")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("typed_predicates", "SELECT doc_id, source, lang FROM documents WHERE contains(source, '1') AND lang IN ('de','fr') AND n_chars BETWEEN 100 AND 2000")
def _(t):
    from .predicates import compile_predicates

    where, unsupported = compile_predicates([("source", "contains", "1"), ("lang", "in", ["de", "fr"]), ("n_chars", "between", (100, 2000))])
    assert not unsupported
    return t.documents.where(where).select("doc_id", "source", "lang")


@query("ilike_grep", r"SELECT doc_id FROM documents WHERE text ILIKE '%the\_%' ESCAPE '\' OR text ILIKE '%100\%%' ESCAPE '\' OR text ILIKE '%license%' ESCAPE '\'")
def _(t):
    from ..functions.text import grep

    return t.documents.where(grep(F.col("text"), "the_") | grep(F.col("text"), "100%") | grep(F.col("text"), "LICENSE")).select("doc_id")


@query("tuple_in", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)")
def _(t):
    return R.tuple_in(t.lineitem, t.lineitem.where("l_quantity = 50"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


_PAGE = "SELECT event_id, ts, value, has_more FROM (SELECT *, count(*) OVER () > 25 AS has_more, row_number() OVER (ORDER BY {o}) AS rn FROM (SELECT event_id, ts, value FROM events WHERE {w} ORDER BY {o} LIMIT 26)) WHERE rn <= 25"


@query("keyset_page_fwd", _PAGE.format(o="ts DESC, event_id ASC", w="ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id > 100)"))
def _(t):
    e = t.events.select("event_id", "ts", "value")
    return R.keyset_page(e, [("ts", "desc"), ("event_id", "asc")], (D(2024, 1, 15), 100), 25)


@query("keyset_page_back", _PAGE.format(o="ts ASC, event_id DESC", w="ts > TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 100)"))
def _(t):
    e = t.events.select("event_id", "ts", "value")
    return R.keyset_page(e, [("ts", "desc"), ("event_id", "asc")], (D(2024, 1, 15), 100), 25, back=True)


@query("selection_scope", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def _(t):
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("visible_documents", """
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'N')
 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
 AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0)""")
def _(t):
    l, o = t.lineitem, t.orders  # noqa: E741
    k = F.col("o_orderkey") == F.col("l_orderkey")
    o = o.join(l.where("l_returnflag = 'N'"), k, "left_semi").join(l.where("l_returnflag = 'R'"), k, "left_anti")
    return o.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("hidden_exclusion", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("traceable_locator", "SELECT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text <> ''")
def _(t):
    return t.conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text <> ''").select("conv_id", "turn")


@query("topic_prefilter", """
SELECT source, count(*) AS hits, 5 * count(*) + max(CASE WHEN contains(lower(source), 'src1') THEN 10 ELSE 0 END) AS score FROM documents
WHERE text ILIKE '%license%' OR text ILIKE '%apache%' OR source ILIKE '%src1%' GROUP BY source""")
def _(t):
    from ..functions.text import grep

    hit = grep(F.col("text"), "license") | grep(F.col("text"), "apache") | grep(F.col("source"), "src1")
    name = F.max(F.when(F.contains(F.lower("source"), F.lit("src1")), 10).otherwise(0))
    return t.documents.where(hit).groupBy("source").agg(F.count("*").alias("hits"), (5 * F.count("*") + name).alias("score"))


@query("join_chain", """
SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("entity_heat_left_join", "SELECT p_partkey, p_name, count(l_orderkey) AS heat FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2")
def _(t):
    rel = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    return R.heat(t.part.select("p_partkey", "p_name"), rel, "p_partkey", "l_orderkey")


@query("event_entity_dedup_max", "SELECT l_orderkey, l_suppkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2")
def _(t):
    return R.dedup_relations(t.lineitem, ["l_orderkey", "l_suppkey"], "l_quantity", "l_returnflag")


@query("self_join_parent", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey AS parent_part FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber - 1")
def _(t):
    a, b = t.lineitem.alias("a"), t.lineitem.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") - 1)
    return a.join(b, on, "left").select("a.l_orderkey", "a.l_linenumber", F.col("b.l_partkey").alias("parent_part"))


@query("block_span_join", """
SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS start_part, arg_max(l_partkey, (l_linenumber, l_partkey)) AS end_part FROM lineitem GROUP BY 1""")
def _(t):
    first, last = [F.min(F.struct("l_linenumber", "l_partkey")).alias("s"), F.max(F.struct("l_linenumber", "l_partkey")).alias("e")]
    return t.lineitem.groupBy("l_orderkey").agg(first, last).select("l_orderkey", F.col("s.l_partkey").alias("start_part"), F.col("e.l_partkey").alias("end_part"))


@query("range_join_between", """
SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN (o_orderkey % 3) + 1 AND (o_orderkey % 3) + 2""")
def _(t):
    u = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3 + 1).alias("lo"), (F.col("o_orderkey") % 3 + 2).alias("hi"))
    return R.range_join(u, t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "lo", "hi", "l_linenumber").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")


@query("interval_overlap_join", """
SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY""")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("f"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("u"))
    return R.overlap_join(o, o, "o_custkey", "f", "u", 30 * 86400).where("left_o_orderkey < right_o_orderkey").select(F.col("left_o_orderkey").alias("a"), F.col("right_o_orderkey").alias("b"))


@query("asof_join", """
WITH probe AS (SELECT l_orderkey, l_linenumber, o_custkey AS k, l_shipdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ver AS (SELECT o_custkey AS k, o_orderdate AS d, max(o_orderkey) AS version FROM orders GROUP BY 1, 2)
SELECT p.l_orderkey, p.l_linenumber, v.version FROM probe p ASOF LEFT JOIN ver v ON p.k = v.k AND p.t >= v.d""")
def _(t):
    probe = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("k"), F.col("l_shipdate").alias("t"))
    ver = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("version"))
    return R.asof_join(probe, ver, "k", "t", "d", ["version"]).select("l_orderkey", "l_linenumber", "version")


@query("asof_version", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-17' GROUP BY 1""")
def _(t):
    cut = F.lit(D(1995, 6, 17)).cast("timestamp_ntz")
    return t.orders.where(F.col("o_orderdate") <= cut).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version"))


@query("semi_join_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("anti_join_orphans", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def _(t):
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("entity_bridge_join", """
WITH cap AS (SELECT greatest(3, least(10, ceil(0.08 * count(DISTINCT l_orderkey)))) AS cap FROM lineitem),
df AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) BETWEEN 2 AND (SELECT cap FROM cap)),
r AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN df USING (l_partkey, l_suppkey))
SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS shared FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2""")
def _(t):
    """Orders stand for versions, offers (a part of a supplier) for entities; the operator's cap leaves out what too many share."""
    rel = t.lineitem.select(F.col("l_orderkey").alias("version"), F.struct("l_partkey", "l_suppkey").alias("entity"))
    return R.bridges(rel, "version", "entity")


@query("locator_hydrate", "SELECT e.event_id, c.c_name, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'click'")
def _(t):
    e = t.events.where("event_type = 'click'").select("event_id", "user_id")
    return e.join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "c_mktsegment")


@query("global_aggregates", "SELECT count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def _(t):
    return t.events.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("group_count", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("cond_sum_windows", """
SELECT event_type, count(*) FILTER (ts::DATE > DATE '2024-01-23' AND ts::DATE <= DATE '2024-01-30') AS current_n,
count(*) FILTER (ts::DATE > DATE '2024-01-16' AND ts::DATE <= DATE '2024-01-23') AS previous_n FROM events GROUP BY 1""")
def _(t):
    from ..operators.temporal import demand_windows

    return demand_windows(t.events, "event_type", "ts", dt.date(2024, 1, 30), 7)


@query("filtered_count", "SELECT user_id, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count(F.when(F.col("value") > 50, 1)).alias("high"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))


@query("time_histogram", """
WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), e AS (SELECT least(floor((epoch_us(ts) - lo) * 12 / (hi - lo)), 11)::INT AS bucket FROM events, b)
SELECT s.bucket, count(e.bucket) AS n_events FROM (SELECT unnest(range(12))::INT AS bucket) s LEFT JOIN e ON e.bucket = s.bucket GROUP BY 1""")
def _(t):
    return R.time_histogram(t.events, "ts", 12)


@query("category_topk", "SELECT coalesce(nullif(event_type, ''), '未分类') AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, category LIMIT 4")
def _(t):
    return R.category_topk(t.events, "event_type", 4)


@query("relation_count", "SELECT count(*) AS relations FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey").distinct().agg(F.count("*").alias("relations"))


@query("entity_counts_asof", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_events FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-01-01' GROUP BY 1")
def _(t):
    return t.lineitem.where(F.col("l_shipdate") <= F.lit(D(1996, 1, 1)).cast("timestamp_ntz")).groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n_events"))


@query("src_rollup_ready", """
SELECT c_nationkey AS source, count(*) AS docs, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS ready, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS ready_value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    ready = F.col("o_orderstatus") == "F"
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("source")).agg(F.count("*").alias("docs"), F.sum(F.when(ready, 1).otherwise(0)).alias("ready"), F.round(F.sum(F.when(ready, F.col("o_totalprice")).otherwise(0.0)), 2).alias("ready_value"))


@query("evidence_tier", "SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS has_tier, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("has_tier"), F.count("*").alias("n"))


@query("cost_ledger_rollup", """
WITH u AS (SELECT l_returnflag AS component, l_linestatus AS model, l_quantity::BIGINT AS prompt, l_linenumber::BIGINT AS completion FROM lineitem),
p AS (SELECT * FROM (VALUES ('O', 0.01, 0.02), ('F', 0.5, 1.5)) p(model, pr, cr))
SELECT component, u.model, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round(sum((prompt * pr + completion * cr) / 1e6), 8) AS cost_usd
FROM u LEFT JOIN p ON u.model = p.model GROUP BY ROLLUP (component, u.model)""")
def _(t):
    usage = t.lineitem.select(F.col("l_returnflag").alias("component"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("prompt"), F.col("l_linenumber").cast("long").alias("completion"))
    prices = t.spark.createDataFrame([("O", 0.01, 0.02), ("F", 0.5, 1.5)], "model string, prompt_rate double, completion_rate double")
    return R.cost_ledger(usage, prices, ["component", "model"], ["prompt", "completion"])


@query("source_hits", """
SELECT user_id, count(DISTINCT event_id) AS hits, round(max(value), 6) AS best, max(ts) AS latest FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY hits DESC, best DESC, latest DESC, user_id LIMIT 20""")
def _(t):
    g = t.events.where("event_type <> 'view'").groupBy("user_id").agg(F.countDistinct("event_id").alias("hits"), F.round(F.max("value"), 6).alias("best"), F.max("ts").alias("latest"))
    return g.orderBy(F.desc("hits"), F.desc("best"), F.desc("latest"), "user_id").limit(20)


@query("feedback_totals", "SELECT count(*) FILTER (l_returnflag = 'N') AS likes, count(*) FILTER (l_returnflag = 'R') AS dislikes FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
def _(t):
    lo, hi = (F.lit(D(y, 1, 1)).cast("timestamp_ntz") for y in (1995, 1996))
    s = t.lineitem.where((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi))
    return s.agg(F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("likes"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("dislikes"))


@query("slice_heat", """
SELECT l_suppkey, s_name, count(*) AS heat FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY heat DESC, s_name, l_suppkey LIMIT 15""")
def _(t):
    c = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("heat"))
    return c.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", "s_name", "heat").orderBy(F.desc("heat"), "s_name", "l_suppkey").limit(15)


@query("percentile_calibrate", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.05), 6).alias("q05"), F.round(F.percentile("value", 0.95), 6).alias("q95"))


@query("latest_attempt_row_number", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def _(t):
    return R.latest(t.orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("topn_per_group", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) rn FROM events) WHERE rn <= 3")
def _(t):
    return R.latest(t.events, "user_id", [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "value")


@query("doc_balanced_roundrobin", """
SELECT source, doc_id, turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS turn FROM documents) ORDER BY turn, source LIMIT 50""")
def _(t):
    return R.round_robin(t.documents.select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 50, ["source"]).select("source", "doc_id", "turn")


@query("count_over_rank", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS group_size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber)::INT AS rank_in_group FROM lineitem")
def _(t):
    return R.counted_rank(t.lineitem, "l_orderkey", [F.desc("l_quantity"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "group_size", "rank_in_group")


@query("one_hop_expand", """
WITH seed AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (1, 2, 3, 32, 64)), p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM seed))
SELECT l_orderkey, count(DISTINCT l_partkey) AS shared FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM p) AND l_orderkey NOT IN (SELECT l_orderkey FROM seed) GROUP BY 1""")
def _(t):
    rel = t.lineitem.select("l_orderkey", "l_partkey")
    return R.one_hop(rel, rel.where(F.col("l_orderkey").isin(1, 2, 3, 32, 64)), "l_partkey", "l_orderkey")


@query("two_hop_codes", """
WITH r AS (SELECT DISTINCT l_orderkey AS d, l_partkey, l_suppkey FROM lineitem), df AS (SELECT l_partkey, l_suppkey FROM r GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 3), q AS (SELECT r.* FROM r JOIN df USING (l_partkey, l_suppkey)),
h1 AS (SELECT DISTINCT a.d AS src, b.d AS mid FROM q a JOIN q b USING (l_partkey, l_suppkey) WHERE a.d <> b.d)
SELECT x.src, y.mid AS dst, round(0.92 * 0.92, 6) AS score FROM h1 x JOIN h1 y ON x.mid = y.src WHERE x.src <> y.mid GROUP BY 1, 2""")
def _(t):
    rel = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.struct("l_partkey", "l_suppkey").alias("code"))
    return R.two_hops(rel, "unit", "code").withColumn("score", F.round("score", 6))


@query("message_page", "SELECT conv_id, turn, role FROM (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 30) ORDER BY conv_id, turn")
def _(t):
    return t.conversations.orderBy(F.desc("conv_id"), F.desc("turn")).limit(30).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("offset_page", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def _(t):
    return t.documents.select("doc_id", "lang").orderBy("doc_id").offset(40).limit(20)


@query("sorted_scan_nulls", "SELECT user_id, last_click FROM (SELECT user_id, max(CASE WHEN event_type = 'click' THEN ts END) AS last_click FROM events GROUP BY 1) ORDER BY last_click DESC NULLS LAST, user_id LIMIT 40")
def _(t):
    g = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_click"))
    return g.orderBy(F.col("last_click").desc_nulls_last(), "user_id").limit(40)


@query("multi_source_topk", """
WITH h AS (SELECT user_id, event_type, value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_type, value * 0.9 FROM events WHERE event_type = 'purchase')
SELECT user_id, round(max(value), 6) AS score FROM h GROUP BY 1 ORDER BY score DESC, user_id LIMIT 25""")
def _(t):
    hits = [t.events.where("event_type = 'click'").select("user_id", F.col("value").alias("score")), t.events.where("event_type = 'purchase'").select("user_id", (F.col("value") * 0.9).alias("score"))]
    return R.best_per_key(hits, ["user_id"], "score").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "user_id").limit(25)


@query("event_channel_merge", """
WITH a AS (SELECT user_id, max(value) / 100 AS s FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(value) / 100 AS s FROM events WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY 1),
m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(coalesce(greatest(0, least(1, a.s)), 0), coalesce(greatest(0, least(1, b.s)) * 0.95, 0)) AS best, a.s IS NOT NULL AND b.s IS NOT NULL AS two FROM a FULL JOIN b ON a.user_id = b.user_id),
t AS (SELECT user_id, CASE WHEN two THEN least(1, best + 0.03) ELSE best END AS score FROM m ORDER BY 2 DESC, 1 LIMIT 60)
SELECT user_id, round(score, 6) AS score FROM t WHERE score >= greatest(0.2, 0.55 * (SELECT max(score) FROM t))""")
def _(t):
    ch = lambda w: t.events.where(w).groupBy("user_id").agg((F.max("value") / 100).alias("score"))
    return R.merge_channels(ch("event_type = 'click'"), ch("event_type = 'view' AND user_id % 2 = 0"), "user_id", 60)


@query("set_ops", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 0) UNION ALL
SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def _(t):
    a, b = t.labels.where("toxic = 1").select("doc_id"), t.labels.where("quality = 0").select("doc_id")
    n = lambda op, d: d.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return n("union", a.union(b).distinct()).union(n("intersect", a.intersect(b))).union(n("except", t.documents.select("doc_id").subtract(t.labels.select("doc_id"))))


@query("json_path", "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT >= 5")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k")).where("k >= 5")


@query("sorted_collect", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("golden_angle_layout", """
SELECT c_nationkey, round(sqrt(rn) * cos(rn * 2.399963229728653), 6) AS x, round(sqrt(rn) * sin(rn * 2.399963229728653), 6) AS y, round(log10(1 + n), 6) AS density
FROM (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS rn FROM customer GROUP BY 1)""")
def _(t):
    from pyspark.sql import Window

    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))  # a row for each cluster to be laid out
    rn = F.row_number().over(Window.orderBy(F.desc("n"), "c_nationkey"))
    a = F.col("rn") * 2.399963229728653
    return g.withColumn("rn", rn).select("c_nationkey", F.round(F.sqrt("rn") * F.cos(a), 6).alias("x"), F.round(F.sqrt("rn") * F.sin(a), 6).alias("y"), F.round(F.log10(1 + F.col("n")), 6).alias("density"))
