"""Registered queries over vectors, similarity, fusion, selection, quality and evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..functions import vectors as V
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import retrieval as S
from ..operators import similarity as M
from ..operators.staging import cut
from .text import _BM25

_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("cosine_topk", f"""
WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round((list_cosine_similarity(q.v, e.v) + 1) / 2, 6) AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, score, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rn FROM s) WHERE rn <= 10""")
def _(t):
    return S.vector_topk(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "vec_id", "embedding", 10)


@query("l2_norm", f"SELECT vec_id, round(sqrt(list_sum(list_transform({_UNIT}, lambda x: x * x))), 6) AS n FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("n"))


@query("finite_vectors", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0")
def _(t):
    return t.embeddings.where(V.is_finite(F.col("embedding"), 64)).select("vec_id")


@query("pool_weighted", f"""
WITH e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, sqrt(list_sum(list_transform({_UNIT}, lambda x: x * x))) AS n FROM embeddings),
s AS (SELECT label, i, sum(x / n * sqrt(greatest(1, vec_id % 5))) AS x FROM e GROUP BY 1, 2), z AS (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
SELECT label, i::INT AS i, round(x / n, 5) AS x FROM s JOIN z USING (label)""")
def _(t):
    # position sums instead of gathered vectors: any number of vectors a label
    e = t.embeddings.select("label", F.sqrt(F.greatest(F.lit(1), F.col("vec_id") % 5)).alias("w"), F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "u"))
    s = e.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.sum(F.col("u") * F.col("w")).alias("x"))
    n = s.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return s.join(n, "label").select("label", "i", F.round(F.col("x") / F.col("n"), 5).alias("x"))


_SH = r"""CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END"""


@query("minhash_signature", f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), s AS (SELECT doc_id, unnest({_SH}) AS s FROM d)
SELECT doc_id, min(('0x' || substr(md5('0:' || s), 1, 8))::UBIGINT)::BIGINT AS m0, min(('0x' || substr(md5('1:' || s), 1, 8))::UBIGINT)::BIGINT AS m1, min(('0x' || substr(md5('127:' || s), 1, 8))::UBIGINT)::BIGINT AS m127 FROM s GROUP BY 1""")
def _(t):
    s = M.minhash(t.documents, "doc_id", "text")
    return s.select("doc_id", F.element_at("sig", 1).alias("m0"), F.element_at("sig", 2).alias("m1"), F.element_at("sig", 128).alias("m127"))


@query("lsh_candidates", f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), s AS (SELECT doc_id, unnest({_SH}) AS s FROM d),
m AS (SELECT doc_id, i, min(('0x' || substr(md5(i::VARCHAR || ':' || s), 1, 8))::UBIGINT)::BIGINT AS m FROM s, range(128) r(i) GROUP BY 1, 2),
b AS (SELECT doc_id, i // 4 AS band, string_agg(m::VARCHAR, ',' ORDER BY i) AS k FROM m GROUP BY 1, 2)
SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.k = y.k AND x.doc_id < y.doc_id""")
def _(t):
    return M.band_candidates(cut(M.minhash(t.documents, "doc_id", "text")), "doc_id")


@query("near_dup_pairs")
def _(t):
    return M.near_duplicates(t.documents, "doc_id", "text")


_PLANES = M.planes(64)


@query("simhash_bands", f"""
WITH p AS (SELECT unnest(range(32)) AS p, unnest({_PLANES}) AS w), e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings),
s AS (SELECT vec_id, p, CASE WHEN list_dot_product(v, list_transform(w, lambda x: x::DOUBLE)) >= 0 THEN '1' ELSE '0' END AS bit FROM e, p)
SELECT vec_id, (p // 4)::VARCHAR || ':' || string_agg(bit, '' ORDER BY p) AS band FROM s GROUP BY vec_id, p // 4""")
def _(t):
    return M.simhash_bands(t.embeddings, "vec_id", "embedding", 64)


@query("exact_dedup", "SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS first_id, row_number() OVER (PARTITION BY text ORDER BY doc_id)::INT AS copy_no FROM documents")
def _(t):
    return M.exact_duplicates(t.documents, "doc_id", "text")


@query("relation_classify", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'SUPERSEDES' WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN 'CONTRADICTS' WHEN l_discount >= 0.09 THEN 'SUPPORTS' WHEN l_quantity / 50 >= 0.85 THEN 'EQUIVALENT' ELSE 'RELATED' END AS relation FROM lineitem""")
def _(t):
    rel = M.classify(F.col("l_quantity") / 50, (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.05), F.col("l_returnflag") == "R", F.col("l_discount") >= 0.09)
    return t.lineitem.select("l_orderkey", "l_linenumber", rel.alias("relation"))


@query("semantic_diff")
def _(t):
    """Each turn against the one before it; the alignment is sequential, so tests hold it against facts."""
    c = t.conversations.select("conv_id", "turn", "text")
    pairs = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    return M.semantic_diff(pairs, "before", "text").withColumn("relation", M.relation(F.lit(False))).drop("text", "before")


@query("dup_cluster_components", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1""")
def _(t):
    from ..operators.graph import components

    d = M.exact_duplicates(t.documents, "doc_id", "text").where("copy_no > 1")
    return components(d, "doc_id", "first_id").withColumnRenamed("id", "doc_id")


@query("content_shingle_jaccard", r"""
WITH n AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS n FROM documents),
k AS (SELECT doc_id, n, CASE WHEN length(n) >= 6 THEN 6 ELSE 3 END AS k FROM n),
s AS (SELECT doc_id, CASE WHEN length(n) = 0 THEN [] WHEN length(n) < 3 THEN [n] ELSE list_distinct(list_transform(range(1, greatest(length(n) - k + 2, 2)), lambda i: substr(n, i, k))) END AS s FROM k)
SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS jaccard FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def _(t):
    """Each document against the one of the next id: the pairs are given, never all against all."""
    return S.next_jaccard(t.documents, "doc_id", "text").withColumn("jaccard", F.round("jaccard", 6))


def _hits(t):
    from .text import bm25_topk

    return bm25_topk(t).join(t.documents.select("doc_id", "source", "lang"), "doc_id")


@query("rrf", f"""
WITH h AS ({_BM25}), m AS (SELECT item_id, doc_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank2 FROM h)
SELECT item_id, doc_id, round(1.0 / (60 + rank) + 1.0 / (60 + rank2), 8) AS rrf FROM m""")
def _(t):
    from pyspark.sql import Window

    h = _hits(t).select("item_id", "doc_id", "rank")
    other = h.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")))
    return S.rrf([h, other], ["item_id", "doc_id"]).withColumn("rrf", F.round("rrf", 8))


@query("doc_aware_rank", f"""
WITH h AS ({_BM25}), s AS (SELECT h.item_id, h.doc_id, h.rank - 1 AS r, d.source FROM h JOIN documents d USING (doc_id)), f AS (SELECT *, min(r) OVER (PARTITION BY item_id, source) AS fr FROM s)
SELECT item_id, doc_id, 0.5 * r + 0.5 * ((dense_rank() OVER (PARTITION BY item_id ORDER BY fr) - 1) + 2 * (row_number() OVER (PARTITION BY item_id, source ORDER BY r) - 1)) AS effective_rank FROM f""")
def _(t):
    h = _hits(t).withColumn("rank", F.col("rank") - 1)
    return S.doc_aware_rank(h, "item_id", "source").select("item_id", "doc_id", "effective_rank")


@query("rank_interleave", """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents LIMIT 1000000), x AS (SELECT doc_id, rank, 0 AS l FROM a WHERE rank <= 30 UNION ALL
SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC), 1 FROM documents QUALIFY row_number() OVER (ORDER BY doc_id DESC) <= 30), f AS (SELECT doc_id, min((rank, l)) AS k FROM x GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY k)::INT AS place FROM f""")
def _(t):
    from pyspark.sql import Window

    d = t.documents.select("doc_id", "n_chars")
    top = lambda *o: d.orderBy(*o).limit(30).withColumn("rank", F.row_number().over(Window.orderBy(*o))).select("doc_id", "rank")
    return S.interleave([top(F.desc("n_chars"), F.asc("doc_id")), top(F.desc("doc_id"))], "doc_id")


@query("scope_roundrobin", f"""
WITH h AS ({_BM25}), s AS (SELECT d.lang AS scope, h.doc_id, sum(1.0 / (60 + h.rank)) AS rrf FROM h JOIN documents d USING (doc_id) GROUP BY 1, 2)
SELECT scope, doc_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY round(rrf, 9) DESC, doc_id)::INT AS turn FROM s) ORDER BY turn, scope LIMIT 40""")
def _(t):
    s = _hits(t).groupBy(F.col("lang").alias("scope"), "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("rrf"))
    return R.round_robin(s, "scope", [F.desc("rrf"), F.asc("doc_id")], 40, ["scope"]).select("scope", "doc_id", "turn")


@query("group_by_document", f"""
WITH h AS ({_BM25}), s AS (SELECT h.*, d.source FROM h JOIN documents d USING (doc_id)), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, rank) = 1),
p AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS top, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank, source) AS p FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p)::INT AS place FROM p WHERE p = 1 OR score >= greatest(0.2, 0.5 * top))
SELECT item_id, source, doc_id, place FROM k WHERE place <= 5""")
def _(t):
    return S.group_by_document(_hits(t), "item_id", "source", 5).select("item_id", "source", "doc_id", "place")


@query("min_max_norm", "SELECT event_id, round(CASE WHEN max(value) OVER w - min(value) OVER w > 1e-12 THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) WHEN value > 0 THEN 1 ELSE 0 END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def _(t):
    return S.min_max(t.events, "user_id", "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


_SPT = r"(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ')"


@query("lexical_relevance", rf"""
WITH d AS (SELECT doc_id, {_SPT} AS s, ' ' || source || ' ' AS h FROM documents)
SELECT doc_id, round(least(1, CASE WHEN contains(s, ' of the ') THEN 0.55 ELSE 0 END + CASE WHEN contains(s, ' of the ') AND contains(h, ' of the ') THEN 0.2 ELSE 0 END
+ 0.35 * (contains(s, ' of ')::INT + contains(s, ' the ')::INT + contains(s, ' license ')::INT) / 3 + 0.15 * (contains(h, ' of ')::INT + contains(h, ' the ')::INT + contains(h, ' license ')::INT) / 3), 6) AS score FROM d""")
def _(t):
    h = F.concat(F.lit(" "), F.col("source"), F.lit(" "))
    s = S.lexical_relevance(F.lit(" of the "), F.array(F.lit("of"), F.lit("the"), F.lit("license")), h, X.spaced(F.col("text")))
    return t.documents.select("doc_id", F.round(s, 6).alias("score"))


@query("hybrid_score", f"""
WITH h AS ({_BM25}) SELECT item_id, doc_id, round(0.56 * (61.0 / (60 + rank)) + 0.32 * (score / max(score) OVER w) + 0.12 * (score / max(score) OVER w), 5) AS fused FROM h WINDOW w AS (PARTITION BY item_id)""")
def _(t):
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy("item_id"))
    h = _hits(t).withColumn("top", top)
    return h.select("item_id", "doc_id", F.round(S.fuse(F.col("rank"), F.col("score") / F.col("top"), F.col("score"), F.col("top")), 5).alias("fused"))


@query("mmr_select")
def _(t):
    from pyspark.sql import Window

    h = _hits(t).join(t.documents.select("doc_id", "text"), "doc_id")
    top = F.max("score").over(Window.partitionBy("item_id"))
    c = h.select("item_id", F.col("doc_id").alias("id"), F.col("source").alias("doc"), (F.col("score") / top).alias("score"), "rank", "text")
    return S.mmr(c, "item_id", 5)


@query("budget_pack")
def _(t):
    h = _hits(t).join(t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens")), "doc_id").select("item_id", "doc_id", "rank", "tokens")
    return S.pack(h, "item_id", [F.asc("rank")], "tokens", 2000)


@query("superseded_filter", """
WITH d AS (SELECT doc_id, source, regexp_matches(lower(text), 'superseded|\\[deprecated\\]|\\[obsolete\\]|đã thay thế') AS m FROM documents)
SELECT doc_id FROM d QUALIFY NOT m OR min(m::INT) OVER (PARTITION BY source) = 1""")
def _(t):
    return S.superseded_filter(t.documents.select("doc_id", "source", "text"), "source", "text", F.lit(False)).select("doc_id")


@query("entropy_diversity", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c)
SELECT source, round(CASE WHEN count(*) <= 1 THEN 0 ELSE least(1, greatest(0, -sum(p * ln(p)) / ln(count(*)))) END, 6) AS diversity FROM p GROUP BY 1""")
def _(t):
    return R.normalized_entropy(t.documents.groupBy("source", "lang").count(), "source", "count").withColumn("diversity", F.round("diversity", 6))


@query("quality_score", """
WITH u AS (SELECT d.source AS topic, d.doc_id, d.lang AS src, l.quality IS NOT NULL AND l.quality = 1 AS anchored, 0.8 AS conf, TIMESTAMP '2024-01-01' + INTERVAL (d.doc_id % 90) DAY AS at_ FROM documents d LEFT JOIN labels l USING (doc_id)),
b AS (SELECT topic, count(*) AS n, avg(anchored::INT) AS coverage, avg(exp(-ln(2) * greatest((epoch_us(TIMESTAMP '2024-04-01') - epoch_us(at_)) / 86400000000, 0) / 90)) AS fresh, coalesce(avg(CASE WHEN anchored THEN 1 - conf END), 1) AS unc FROM u GROUP BY 1),
c AS (SELECT topic, src, count(*) AS k FROM u WHERE anchored GROUP BY 1, 2), p AS (SELECT topic, k / sum(k) OVER (PARTITION BY topic) AS p FROM c),
e AS (SELECT topic, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END AS div FROM p GROUP BY 1),
s AS (SELECT b.topic, 0.30 * (1 - coverage) + 0.15 * (1 - coalesce(div, 0)) + 0.15 * (1 - fresh) + 0.15 * unc AS sev, least(1, ln(1 + n / 7) / ln(51)) AS dem, least(1, greatest(0, (n / 7 - 1) / greatest(1, 1)) / 2) AS gro FROM b LEFT JOIN e USING (topic))
SELECT topic, round(sev, 6) AS severity, round(0.8 * dem + 0.2 * gro, 6) AS importance, round(sev * (0.8 * dem + 0.2 * gro), 6) AS priority FROM s""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    at = (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 90).cast("int"))).alias("at")
    u = d.select(F.col("source").alias("topic"), "doc_id", F.col("lang").alias("source"), at, F.coalesce(F.col("quality") == 1, F.lit(False)).alias("anchored"), F.lit(0.8).alias("confidence"))
    demand = d.groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("current_n"), F.lit(7).alias("previous_n"))
    none = t.spark.createDataFrame([], "topic string, pairs long")
    q = Q.topic_quality(u, demand, none, "topic", dt.datetime(2024, 4, 1), 7)
    return q.select("topic", *[F.round(c, 6).alias(c) for c in ("severity", "importance", "priority")])


@query("gap_priority", """
SELECT source, count(*) FILTER (l.quality = 0) AS gaps, round(count(*) FILTER (l.quality = 0) / count(*), 6) AS priority FROM documents JOIN labels l USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (l.quality = 0) > 0 ORDER BY priority DESC, source LIMIT 10""")
def _(t):
    bad = F.count(F.when(F.col("quality") == 0, 1))
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(bad.alias("gaps"), F.round(bad / F.count("*"), 6).alias("priority"))
    return g.where("gaps > 0").orderBy(F.desc("priority"), "source").limit(10)


@query("recall_mrr_ndcg", f"""
WITH h AS ({_BM25}), rel AS (SELECT item_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS rel FROM (SELECT item_id, doc_id, rank FROM h WHERE rank <= 4) UNION SELECT item_id, 100000000 + item_id, 2 FROM benchmark),
j AS (SELECT rel.*, h.rank, row_number() OVER (PARTITION BY rel.item_id ORDER BY rel DESC, rel.doc_id) AS i FROM rel LEFT JOIN h USING (item_id, doc_id))
SELECT item_id, round(avg(coalesce(rank <= 3, false)::INT), 6) AS recall, round(coalesce(max(CASE WHEN rank <= 10 THEN 1.0 / rank END), 0), 6) AS mrr,
round(coalesce(sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) END), 0) / sum(CASE WHEN i <= 10 THEN (2 ** rel - 1) / log2(i + 1) END), 6) AS ndcg FROM j GROUP BY 1""")
def _(t):
    h = _hits(t).select("item_id", "doc_id", "rank")
    rel = h.where("rank <= 4").select("item_id", "doc_id", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("rel"))
    rel = rel.union(t.benchmark.select("item_id", (F.lit(100000000) + F.col("item_id")).alias("doc_id"), F.lit(2).alias("rel")))
    return Q.ranking_metrics(h, rel, "item_id", "doc_id", 3)


@query("ablation_agg", """
SELECT l_returnflag AS variant, round(avg(least(1, l_quantity / 40)), 6) AS mean_recall, count(*) FILTER (least(1, l_quantity / 40) >= 1) AS full_hits, round(avg((l_linestatus = 'F')::INT), 6) AS stale, round(1000 * sum(l_linenumber) / sum(l_quantity), 6) AS density FROM lineitem GROUP BY 1""")
def _(t):
    r = t.lineitem.select(F.col("l_returnflag").alias("variant"), F.least(F.lit(1.0), F.col("l_quantity") / 40).alias("recall"), (F.col("l_linestatus") == "F").alias("stale"), F.col("l_linenumber").alias("hits"), F.col("l_quantity").alias("tokens"))
    return Q.ablation(r, "variant")


@query("strategy_compare", f"""
WITH h AS ({_BM25}) SELECT 'sparse' AS strategy, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM h UNION ALL SELECT 'sparse_top3', count(*), count(DISTINCT doc_id) FROM h WHERE rank <= 3""")
def _(t):
    h = _hits(t)
    one = lambda n, d: d.agg(F.lit(n).alias("strategy"), F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))
    return one("sparse", h).unionByName(one("sparse_top3", h.where("rank <= 3")))
