"""Registered queries over text scalars, hashes, the sparse index and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import retrieval as V

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query("normalize_text", r"SELECT doc_id, md5(trim(replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10))) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.normalize(F.col("text"))).alias("digest"))


@query("token_estimate", r"SELECT doc_id, CASE WHEN coalesce(text,'')='' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '\S+'))) END AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("lexical_norm", r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.lexical(F.col("text"))).alias("digest"))


@query("spaced_norm", r"SELECT doc_id, md5(CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, ' ') || ' ' END) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.md5(X.spaced(F.col("text"))).alias("digest"))


_ROOT = r"""
CASE WHEN NOT regexp_matches(w, '^[A-Za-z]{5,}$') THEN w ELSE (
  CASE WHEN length(c3) >= 4 THEN c3 ELSE w END) END"""


@query("ascii_stem", rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents),
p AS (SELECT w, CASE WHEN regexp_matches(w, '^.{{3,}}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN regexp_replace(w, 's$', '') ELSE w END AS c1 FROM w),
e AS (SELECT w, CASE WHEN regexp_matches(c1, 'eed$') THEN c1 WHEN regexp_matches(c1, '^.{{4,}}ations$') THEN regexp_replace(c1, 'ations$', '') WHEN regexp_matches(c1, '^.{{4,}}ation$') THEN regexp_replace(c1, 'ation$', '')
  WHEN regexp_matches(c1, '^.{{4,}}ingly$') THEN regexp_replace(c1, 'ingly$', '') WHEN regexp_matches(c1, '^.{{4,}}edly$') THEN regexp_replace(c1, 'edly$', '') WHEN regexp_matches(c1, '^.{{4,}}ing$') THEN regexp_replace(c1, 'ing$', '')
  WHEN regexp_matches(c1, '^.{{4,}}ed$') THEN regexp_replace(c1, 'ed$', '') ELSE c1 END AS c2 FROM p),
f AS (SELECT w, CASE WHEN regexp_matches(c2, '^.{{4,}}e$') AND NOT regexp_matches(c2, '(ee|le)$') THEN regexp_replace(c2, 'e$', '') ELSE c2 END AS c3 FROM e)
SELECT w AS word, {_ROOT} AS root FROM f""")
def _(t):
    w = t.documents.select(F.explode(X.lexical_tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", X.ascii_root(F.col("word")).alias("root"))


@query("md5_buckets", r"SELECT DISTINCT w AS word, (('0x' || substr(md5(w), 1, 8))::UBIGINT % 1000000)::BIGINT AS bucket FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)")
def _(t):
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))).alias("word")).distinct()
    return w.select("word", X.md5_bucket(F.col("word")).alias("bucket"))


@query("sha_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("digest"))


@query("minhash_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(X.minhash_tokens(F.col("text"))).alias("n"))


@query("diff_tokens", r"SELECT s, array_to_string(e, '|') AS tokens FROM (VALUES ('Pay 1,000 now', ['pay','1000','now']), ('I can''t and won''t', ['i','can','not','and','will','not']), ('It isn''t v2.1', ['it','is','not','v2.1'])) t(s, e)")
def _(t):
    rows = t.spark.createDataFrame([("Pay 1,000 now",), ("I can't and won't",), ("It isn't v2.1",)], "s string")
    return rows.select("s", F.array_join(X.diff_tokens(F.col("s")), "|").alias("tokens"))


@query("index_tokens", r"SELECT s, e AS tokens FROM (VALUES ('R&D spent 1,577 in FY2018', 'rd|spent|1577|in|fy2018'), ('東京都 tower', '東京|京都|tower'), ('a_b c', 'a_b|c')) t(s, e)")
def _(t):
    rows = t.spark.createDataFrame([("R&D spent 1,577 in FY2018",), ("東京都 tower",), ("a_b c",)], "s string")
    return rows.select("s", F.array_join(X.index_tokens(F.col("s")), "|").alias("tokens"))


@query("knowledge_terms", r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2 OR regexp_matches(w, '^\p{N}+$'))) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(X.knowledge_terms(F.col("text"))).alias("n"))


_STOP = "[" + ", ".join("'" + w + "'" for w in X.STOPWORDS) + "]"


@query("stopword_filter", rf"""
SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: (length(w) >= 2 OR regexp_matches(w, '^\d+$')) AND NOT list_contains({_STOP}, w)))) AS n_terms FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.size(X.content_terms(F.col("text"))).alias("n_terms"))


@query("regex_anchors", r"""
SELECT doc_id, len(regexp_extract_all(text, '(?:https?|[a-z][a-z0-9+.-]*)://[^\s<>\])]*[^\s<>\]).,;:!?]')) AS uris, len(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}')) AS emails,
len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS ips FROM documents""")
def _(t):
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return t.documents.select(
        "doc_id", n(r"(?:https?|[a-z][a-z0-9+.-]*)://[^\s<>\])]*[^\s<>\]).,;:!?]").alias("uris"),
        n(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}").alias("emails"), n(r"\b(?:\d{1,3}\.){3}\d{1,3}\b").alias("ips"))


@query("entity_anchors")
def _(t):
    from ..operators.anchors import anchors

    return anchors(t.documents, "doc_id", "text")


@query("alias_matches", r"""
WITH a AS (SELECT * FROM (VALUES ('idiot', 'insult'), ('apache license', 'licence'), ('und', 'german and')) a(label, entity))
SELECT doc_id, entity FROM documents, a WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || label || '($|[^\p{L}\p{N}_])')""")
def _(t):
    a = t.spark.createDataFrame([("idiot", "insult"), ("apache license", "licence"), ("und", "german and")], "label string, entity string")
    edge = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), F.col("label"), F.lit(r"($|[^\p{L}\p{N}_])"))
    return t.documents.crossJoin(F.broadcast(a)).where(F.regexp_like(F.lower("text"), edge)).select("doc_id", "entity")


@query("artifact_codes", r"SELECT page_id, len(regexp_extract_all(html, '\b[A-Z]{2,12}-\d+\b')) AS codes, regexp_extract(url, '([^/]+)/?$', 1) AS slug FROM pages")
def _(t):
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"\b[A-Z]{2,12}-\d+\b"), F.lit(0))).alias("codes"), F.regexp_extract("url", "([^/]+)/?$", 1).alias("slug"))


@query("date_bridge", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS dmy FROM orders")
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", iso.alias("iso"), F.regexp_replace(iso, r"(\d{4})-(\d{2})-(\d{2})", "$3/$2/$1").alias("dmy"))


@query("boilerplate", r"SELECT s, b FROM (VALUES ('Page 3 of 10', true), ('- 12 -', true), ('3 / 9', true), ('Trang 4', true), ('page three', false)) t(s, b)")
def _(t):
    rows = t.spark.createDataFrame([(s,) for s in ("Page 3 of 10", "- 12 -", "3 / 9", "Trang 4", "page three")], "s string")
    return rows.select("s", X.is_page_number(F.col("s")).alias("b"))


@query("contextualize", "SELECT doc_id, md5(CASE WHEN starts_with(text, source) THEN text ELSE source || chr(10) || chr(10) || text END) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.contextualize(F.col("source"), F.col("text"))).alias("digest"))


@query("citation_brackets", r"SELECT doc_id, md5(regexp_replace(text, '【\s*(\d+)\s*】', '[\1]', 'g')) AS digest, regexp_matches(lower(text), 'không tìm thấy|not enough information|no relevant') AS abstains FROM documents")
def _(t):
    d = F.regexp_replace("text", r"【\s*(\d+)\s*】", "[$1]")
    return t.documents.select("doc_id", F.md5(d).alias("digest"), F.lower("text").rlike("không tìm thấy|not enough information|no relevant").alias("abstains"))


@query("url_normalize", r"SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || regexp_replace(substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1), '/+$', '') AS url FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)")
def _(t):
    return t.pages.select("page_id", X.normalize_url(F.col("url")).alias("url"))


@query("cue_detection", r"""
SELECT conv_id, turn, regexp_matches(lower(text), '\b(before|after|since|latest|current)\b') AS temporal, regexp_matches(lower(text), '\b(between|relation|related|depends)\b') AS relational, regexp_matches(lower(text), '\b(all|overall|summary)\b') AS global_cue FROM conversations""")
def _(t):
    has = lambda p: F.lower("text").rlike(rf"\b({p})\b")
    return t.conversations.select("conv_id", "turn", has("before|after|since|latest|current").alias("temporal"), has("between|relation|related|depends").alias("relational"), has("all|overall|summary").alias("global_cue"))


_SP = r"' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' '"


@query("term_match", rf"SELECT doc_id, contains(s, ' license ') OR contains(s, ' licenses ') OR len(list_filter(string_split(trim(s), ' '), lambda w: w IN ('license','licens','licensed','licensing','licenses'))) > 0 AS hit, contains(replace(s, ' ', ''), '20') AS digits FROM (SELECT doc_id, {_SP} AS s FROM documents)")
def _(t):
    s = X.spaced(F.col("text"))
    return t.documents.select("doc_id", X.term_matches(F.lit("license"), s).alias("hit"), X.term_matches(F.lit("20"), s).alias("digits"))


@query("term_proximity", rf"""
SELECT doc_id, CASE WHEN contains(s, ' of the ') OR contains(s, ' the of ') THEN 1.0 WHEN instr(s, ' of ') > 0 AND instr(s, ' the ') > 0 AND abs(instr(s, ' of ') - instr(s, ' the ')) <= 56 THEN 0.65 ELSE 0.0 END::DOUBLE AS score FROM (SELECT doc_id, {_SP} AS s FROM documents)""")
def _(t):
    return t.documents.select("doc_id", X.proximity(F.lit("of"), F.lit("the"), X.spaced(F.col("text"))).alias("score"))


@query("grep_snippet", r"""
WITH p AS (SELECT doc_id, text, string_split(lower(text), 'license') AS parts FROM documents WHERE contains(lower(text), 'license')),
o AS (SELECT doc_id, text, unnest(list_transform(range(1, len(parts)), lambda i: len(array_to_string(parts[:i], 'license')) + 1)) AS pos FROM p),
w AS (SELECT *, substr(text, greatest(1, pos - 40), pos + 700 - greatest(1, pos - 40)) AS win FROM o),
q AS (SELECT *, length(regexp_replace(win, '[^\x{3400}-\x{9fff}]', '', 'g')) - 40 * (length(win) - length(replace(win, 'http', ''))) / 4 - 15 * (length(win) - length(replace(win, '](', ''))) / 2 AS quality FROM w),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, pos) = 1),
x AS (SELECT *, greatest(1, pos - 500) AS lo, substr(text, greatest(1, pos - 500), pos - greatest(1, pos - 500)) AS before FROM b),
s AS (SELECT *, CASE WHEN regexp_matches(before, '20\d{2}(?:年\d{1,2}月\d{1,2}日|[-/]\d{1,2}[-/]\d{1,2})') THEN lo + length(regexp_extract(before, '(?s)^(.*)20\d{2}(?:年\d{1,2}月\d{1,2}日|[-/]\d{1,2}[-/]\d{1,2})', 1)) ELSE greatest(1, pos - 80) END AS start FROM x)
SELECT doc_id, pos::INT AS pos, md5(trim(regexp_replace(regexp_replace(regexp_replace(substr(text, start, pos + 700 - start), '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[ \t]+', ' ', 'g'))) AS snippet FROM s""")
def _(t):
    from ..operators.search import snippet

    pos, part = snippet(F.col("text"), "license")
    return t.documents.where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", pos.alias("pos"), F.md5(part).alias("snippet"))


_POST = rf"""
d AS (SELECT doc_id, {_TOK} AS w FROM documents), dl AS (SELECT doc_id, len(w) AS n FROM d),
p AS (SELECT doc_id, unnest(w) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY 1, 2)"""


@query("corpus_df_idf", f"WITH {_POST} SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf GROUP BY 1")
def _(t):
    return V.document_frequencies(V.postings(t.documents, "doc_id", "text"), t.documents.count()).select("term", "df", F.round("idf", 6).alias("idf"))


_BM25 = f"""
WITH {_POST}, s AS (SELECT count(*) AS n, avg(n) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_TOK}) AS term FROM benchmark),
sc AS (SELECT q.item_id, tf.doc_id, round(sum(ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.n / s.avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), s GROUP BY 1, 2)
SELECT item_id, doc_id, score, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM sc) WHERE rn <= 10"""


@query("bm25_topk", _BM25)
def bm25_topk(t):
    """Flagship: every benchmark item as a query against all documents, ten best each."""
    return V.bm25_search(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 10)


@query("sparse_vector_weights", rf"""
WITH {_POST}, x AS (SELECT tf.doc_id, (('0x' || substr(md5(term), 1, 8))::UBIGINT % 1000000)::BIGINT AS bucket, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.n / 256.0)), 4) AS w FROM tf JOIN dl USING (doc_id) WHERE NOT regexp_matches(term, '[a-z].*[0-9]|[0-9].*[a-z]'))
SELECT doc_id, bucket, max(w) AS weight FROM x GROUP BY 1, 2""")
def _(t):
    return V.sparse_rows(t.documents, "doc_id", "text", "[a-z].*[0-9]|[0-9].*[a-z]")


@query("query_weights", "SELECT token, weight FROM (VALUES ('report', 1.0::DOUBLE), ('alpha', 1.2426), ('2018', 1.0)) t(token, weight)")
def _(t):
    rows = V.query_weights("Alpha alpha report 2018")
    return t.spark.createDataFrame(rows, "token string, weight double")


@query("hash_embedding")
def _(t):
    from ..functions.embedding import ngram_vector

    return t.conversations.select("conv_id", "turn", ngram_vector(F.col("text")).alias("v")).select("conv_id", "turn", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


@query("html_strip_title", r"""
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title,
md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '(?is)<header[^>]*>.*?</header>', ' ', 'g'), '(?is)<footer[^>]*>.*?</footer>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\s+', '', 'g')) AS letters FROM pages""")
def _(t):
    from ..sources.web import page_text

    d = page_text(t.pages, "page_id", "url", "html")
    return d.select("page_id", "title", F.md5(F.regexp_replace("body", r"\s+", "")).alias("letters"))


@query("upload_route", r"""
SELECT s, r FROM (VALUES ('a.pdf','remote'), ('b.DOCX','inspect'), ('c.csv','table'), ('d.md','text'), ('e.exe','rejected')) t(s, r)""")
def _(t):
    from ..sources.files import route

    rows = t.spark.createDataFrame([(s,) for s in ("a.pdf", "b.DOCX", "c.csv", "d.md", "e.exe")], "s string")
    return rows.select("s", route(F.col("s")).alias("r"))


@query("markdown_blocks")
def _(t):
    from ..operators.chunking import blocks

    return blocks(t.documents, "doc_id", "text").select("doc_id", "ordinal", "block_type", "section_path", F.length("text").alias("n_chars"))


@query("search_units")
def _(t):
    from ..operators.cohesion import search_units

    return search_units(t.documents, "doc_id", "text").select("doc_id", "unit", "block_from", "block_to", "section_path", "tokens", "is_part", F.md5("text").alias("text_md5"))


@query("greedy_units")
def _(t):
    from ..operators.chunking import blocks, units

    return units(blocks(t.documents, "doc_id", "text"), "doc_id", 200).select("doc_id", "unit_no", "block_from", "block_to", "tokens")


@query("prose_segments")
def _(t):
    from ..operators.cohesion import prose_segments

    return prose_segments(t.documents, "doc_id", "text").select("doc_id", "segment", "tokens", F.md5("text").alias("text_md5"))


@query("sentence_spans", r"""
WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])($|[^0-9.!?])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS s FROM documents)
SELECT d.doc_id, count(trim(s)) FILTER (trim(s, ' ' || chr(9) || chr(13)) <> '') AS n_sentences, coalesce(max(length(trim(s, ' ' || chr(9) || chr(13)))), 0) AS longest FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id""")
def _(t):
    from ..operators.chunking import sentences

    s = sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))
