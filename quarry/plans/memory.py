"""Registered queries over conversations: episodes, windows, decisions, views, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import fixed
from ..functions import text as X
from ..operators import memory as M
from ..operators import retrieval as S


def _turns(t):
    """The table has no times: a turn takes ten minutes, and 40 more before every fourth."""
    sec = (F.col("turn") * 600 + F.floor(F.col("turn") / 4) * 2400).cast("double")
    return t.conversations.where("conv_id IS NOT NULL").withColumn("sec", sec)


def _re(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


_CLAUSES = f"""
c AS (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(x, {_re(fixed.CLAUSE)}))) AS c FROM m),
e AS (SELECT *, regexp_extract_all(c, {_re("(?s)(.*?)(" + fixed.CONFIRMED + ")")}, 0) AS ends, regexp_extract_all(c, {_re("(?s)(.*?)(" + fixed.CONFIRMED + ")")}, 1) AS leads FROM c),
k AS (SELECT conv_id, turn, bool_or(len(list_filter(range(len(ends)), lambda i: NOT regexp_matches(right(array_to_string(ends[:i], '') || leads[i + 1], {fixed.GUARD_BEFORE_CHARS}), {_re(fixed.GUARD_BEFORE)})
  AND NOT regexp_matches(substr(c, len(array_to_string(ends[:i + 1], '')) + 1, {fixed.GUARD_AFTER_CHARS}), {_re(fixed.GUARD_AFTER)}))) > 0) AS yes FROM e GROUP BY 1, 2)"""


@query("epistemic_classify", f"""
WITH m AS (SELECT conv_id, turn, min(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS x FROM conversations GROUP BY 1, 2), {_CLAUSES}
SELECT conv_id, turn, CASE WHEN regexp_matches(x, {_re(fixed.QUESTION)}) THEN 'FACT' WHEN yes THEN 'CONFIRMED' WHEN regexp_matches(x, {_re(fixed.NEGATED)}) THEN 'NEGATED'
WHEN regexp_matches(x, {_re(fixed.CONSIDERING)}) THEN 'CONSIDERING' WHEN regexp_matches(x, {_re(fixed.PROPOSED)}) THEN 'PROPOSED' WHEN regexp_matches(x, {_re(fixed.OPEN_ISSUE)}) THEN 'OPEN_ISSUE' ELSE 'FACT' END AS state,
len(regexp_extract_all(x, '\\S+')) <= 9 OR regexp_matches(x, {_re(fixed.ANAPHORIC)}) AS anaphoric FROM m LEFT JOIN k USING (conv_id, turn)""")
def _(t):
    return t.conversations.select("conv_id", "turn", M.epistemic_state(F.col("text")).alias("state"), M.is_anaphoric(F.col("text")).alias("anaphoric"))


@query("topic_slots", f"""
SELECT conv_id, turn, CASE {" ".join(f"WHEN regexp_matches(text, {_re(pattern)}) THEN '{name}'" for name, pattern in fixed.SLOTS)} END AS slot FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", M.topic_slot(F.col("text")).alias("slot"))


@query("ledger_supersede", """
WITH d AS (SELECT user_id AS thread, ts, event_type AS slot, event_id, CASE WHEN event_id % 7 = 0 THEN 'NEGATED' WHEN event_id % 3 = 0 THEN 'PROPOSED' ELSE 'CONFIRMED' END AS status FROM events)
SELECT thread, slot, event_id AS valid_from, lead(event_id) OVER w AS valid_to, status, lead(event_id) OVER w IS NULL AND status <> 'NEGATED' AS active, lag(event_id) OVER w AS supersedes FROM d WINDOW w AS (PARTITION BY thread, slot ORDER BY event_id)""")
def _(t):
    status = F.when(F.col("event_id") % 7 == 0, "NEGATED").when(F.col("event_id") % 3 == 0, "PROPOSED").otherwise("CONFIRMED")
    d = t.events.select(F.col("user_id").alias("thread"), F.col("event_type").alias("slot"), "event_id", status.alias("status"))
    return M.ledger(d, "thread", "event_id", "slot", "status")


@query("episode_split")
def _(t):
    return M.episodes(_turns(t), "conv_id", "sec", "turn", "text", "sec")


@query("sliding_window_3", """
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS 2 PRECEDING) AS window_turns, round(avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS 2 PRECEDING), 6) AS mean_chars FROM conversations""")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    s = M.sliding_terms(t.conversations.withColumn("terms", X.content_terms(F.col("text"))), "conv_id", "turn", "terms")
    n = t.conversations.select("conv_id", "turn", F.round(F.avg(F.length("text")).over(w), 6).alias("mean_chars"))
    return s.select("conv_id", "turn", "window_turns").join(n, ["conv_id", "turn"])


@query("adjacent_similarity", """
SELECT conv_id, turn, length(text) - lag(length(text)) OVER w AS delta, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", (F.length("text") - F.lag(F.length("text")).over(w)).alias("delta"), F.lead("role").over(w).alias("next_role"))


@query("neighbour_closure", r"""
WITH c AS (SELECT conv_id, turn, turn % 3 = 1 AS chosen, len(regexp_extract_all(text, '\S+')) <= 9 AS a FROM conversations)
SELECT conv_id, turn, NOT chosen AND (coalesce(lead(chosen AND a) OVER w, false) OR coalesce(lag(chosen) OVER w, false)) AS closure FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t):
    c = t.conversations.select("conv_id", "turn", (F.col("turn") % 3 == 1).alias("chosen"), M.is_anaphoric(F.col("text")).alias("a"))
    return M.neighbours(c, "conv_id", "turn", "chosen", "a").select("conv_id", "turn", "closure")


_TURN = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_STOP = "[" + ", ".join("'" + w + "'" for w in X.STOPWORDS) + "]"
_OKAPI = f"""
q AS (SELECT conv_id, unnest({_TURN}) AS term FROM conversations WHERE turn = 0), qf AS (SELECT conv_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
d AS (SELECT conv_id, turn, {_TURN} AS w FROM conversations), st AS (SELECT conv_id, greatest(10, count(*)) AS n, greatest(8.0, sum(len(w)) / count(*)) AS avgdl FROM d GROUP BY 1),
p AS (SELECT conv_id, turn, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT conv_id, turn, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
okapi AS (SELECT tf.conv_id, tf.turn, sum(CASE WHEN list_contains({_STOP}, tf.term) THEN 0.1 ELSE ln(1 + (greatest(0, n - df) + 0.5) / (df + 0.5)) END * (1 + 0.25 * (qtf - 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM tf JOIN qf USING (conv_id, term) JOIN df USING (conv_id, term) JOIN st USING (conv_id) GROUP BY 1, 2)"""


def _okapi(t):
    return S.okapi(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text", t.conversations.where("turn = 0").select("conv_id", F.col("text").alias("q")), "q")


@query("okapi_thread", f"WITH {_OKAPI} SELECT conv_id, turn, round(bm25, 5) AS bm25 FROM okapi")
def _(t):
    return _okapi(t).withColumn("bm25", F.round("bm25", 5))


@query("hybrid_view", f"""
WITH {_OKAPI}, a AS (SELECT c.conv_id, c.turn, coalesce(o.bm25, 0) AS lex, length(c.text) * 1.0 AS dense FROM conversations c LEFT JOIN okapi o USING (conv_id, turn)),
m AS (SELECT *, min(lex) OVER w AS l0, max(lex) OVER w AS l1, min(dense) OVER w AS d0, max(dense) OVER w AS d1 FROM a WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, round(0.52 * CASE WHEN d1 - d0 > 1e-12 THEN (dense - d0) / (d1 - d0) WHEN dense > 0 THEN 1 ELSE 0 END + 0.48 * CASE WHEN l1 - l0 > 1e-12 THEN (lex - l0) / (l1 - l0) WHEN lex > 0 THEN 1 ELSE 0 END, 5) AS score FROM m""")
def _(t):
    # the dense side is any score of a turn; here its length, so that SQL can follow
    a = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("dense")).join(_okapi(t), ["conv_id", "turn"], "left").fillna(0.0, ["bm25"])
    both = S.min_max(S.min_max(a, "conv_id", "dense", "d"), "conv_id", "bm25", "l")
    return both.select("conv_id", "turn", F.round(0.52 * F.col("d") + 0.48 * F.col("l"), 5).alias("score"))


@query("hierarchy_view", """
WITH t AS (SELECT conv_id, turn, turn // 4 AS ep, length(text) * 1.0 AS s FROM conversations), w AS (SELECT *, avg(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS 2 PRECEDING) AS win, avg(s) OVER (PARTITION BY conv_id, ep) AS ep_s FROM t)
SELECT conv_id, turn, round(0.25 * ep_s + 0.30 * win + 0.45 * s, 5) AS score FROM w""")
def _(t):
    s = t.conversations.select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("ep"), F.length("text").cast("double").alias("s"))
    win = F.avg("s").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0))
    return s.select("conv_id", "turn", F.round(0.25 * F.avg("s").over(Window.partitionBy("conv_id", "ep")) + 0.30 * win + 0.45 * F.col("s"), 5).alias("score"))


_NAME = "[A-Z][a-z]{5,}"
_ACTS = rf"""
s AS MATERIALIZED (SELECT conv_id, turn, turn * 1000 + i AS sent, s FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[.!?\n]')) AS s, unnest(range(len(string_split_regex(text, '[.!?\n]')))) AS i FROM conversations)),
said AS MATERIALIZED (SELECT DISTINCT conv_id, sent, unnest(regexp_extract_all(s, '{_NAME}')) AS entity FROM s),
qw AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS q FROM conversations WHERE turn = 0),
fits AS MATERIALIZED (SELECT conv_id, sent, CASE WHEN len(q) * len(w) = 0 THEN 0 ELSE round(len(list_intersect(q, w)) / sqrt(len(q) * len(w)), 9) END AS fit FROM (SELECT conv_id, sent, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+')) AS w FROM s) JOIN qw USING (conv_id)),
gate AS (SELECT * FROM said JOIN fits USING (conv_id, sent) WHERE fit >= 0.12 QUALIFY row_number() OVER (PARTITION BY conv_id, entity ORDER BY fit DESC, sent) <= 3),
links AS MATERIALIZED (SELECT g.conv_id, g.entity, m.entity AS other, max(fit) AS fit FROM gate g JOIN said m USING (conv_id, sent) WHERE g.entity <> m.entity GROUP BY 1, 2, 3),
a0 AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '{_NAME}')) AS entity, 1.0::DOUBLE AS act FROM conversations WHERE turn = 0),""" + ",".join(
    f"""
a{n} AS MATERIALIZED (SELECT conv_id, entity, max(act) AS act FROM (SELECT * FROM a{n - 1} UNION ALL SELECT conv_id, other, act * fit * 0.72 FROM a{n - 1} JOIN links USING (conv_id, entity) WHERE act >= 0.08) GROUP BY 1, 2)"""
    for n in (1, 2)
)


def _activation(t):
    """Each conversation's first turn asks; entities are capitalised words; a sentence fits by the words that it shares with the question."""
    c = t.conversations.select("conv_id", "turn", "text")
    s = c.select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]")).alias("i", "s")).withColumn("sent", F.col("turn") * 1000 + F.col("i"))
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    names = lambda x: F.regexp_extract_all(x, F.lit(_NAME), F.lit(0))
    asked = c.where("turn = 0")
    q = asked.select("conv_id", words("text").alias("q"))
    both = s.select("conv_id", "sent", words("s").alias("w")).join(q, "conv_id")
    many = F.size("q") * F.size("w")
    fits = both.select("conv_id", "sent", F.when(many == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("q", "w")) / F.sqrt(many), 9)).alias("fit"))
    seeds = asked.select("conv_id", F.explode(names("text")).alias("entity"), F.lit(1.0).alias("act"))
    mentions = s.select("conv_id", "turn", "sent", F.explode(names("s")).alias("entity"))
    return M.activate(seeds, mentions, fits, "conv_id"), mentions


@query("entity_activation", f"WITH {_ACTS} SELECT conv_id, entity, round(act, 6) AS act FROM a2")
def _(t):
    return _activation(t)[0].select("conv_id", "entity", F.round("act", 6).alias("act"))


_WALK = 20
_GRAPH = f"""
WITH {_ACTS}, h AS (SELECT conv_id, turn, turn // 4 AS ep, 1.0 / (1 + turn) AS score FROM conversations),
cnt AS (SELECT conv_id, turn, entity, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(s, '{_NAME}')) AS entity FROM s) GROUP BY 1, 2, 3),
tie AS (SELECT conv_id, 't' || turn AS src, 'e' || entity AS dst, n / sum(n) OVER (PARTITION BY conv_id, turn) AS w FROM cnt
  UNION ALL SELECT conv_id, 't' || b, 't' || turn, 0.15 FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id, ep ORDER BY turn) AS b FROM h) WHERE turn - b = 1),
bth AS (SELECT * FROM tie UNION ALL SELECT conv_id, dst, src, w FROM tie), o AS (SELECT conv_id, src, sum(w) AS total FROM bth GROUP BY 1, 2),
m AS MATERIALIZED (SELECT conv_id, src, dst, w / total AS p FROM bth JOIN o USING (conv_id, src)),
z0 AS (SELECT conv_id, 'e' || entity AS id, act AS w FROM a2 WHERE (conv_id, entity) IN (SELECT (conv_id, entity) FROM cnt) UNION ALL SELECT conv_id, 't' || turn, 0.30 * score FROM h),
z AS MATERIALIZED (SELECT conv_id, id, sum(w) / (SELECT sum(w) FROM z0) AS s FROM z0 GROUP BY 1, 2), r0 AS (SELECT conv_id, id, s AS r FROM z)""" + "".join(
    f""",
f{n} AS (SELECT m.conv_id, dst AS id, 0.6 * sum(r * p) AS f FROM r{n - 1} r JOIN m ON r.conv_id = m.conv_id AND id = src GROUP BY 1, 2),
r{n} AS MATERIALIZED (SELECT coalesce(f.conv_id, z.conv_id) AS conv_id, coalesce(f.id, z.id) AS id, coalesce(f, 0) + 0.4 * coalesce(s, 0) AS r FROM f{n} f FULL JOIN z ON f.conv_id = z.conv_id AND f.id = z.id)"""
    for n in range(1, _WALK + 1)
) + f""",
x AS (SELECT h.conv_id, turn, coalesce(r, 0) AS r FROM h LEFT JOIN r{_WALK} r ON r.conv_id = h.conv_id AND r.id = 't' || turn), y AS (SELECT *, max(r) OVER w AS hi, min(r) OVER w AS lo FROM x WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, round(CASE WHEN hi <= 0 THEN 0 WHEN (hi - lo) / hi > 1e-12 THEN (r - lo) / (hi - lo) ELSE 1 END, 5) AS score FROM y"""


@query("graph_view", _GRAPH)
def _(t):
    acts, mentions = _activation(t)
    turns = t.conversations.select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("episode"), (1 / (1 + F.col("turn"))).alias("score"))
    counts = mentions.groupBy("conv_id", "turn", "entity").agg(F.count("*").alias("n"))
    return M.graph_view(acts, turns, counts, "conv_id", "turn", _WALK).withColumn("score", F.round("score", 5))


@query("message_episodes", """
WITH d AS (SELECT conv_id AS thread, turn AS message_id, min(turn * 600 + (turn // 4) * 2400) AS seconds FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, seconds - lag(seconds) OVER w > 1800 AS far FROM d WINDOW w AS (PARTITION BY thread ORDER BY seconds, message_id)), r AS (SELECT *, sum(coalesce(far, true)::INT) OVER (PARTITION BY thread ORDER BY seconds, message_id) AS run FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY thread, run ORDER BY seconds, message_id) - 1 AS place FROM r)
SELECT thread, message_id, (dense_rank() OVER (PARTITION BY thread ORDER BY run, place // 12) - 1)::INT AS episode, (place % 12 + 1)::INT AS n_turns FROM k""")
def _(t):
    from ..streaming.sessions import index_messages

    return index_messages(_turns(t).select(F.col("conv_id").alias("thread"), F.col("turn").alias("message_id"), F.timestamp_seconds("sec").alias("at")))


@query("session_edges", r"""
WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS e FROM conversations)
SELECT conv_id, 'MENTION' AS kind, turn::VARCHAR AS src, e AS dst, count(*)::DOUBLE AS weight FROM m GROUP BY ALL
UNION ALL SELECT conv_id, 'ADJACENT', (lag(turn) OVER w)::VARCHAR, turn::VARCHAR, 0.35 FROM conversations WINDOW w AS (PARTITION BY conv_id, turn // 4 ORDER BY turn) QUALIFY lag(turn) OVER w IS NOT NULL""")
def _(t):
    m = t.conversations.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{9,}"), F.lit(0))).alias("entity"))
    return M.session_edges(t.conversations.withColumn("ep", F.floor(F.col("turn") / 4)), m, "conv_id", "turn", "entity", "ep")


@query("context_select")
def _(t):
    terms = X.content_terms(F.col("text"))
    c = t.conversations.select("conv_id", "turn", (1 / (1 + F.col("turn"))).alias("score"), X.token_estimate(F.col("text")).alias("tokens"), terms.alias("terms"))
    return M.select_context(c, "conv_id", 620)


@query("session_audit")
def _(t):
    """Every conversation under 400 tokens; the state of a turn is what it says, and of decisions on one slot the last is active."""
    c = t.conversations.select("conv_id", "turn", "text", M.epistemic_state(F.col("text")).alias("status"), M.topic_slot(F.col("text")).alias("slot"), M.is_anaphoric(F.col("text")).alias("anaphoric"))
    later = F.lead("turn").over(Window.partitionBy("conv_id", "slot").orderBy("turn"))
    c = c.withColumns({"active": F.col("slot").isNull() | later.isNull(), "episode": F.floor(F.col("turn") / 4), "tokens": X.token_estimate(F.col("text")), "score": 1 / (1 + F.col("turn"))})
    return M.audit_pack(c, "conv_id", 400)


@query("view_weights", "SELECT * FROM (VALUES ('hybrid', 0.35), ('graph', 0.20), ('hierarchy', 0.15), ('decision', 0.30)) t(view_name, weight)")
def _(t):
    return t.spark.createDataFrame([(k, round(v, 6)) for k, v in M.view_weights("current", 4).items()], "view_name string, weight double")
