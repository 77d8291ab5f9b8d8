"""Preference formatting: the turns two conversations share at the start once, as prompt, and two masked completions.

A conversation is its turns in order.  The longest common prefix is found turn by turn with a join on (pair, place)
and a minimum, so no conversation is gathered to find it.  The prompt and each completion are rendered in the
chat template below; a completion carries its loss mask as character spans of the text
prompt + completion: assistant turns' bodies and end marks are learnt, everything else is not.

Pairs may be given.  Without them, only pairs that share a prompt are made, by two named rules:
* forks: conversations with the same first turn, in order of conv_id, two by two; the first is the chosen one;
* swapped replies, for every conversation left over: chosen is the conversation up to its last assistant turn, rejected
  the same with that reply taken from the next such conversation in order of md5(conv_id), the first after the last.
Either kind is left out if no turn is shared or nothing differs (there is then no preference to learn).

Edge cases: a null role is 'user', a null text ''; turns that repeat a number follow in order of role and text; a conversation
that is a prefix of the other has an empty completion; of given pairs, equal conversations have two; turns without a conv_id
are left out; a conversation without an assistant turn after its first has no swapped pair.  A conversation's turns
meet in one row only as its rendered text.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import global_rank, stage, table

#: The chat template's marks.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNT = "assistant"


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): places are gapless from 0, whatever the turn numbers are."""
    t = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return t.select("conv_id", (F.row_number().over(w) - 1).alias("pos"), "role", "text")


def forks(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, chosen_id, rejected_id) and the conv_ids left over.  A hot first turn is no hot task: ranks come from a range shuffle."""
    first = turns.where("pos = 0").select("conv_id", F.md5(F.concat_ws("\x1f", "role", "text")).alias("key"))
    ranked = stage(global_rank(first, ["key", "conv_id"]))
    start = ranked.groupBy("key").agg(F.min("rank").alias("start"))
    # partners have neighbouring ranks: rank 2 i and 2 i + 1 of their first turn meet under one number
    seat = ranked.join(start, "key").withColumn("at", F.col("rank") - F.col("start"))
    seat = seat.withColumn("seat", F.col("rank") - F.col("at") % 2)
    both = stage(seat.groupBy("seat").agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"), F.count("*").alias("n")))
    return both.where("n = 2").select(F.col("chosen_id").alias("pair_id"), "chosen_id", "rejected_id"), both.where("n = 1").select(F.col("chosen_id").alias("conv_id"))


def swapped(turns: DataFrame, alone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, chosen_id, rejected_id), and the turns of both sides: the rejected side ends in another conversation's reply."""
    last = turns.where(F.col("role") == LEARNT).groupBy("conv_id").agg(F.max("pos").alias("last")).where("last > 0").join(alone, "conv_id")
    ranked = stage(global_rank(last.withColumn("_key", F.md5(F.col("conv_id").cast("string"))), ["_key", "conv_id"]))
    n = ranked.count()
    donor = ranked.select(F.col("conv_id").alias("rejected_id"), F.col("last").alias("donor_last"), F.expr(f"(rank + {max(1, n)} - 1) % {max(1, n)}").alias("rank"))
    pairs = stage(ranked.join(donor, "rank").select(F.col("conv_id").alias("pair_id"), "last", "rejected_id", "donor_last"))
    own = turns.join(pairs.select(F.col("pair_id").alias("conv_id"), "last"), "conv_id").where("pos <= last")
    chosen = own.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "pos", "role", "text")
    shared = own.where("pos < last").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "pos", "role", "text")
    reply = turns.join(pairs.select("pair_id", "last", F.col("rejected_id").alias("conv_id"), F.col("donor_last").alias("pos")), ["conv_id", "pos"])
    reply = reply.select("pair_id", F.lit("rejected").alias("side"), F.col("last").alias("pos"), "role", "text")
    return pairs.select("pair_id", F.col("pair_id").alias("chosen_id"), "rejected_id"), chosen.unionByName(shared).unionByName(reply)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _joined(turns: DataFrame, by: list[str]) -> DataFrame:
    """Text of each group's turns in order, and the spans in it that are learnt."""
    t = F.array_sort(F.collect_list(F.struct("pos", rendered(F.col("role"), F.col("text")).alias("s"), F.when(F.col("role") == LEARNT, F.length("role") + len(OPEN) + len(MIDDLE)).alias("skip"))))
    fold = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["s"])).alias("at"),
            F.when(
                x["skip"].isNotNull(), F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), (acc["at"] + F.length(x["s"])).alias("end"))))
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return turns.groupBy(*by).agg(t.alias("t")).select(*by, F.array_join(F.transform("t", lambda x: x["s"]), "").alias("body"), fold.alias("spans"))


def preferences(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    Spans count characters of prompt + completion; the prompt is never learnt.
    """
    turns = stage(turns_in_order(conversations))
    given = pairs is not None
    other = None
    if given:
        pairs = stage(pairs.select("pair_id", "chosen_id", "rejected_id"))
    else:
        pairs, alone = forks(turns)
        made, other = swapped(turns, alone)
    side = lambda s: pairs.select("pair_id", F.col(f"{s}_id").alias("conv_id"), F.lit(s).alias("side")).join(turns, "conv_id").drop("conv_id")
    both = side("chosen").unionByName(side("rejected"))
    if not given:
        pairs, both = stage(pairs.unionByName(made)), both.unionByName(other)
    both = stage(both)
    # a place differs if one side has no turn there or the two turns aren't equal
    place = both.groupBy("pair_id", "pos").agg(F.count("*").alias("n"), F.countDistinct("role", "text").alias("kinds"))
    cut = place.groupBy("pair_id").agg(F.coalesce(F.min(F.when((F.col("n") < 2) | (F.col("kinds") > 1), F.col("pos"))), F.max("pos") + 1).alias("n_prompt_turns"))
    cut = stage(cut)
    parted = both.join(cut, "pair_id")
    prompt = _joined(parted.where("pos < n_prompt_turns and side = 'chosen'"), ["pair_id"]).select("pair_id", F.col("body").alias("prompt"))
    tails = _joined(parted.where("pos >= n_prompt_turns"), ["pair_id", "side"])
    tail = lambda s: tails.where(F.col("side") == s).select("pair_id", F.col("body").alias(s), F.col("spans").alias(f"{s}_spans"))
    out = pairs.join(cut, "pair_id").join(prompt, "pair_id", "left").join(tail("chosen"), "pair_id", "left").join(tail("rejected"), "pair_id", "left")
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    size = F.length(F.coalesce("prompt", F.lit(""))).cast("long")
    moved = lambda c: F.transform(F.coalesce(c, none), lambda x: F.struct((x["start"] + size).alias("start"), (x["end"] + size).alias("end")))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "chosen", "rejected")]
    if not given:
        out = out.where("n_prompt_turns > 0 and (chosen is not null or rejected is not null)")
    return out.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", *text, *[moved(f"{s}_spans").alias(f"{s}_spans") for s in ("chosen", "rejected")])


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table has no preference marks: the two rules above say what is a pair.  Spans as text: start-end, comma-joined."""
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias(c)
    out = preferences(table(spark, sf_dir, "conversations"))
    return out.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS pos,
         coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS l, max(CASE WHEN role = 'assistant' THEN pos END) AS last FROM t GROUP BY conv_id),
s AS (SELECT *, (row_number() OVER (PARTITION BY l[1] ORDER BY conv_id) - 1) // 2 AS seat FROM c),
g AS (SELECT min(conv_id) AS a, max(conv_id) AS b, count(*) AS n FROM s GROUP BY l[1], seat),
fork AS (SELECT a AS pair_id, a AS chosen_id, b AS rejected_id, x.l AS lc, y.l AS lr FROM g JOIN c x ON x.conv_id = a JOIN c y ON y.conv_id = b WHERE n = 2),
o AS (SELECT c.*, row_number() OVER (ORDER BY md5(conv_id::VARCHAR), conv_id) - 1 AS k, count(*) OVER () AS n FROM c JOIN g ON g.n = 1 AND g.a = conv_id WHERE last > 0),
swap AS (SELECT x.conv_id AS pair_id, x.conv_id AS chosen_id, y.conv_id AS rejected_id, x.l[:x.last + 1] AS lc, list_concat(x.l[:x.last], [y.l[y.last + 1]]) AS lr
         FROM o x JOIN o y ON y.k = (x.k + 1) % x.n),
p AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(lc), len(lr)) + 1), lambda i: lc[i] = lr[i]), false), least(len(lc), len(lr)) + 1) - 1 AS m
      FROM (SELECT * FROM fork UNION ALL SELECT * FROM swap)),
k AS (SELECT pair_id, chosen_id, rejected_id, m, lc[:m] AS pre, lc[m + 1:] AS a, lr[m + 1:] AS b FROM p WHERE m > 0 AND (len(lc) > m OR len(lr) > m)),
z AS (SELECT *, list_transform(pre, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)) AS ps,
             list_transform(a, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)) AS sa,
             list_transform(b, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)) AS sb FROM k),
e AS (SELECT pair_id, side, i, len(array_to_string(ps, '')) + coalesce(sum(len(str)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, len(str) AS n, role
      FROM (SELECT pair_id, ps, 'a' AS side, unnest(range(len(sa))) AS i, unnest(sa) AS str, unnest(list_transform(a, lambda x: x.r)) AS role FROM z
            UNION ALL SELECT pair_id, ps, 'b', unnest(range(len(sb))), unnest(sb), unnest(list_transform(b, lambda x: x.r)) FROM z)),
w AS (SELECT pair_id, string_agg((start + 22)::BIGINT::VARCHAR || '-' || (start + n)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (side = 'a') AS a,
             string_agg((start + 22)::BIGINT::VARCHAR || '-' || (start + n)::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (side = 'b') AS b
      FROM e WHERE role = 'assistant' GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, m::INT AS n_prompt_turns, array_to_string(ps, '') AS prompt, array_to_string(sa, '') AS chosen, array_to_string(sb, '') AS rejected,
       coalesce(w.a, '') AS chosen_spans, coalesce(w.b, '') AS rejected_spans
FROM z LEFT JOIN w USING (pair_id)
"""
