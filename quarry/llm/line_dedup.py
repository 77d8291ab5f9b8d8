"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier line that stays is within one word of it.  Native.

The symbols of the edit distance are a line's words, lower-cased.  Lines of ``words_per_edit`` words or more may differ by one word put
in, left out or replaced; shorter ones, where one word is too much of the line, go only if equal to an earlier one.  Lines without a
word are always kept.

1. Equal lines become one text; its first occurrence is the smallest (doc_id, line number).  Where these are equal
   (null or repeated ids), the hash of the document's text and then a number of the row decide.
2. A text can have a partner only if it shares its first or its second half (cut for its own length and one
   word more or less) with another text: an edit leaves one half untouched.  Only such texts go on.
3. Likewise in BLOCKS blocks: all but one block must be equal to another text's.  Nothing is lost by either step.
4. A block so shared emits its deletion neighbourhood as hashed keys: one for each word left out, and one for each
   gap, both of the form (rest of the text, place, words left, prefix, suffix).  Texts with a common key are within one
   edit of each other: no pairs are formed inside a key, and at most one text of a key stays.
5. In order of first occurrence a text stays unless an earlier partner stays.  This takes rounds: a text that comes first under all
   its keys stays, what shares a key with it goes, and the others go into the next round without both.  Near copies of one line are
   settled in the first round or two; a chain of n lines, each one word from the one before, takes n / 2 rounds.
6. Each text that goes takes the earliest partner that stays, and the edit distance to it is verified word by word.

first_doc and first_line name that partner (an equal line's first occurrence, if there is one), which is within the bound.

Keys come from prefix XORs of position-salted word hashes, worked out in blocks, so a block of n words costs O(n).

Edge cases: a null text has no lines; repeated documents and lines are occurrences like any other (the first
stays); a null doc_id comes first; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, global_rank, stage, table

#: Lines of fewer words have no near copies.
WORDS_PER_EDIT = 8
BLOCK, BLOCKS = 256, 4


def _bind(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def prefix_xor(values: Column) -> Column:
    """[0, v0, v0^v1, ...] of an array of longs, block by block."""
    zero = F.array(F.lit(0).cast("long"))
    scan = lambda a: F.aggregate(a, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(v))))
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    local = F.transform(starts, lambda s: scan(F.slice(values, s, F.lit(BLOCK))))

    def joined(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
        tails = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, p: F.transform(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), lambda v: v.bitwiseXOR(p)))
        return F.concat(zero, F.flatten(tails))

    return _bind(local, joined)


def neighbourhood(words: Column) -> Column:
    """Hashed keys of a text: every deletion, and every gap that a deletion of a longer text could leave."""
    n = F.size(words)
    ahead = prefix_xor(F.transform(words, lambda w, i: F.xxhash64(F.lit(1), i, w)))
    behind = prefix_xor(F.transform(words, lambda w, i: F.xxhash64(F.lit(2), n - i, w)))
    both = F.struct(ahead.alias("p"), behind.alias("q"))

    def keys(b: Column) -> Column:
        total = F.element_at(b["q"], -1)
        suffix = lambda i: total.bitwiseXOR(F.get(b["q"], i))
        places = F.sequence(F.lit(0), n)
        drop = F.transform(F.slice(places, F.lit(1), n), lambda i: F.xxhash64(i, n - 1, F.get(b["p"], i), suffix(i + 1)))
        gap = F.transform(places, lambda i: F.xxhash64(i, n, F.get(b["p"], i), suffix(i)))
        return F.concat(drop, gap)

    return _bind(both, keys)


def half_keys(words: Column) -> Column:
    """Hashes of the first and the last half, for the text's own length and one word more or less."""
    n = F.size(words)
    # for a length of n - 1, n and n + 1, the halves are cut at one of two places
    first = [F.floor((n + d) / 2).cast("int") for d in (-1, 1)]
    last = [n + d - F.floor((n + d) / 2).cast("int") for d in (-1, 1)]
    head = [F.xxhash64(F.lit(1), F.slice(words, F.lit(1), h)) for h in first]
    tail = [F.xxhash64(F.lit(2), F.slice(words, n - t + 1, t)) for t in last]
    return F.array_distinct(F.array(*head, *tail))


def block_keys(words: Column) -> Column:
    """For partners of at least n and of at least n - 1 words, and each block: (longer, block, hash of all but the block)."""
    n = F.size(words)
    out = []
    for longer in (0, 1):
        least = n - longer  # the length of the shorter partner, by which both are cut
        for j in range(BLOCKS):
            head, tail = F.expr("0") if j == 0 else _place(least, j), least - _place(least, j + 1)
            rest = F.xxhash64(least, F.lit(j), F.slice(words, F.lit(1), head), F.slice(words, n - tail + 1, tail))
            out.append(F.struct(F.lit(longer).alias("longer"), F.lit(j).alias("block"), rest.alias("rest")))
    return F.array(*out)


def _place(length: Column, j: int | Column) -> Column:
    return F.floor(length * j / BLOCKS).cast("int")


def block_neighbourhood(words: Column, longer: Column, block: Column) -> Column:
    """Keys of the block alone: a partner differs nowhere else."""
    least = F.size(words) - longer
    start, end = _place(least, block), _place(least, block + 1) + longer
    return neighbourhood(F.slice(words, start + 1, end - start))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at edit distance 1 or less, word by word."""

    def longer_by_one(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(F.slice(x, F.lit(1), F.size(y)), y, lambda u, v: u == v), F.lit(False)).cast("int")
        at = F.when(at == 0, F.size(x)).otherwise(at)
        return F.concat(F.slice(x, F.lit(1), at - 1), F.slice(x, at + 1, F.greatest(F.size(x) - at, F.lit(0)))) == y

    differ = F.size(F.filter(F.zip_with(a, b, lambda u, v: u != v), lambda d: d))
    return F.when(F.size(a) == F.size(b), differ <= 1).when(F.size(a) == F.size(b) + 1, longer_by_one(a, b)).when(F.size(b) == F.size(a) + 1, longer_by_one(b, a)).otherwise(F.lit(False))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, copy, line_no, words) of the lines that have words, of docs with row and copy."""
    lines = docs.select("doc_id", "row", "copy", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(WORD)).select("doc_id", "row", "copy", "line_no", words_of("line").alias("words"))


def words_of(line: str) -> Column:
    """The words of a line, lower-cased; its separators become single spaces, since a split at one sign needs no regular expression."""
    return F.array_remove(F.split(F.translate(F.lower(line), "\t\n\v\f\r", "     "), " "), "")


def _keyed(near: DataFrame) -> DataFrame:
    """(id, key, first) of keys that several texts share, ``first`` the earliest of them."""
    # keys are read twice, to count them and to join: written, they are worked out once
    blocks = stage(near.select("id", F.explode(block_keys(F.col("words"))).alias("b")).select("id", "b.*"))
    shared = blocks.groupBy("rest").agg(F.count("*").alias("n")).where("n > 1").select("rest")
    open_ = blocks.join(shared, "rest").join(near, "id")
    keys = block_neighbourhood(F.col("words"), F.col("longer"), F.col("block"))
    keyed = stage(open_.select("id", "rest", F.explode(keys).alias("key")).select("id", F.xxhash64("rest", "key").alias("key")))
    return _with_first(keyed)


def _with_first(keyed: DataFrame) -> DataFrame:
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    return stage(keyed.join(first, "key"))


def _partners(near: DataFrame) -> DataFrame:
    """(id, words) -> (id, to_id): each text that goes with the earliest one within an edit of it that stays."""
    members = all_ = _keyed(near)
    stays, found, rounds = None, None, 0
    while not members.isEmpty():
        heads = stage(members.groupBy("id").agg(F.max(F.col("first") < F.col("id")).alias("_later")).where("not _later").select("id"))
        hit = stage(members.where("first < id").join(heads.withColumnRenamed("id", "first"), "first", "left_semi").groupBy("id").agg(F.min("first").alias("to_id")))
        stays, found, rounds = heads if stays is None else stays.unionByName(heads), hit if found is None else found.unionByName(hit), rounds + 1
        rest = members.select("id", "key").join(heads.unionByName(hit.select("id")), "id", "left_anti")
        members = _with_first(rest)
        # what shares no key any more stays
        alone = stage(rest.select("id").distinct().join(members.select("id"), "id", "left_anti"))
        stays = stays.unionByName(alone)
    if found is None:
        return near.select("id", F.col("id").alias("to_id")).where("id < to_id")
    if rounds > 1:  # a text may have lost its place to one round's partner and have an earlier one of a later round
        kept = all_.select("key", "id").join(stays, "id", "left_semi").withColumnRenamed("id", "to_id")
        found = all_.select("key", "id").join(kept, "key").where("to_id < id").groupBy("id").agg(F.min("to_id").alias("to_id")).join(found.select("id"), "id", "left_semi")
    mine, theirs = near.select("id", F.col("words").alias("a")), near.select(F.col("id").alias("to_id"), F.col("words").alias("b"))
    return found.join(mine, "id").join(theirs, "to_id").where(within_one(F.col("a"), F.col("b"))).select("id", "to_id")


def _verdicts(docs: DataFrame, words_per_edit: int) -> DataFrame:
    """(doc_id, text, copy) -> copy, and the columns of line_verdicts.

    A doc_id may be null or stand on several rows, so a place is (doc_id, hash of the row's text, line number): the text at
    it is one, and rows that share it are equal.  Among those, ``copy``, a number of each row, says which comes first.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"), "copy")
    lines = lines_of(docs)
    halves = F.when(F.size("words") >= max(2, words_per_edit), half_keys(F.col("words")))
    # a second hash of the words, with other seeds than the first: of long lines the halves' hashes hold it already
    second = F.xxhash64(F.lit(7), F.when(F.col("halves").isNull(), F.xxhash64(F.lit(7), F.col("words"))), F.col("halves"))
    narrow = lines.select("*", halves.alias("halves")).select("doc_id", "row", "copy", "line_no", F.xxhash64("words").alias("h1"), second.alias("h2"), F.size("words").alias("n_words"), "halves")
    narrow = stage(narrow)
    at = F.struct(F.col("doc_id").alias("doc"), F.col("line_no").alias("line"), F.col("row"))
    seat = F.min(F.struct(at.alias("at"), F.col("copy")))
    texts = narrow.groupBy("h1", "h2").agg(seat.alias("_seat"), F.first("halves").alias("halves"))
    texts = stage(texts.select("h1", "h2", "_seat.at", F.col("_seat.copy").alias("first_copy"), "halves"))
    half = texts.where("halves is not null").select("at", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    maybe = half.join(shared, "half").select("at").distinct().select(F.col("at.doc").alias("_doc"), F.col("at.row").alias("_row"), F.col("at.line").alias("_line"))
    # the texts themselves, of the first occurrences of those that may have a partner
    which = maybe.groupBy("_doc", "_row").agg(F.collect_set("_line").alias("_lines"))
    whole = docs.select("doc_id", "text", "row").join(which.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")))
    picked = whole.select("doc_id", "row", "_lines", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.array_contains("_lines", F.col("line_no")))
    picked = picked.select(at.alias("at"), words_of("line").alias("words"))
    # numbers in order of first occurrence stand for the texts: plain longs aggregate by hash, without sorting
    near = stage(global_rank(picked.dropDuplicates(["at"]), ["at"], "id"))
    ends = _partners(near.select("id", "words"))
    place = near.select("id", "at")
    partner = stage(ends.join(place, "id").join(place.select(F.col("id").alias("to_id"), F.col("at").alias("to")), "to_id").select("at", "to"))
    of_text = texts.join(partner, "at", "left").select("h1", "h2", F.col("at.line").alias("_line"), "first_copy", F.col("to").isNull().alias("_alone"), F.coalesce("to", "at").alias("to"))
    out = narrow.drop("halves", "row").join(of_text, ["h1", "h2"])
    own = (F.col("copy") == F.col("first_copy")) & (F.col("line_no") == F.col("_line"))
    return out.select("copy", "doc_id", "line_no", "n_words", (own & F.col("_alone")).alias("kept"), F.col("to.doc").alias("first_doc"), F.col("to.line").alias("first_line"))


def line_verdicts(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc_id, text) -> doc_id, line_no, n_words, kept, first_doc, first_line: one row for each line with words.

    first_doc and first_line say which kept line a dropped line is equal or near to; for a kept line they are its own.
    """
    return _verdicts(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("copy")), words_per_edit).drop("copy")


def dedup_lines(docs: DataFrame, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """All of docs, with the text of each made of its lines that stay (blank lines among them)."""
    copy, gone = fresh(docs, "copy"), fresh(docs, "gone")
    numbered = stage(docs.withColumn(copy, F.monotonically_increasing_id()))
    verdicts = _verdicts(numbered.select("doc_id", "text", F.col(copy).alias("copy")), words_per_edit)
    dropped = verdicts.where("not kept").groupBy(F.col("copy").alias(copy)).agg(F.collect_set("line_no").alias(gone))
    both = numbered.join(dropped, copy, "left")
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains(F.col(gone), i), F.lit(False)))
    return both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents"))


#: Plain DuckDB SQL for the same rows: candidates share a half, every pair is compared word by word, texts are taken one by one in order.
ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS words FROM l),
x AS MATERIALIZED (SELECT words, len(words)::INT AS n, min((doc_id, line_no)) AS pl FROM w WHERE len(words) > 0 GROUP BY words),
h AS (SELECT pl, words, n, unnest([('h', words[:(n - 1) // 2]), ('h', words[:(n + 1) // 2]),
             ('t', words[n + 1 - (n - 1 - (n - 1) // 2):]), ('t', words[n + 1 - (n + 1 - (n + 1) // 2):])]) AS half FROM x WHERE n >= 8),
c AS (SELECT DISTINCT a.pl AS pl, b.pl AS other FROM h a JOIN h b ON a.half = b.half AND a.pl > b.pl AND abs(a.n - b.n) <= 1),
p AS (SELECT c.pl, c.other, a.words AS a, b.words AS b, least(a.n, b.n) AS k FROM c JOIN x a ON c.pl = a.pl JOIN x b ON c.other = b.pl),
q AS (SELECT *, coalesce(list_position(list_transform(range(1, k + 1), lambda i: a[i] = b[i]), false), k + 1) - 1 AS ahead,
             coalesce(list_position(list_transform(range(k), lambda i: a[len(a) - i] = b[len(b) - i]), false), k + 1) - 1 AS behind FROM p),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pl) AS i, pl, list(other) AS ups FROM q WHERE ahead + behind >= k - CASE WHEN len(a) = len(b) THEN 1 ELSE 0 END GROUP BY pl),
g AS (SELECT 0::BIGINT AS i, (SELECT list(pl) FROM s WHERE false) AS gone UNION ALL
      SELECT s.i, CASE WHEN len(list_filter(s.ups, lambda u: NOT list_contains(coalesce(g.gone, []), u))) > 0 THEN list_append(coalesce(g.gone, []), s.pl) ELSE g.gone END FROM g JOIN s ON s.i = g.i + 1),
z AS MATERIALIZED (SELECT unnest(gone) AS pl FROM (SELECT gone FROM g ORDER BY i DESC LIMIT 1)),
f AS (SELECT pl, min(up) AS top FROM (SELECT pl, unnest(ups) AS up FROM s) WHERE pl IN (SELECT pl FROM z) AND up NOT IN (SELECT pl FROM z) GROUP BY pl)
SELECT w.doc_id, w.line_no, x.n AS n_words, (f.pl IS NULL AND x.pl = (w.doc_id, w.line_no)) AS kept,
       coalesce(f.top, x.pl)[1] AS first_doc, coalesce(f.top, x.pl)[2] AS first_line
FROM w JOIN x ON w.words = x.words LEFT JOIN f ON x.pl = f.pl
"""


def brute_force(docs: list[tuple], words_per_edit: int = WORDS_PER_EDIT) -> dict:
    """(doc_id, line_no) -> (kept, first) by comparing every two texts, for tests."""
    import re

    first: dict[tuple, tuple] = {}
    lines = {}
    for doc_id, text in docs:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            if w := tuple(re.findall(WORD, line.lower())):
                lines[doc_id, no] = w
                first[w] = min(first.get(w, (doc_id, no)), (doc_id, no))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    to: dict[tuple, tuple] = {}
    for w, at in sorted(first.items(), key=lambda x: x[1]):
        partners = [o for v, o in first.items() if o < at and to[o] == o and len(v) >= words_per_edit and len(w) >= words_per_edit and near(w, v)]
        to[at] = min(partners, default=at)
    return {k: (to[first[w]] == k, to[first[w]]) for k, w in lines.items()}
