"""Conversations without quotations, by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` marks are quotations; the number of marks is their level. A run of neighbouring lines of one
level is a passage. Each quoted line is normalised (lower case, letters and digits only) and hashed, and joined to the
lines that the messages of the same conversation wrote themselves; of equal lines the earliest message counts as the
original. The message that gave a passage most of its lines is the passage's original (the latest, of equally many), if
it is earlier. What a message answers is found likewise from all its quoted lines of the shallowest level at which any
has an original. Replies form threads, named by the turn of their first message; the thread and depth of each message
come from doubling the steps towards it, so that a chain of n replies takes log2(n) joins. Messages are ordered by thread
and turn: a reply follows what it answers.

A message is a row of conv_id, turn, role and text; rows equal in all four give equal results. Lines with a colon that
announce a quotation go with it. A null text has no lines; a null conversation or turn links to nothing. A text of any
number of lines or marks is one row until its lines are rows of their own: no step is recursive in either. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skylattice.storage import materialise, release

_QUOTED = r"(?m)^[ \t]*>"
_MARKS = r"^[> \t]*"
_INTRO = r"^[^>]{0,200}\b(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
_NOISE = r"[^\p{L}\p{N}]+"


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def _parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``lines``: the line, its level, and the levels of the lines before and after it. The arrays are
    zipped outside any lambda, so that each is built once for a text."""
    levels = F.transform("split", _level)
    shifted = messages.withColumn("split", F.split("text", "\n")).withColumn("levels", levels)
    ends = F.array(F.lit(0))
    n = F.size("levels")
    before = F.concat(ends, F.slice("levels", F.lit(1), n - 1))
    after = F.concat(F.slice("levels", F.lit(2), n), ends)
    zipped = F.arrays_zip(F.col("split").alias("line"), F.col("levels").alias("level"), before.alias("before"), after.alias("after"))
    return shifted.withColumn("lines", zipped).drop("split", "levels")


def _is_own(x) -> Column:
    """Neither quoted nor the line that announces a quotation."""
    return (x["level"] == 0) & ~((x["after"] > 0) & x["line"].rlike(_INTRO))


def _own_text() -> Column:
    return F.array_join(F.transform(F.filter("lines", _is_own), lambda x: x["line"]), "\n")


def _hashed(lines: DataFrame) -> DataFrame:
    """Rows of lines with the hash of what they say; those that say nothing go."""
    norm = F.trim(F.regexp_replace(F.lower("line"), _NOISE, " "))
    return lines.withColumn("norm", norm).where("norm <> ''").withColumn("hash", F.xxhash64("norm")).drop("line", "norm")


def _best(given: DataFrame, *by: str) -> DataFrame:
    """The original that gave most lines, the latest of equally many."""
    votes = given.groupBy(*by, "original").agg(F.count("*").alias("n"))
    return votes.groupBy(*by).agg(F.max(F.struct("n", "original"))["original"].alias("original"))


def _given(named: DataFrame, quoting: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, m, level, passage, original) for each different quoted line that an earlier message wrote."""
    each = quoting.where("conv_id is not null and turn is not null").dropDuplicates(["m"])
    rows = each.select("conv_id", "turn", "m", F.posexplode("lines").alias("at", "x")).select("conv_id", "turn", "m", "at", "x.*")
    begins = ((F.col("level") > 0) & (F.col("level") != F.col("before"))).cast("int")
    passage = F.sum(begins).over(W.partitionBy("m").orderBy("at"))  # the lines of one text
    asked = _hashed(rows.withColumn("passage", passage.cast("int")).where("level > 0").select("conv_id", "turn", "m", "level", "passage", "line"))
    asked = materialise(asked.distinct(), "quoted-lines")
    talks = named.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    own = _hashed(_parsed(talks.where("turn is not null")).select("conv_id", "turn", F.explode(F.filter("lines", _is_own)).alias("x")).select("conv_id", "turn", "x.line"))
    originals = materialise(own.groupBy("conv_id", "hash").agg(F.min("turn").alias("original")), "original-lines")
    given = materialise(asked.join(originals, ["conv_id", "hash"]).where("original < turn").drop("hash"), "given-lines")
    release(asked, originals)
    return given


def _threads(parents: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, parent, thread, depth) of the messages that answer another (a stored table conv_id, turn,
    parent). Each round doubles the steps that a row has taken."""
    now = materialise(parents.select("*", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("further"), F.col("depth").alias("steps"))
        met = now.join(above, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        moved = met.select("conv_id", "turn", "parent", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"), F.isnotnull("t").alias("moved"))
        after = materialise(moved, "threads")
        release(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")
        now._skylattice_path = after._skylattice_path


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message in reply order: conv_id, turn, role, text (its own), n_quotes (passages), max_level, parent
    (the turn it answers), thread, depth and quoted (level, passage and original turn of each passage whose original is
    found)."""
    turn_kind = messages.schema["turn"].dataType.simpleString()
    kind = f"array<struct<level:int,passage:int,original:{turn_kind}>>"
    named = messages.select("conv_id", "turn", "role", "text", F.xxhash64("conv_id", "turn", "role", "text").alias("m"))
    parsed = _parsed(named)
    begins = F.size(F.filter("lines", lambda x: (x["level"] > 0) & (x["level"] != x["before"])))
    level = F.array_max(F.transform("lines", lambda x: x["level"]))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    is_null = F.isnull("text")
    out = parsed.select(
        "conv_id", "turn", "role", F.when(~is_null, _own_text()).alias("text"), "m",
        F.when(is_null, 0).otherwise(begins).cast("long").alias("n_quotes"), zero(level, "int").alias("max_level"),
    )
    quoting = _parsed(named.where(F.col("text").rlike(_QUOTED)))
    if quoting.limit(1).count():
        given = _given(named, quoting)
        passages = _best(given, "m", "level", "passage")
        quoted = materialise(passages.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("level", "passage", "original"))).cast(kind).alias("quoted")), "quoted")
        parents = _best(given, "conv_id", "turn", "level").groupBy("conv_id", "turn").agg(F.min(F.struct("level", "original"))["original"].alias("parent"))
        threads = _threads(materialise(parents, "reply-parents"))
        out = out.join(threads, ["conv_id", "turn"], "left").join(quoted, "m", "left")
    else:
        none = F.lit(None).cast(turn_kind)
        out = out.select("*", none.alias("parent"), none.alias("thread"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast(kind).alias("quoted"))
    out = out.select(
        "conv_id", "turn", "role", "text", "n_quotes", "max_level", "parent", F.coalesce("thread", "turn").alias("thread"),
        zero(F.col("depth"), "long").alias("depth"), F.coalesce("quoted", F.array().cast(kind)).alias("quoted"),
    )
    return out.orderBy("conv_id", "thread", "turn", "role", "text")


def op3_quote_links(spark, sf_dir):
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("quoted")


#: The whole linking, line by line. The given tables hold no line that begins with a mark; the tests also run this
#: statement over conversations that quote each other.
ORACLE_SQL = {
    "op3_quote_links": rf"""
WITH RECURSIVE c AS (SELECT row_number() OVER () AS rid, * FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
l AS (SELECT rid, conv_id, turn, i, line, length(marks) - length(replace(marks, '>', '')) AS level
      FROM (SELECT *, ls[i] AS line, regexp_extract(ls[i], '{_MARKS}') AS marks FROM (SELECT rid, conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM c)))),
n AS (SELECT *, coalesce(lead(level) OVER o, 0) AS after, coalesce(lag(level) OVER o, 0) AS before, trim(regexp_replace(lower(line), '{_NOISE}', ' ', 'g')) AS norm FROM l WINDOW o AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT *, level = 0 AND NOT (after > 0 AND regexp_matches(line, '{_INTRO}')) AS own, sum((level > 0 AND level <> before)::INTEGER) OVER (PARTITION BY rid ORDER BY i) AS passage FROM n),
s AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) FILTER (own) AS said, count(*) FILTER (level > 0 AND level <> before) AS n_quotes, max(level) AS max_level FROM k GROUP BY rid),
o AS (SELECT conv_id, norm, min(turn) AS original FROM k WHERE own AND norm <> '' GROUP BY ALL),
g AS (SELECT DISTINCT k.rid, conv_id, k.turn, level, passage, norm, original FROM k JOIN o USING (conv_id, norm) WHERE level > 0 AND original < k.turn),
v AS (SELECT conv_id, turn, level, arg_max(original, (n, original)) AS original FROM (SELECT conv_id, turn, level, original, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL),
p AS (SELECT conv_id, turn, arg_min(original, level) AS parent FROM v GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS thread, 1::BIGINT AS depth FROM p UNION ALL SELECT up.conv_id, up.turn, p.parent, depth + 1 FROM up JOIN p ON p.conv_id = up.conv_id AND p.turn = up.thread),
h AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL)
SELECT a.conv_id, a.turn, a.role, CASE WHEN a.text IS NOT NULL THEN coalesce(said, '') END AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(max_level, 0)::INTEGER AS max_level,
  parent, coalesce(thread, a.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth
FROM conversations a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.turn IS NOT DISTINCT FROM c.turn AND a.role IS NOT DISTINCT FROM c.role AND a.text IS NOT DISTINCT FROM c.text
LEFT JOIN s USING (rid) LEFT JOIN p ON p.conv_id = a.conv_id AND p.turn = a.turn LEFT JOIN h ON h.conv_id = a.conv_id AND h.turn = a.turn""",
}
