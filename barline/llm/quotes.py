r"""Linking of quotations in conversations, with DataFrame functions only.

A line's quote level is the number of ``>`` it begins with, spaces between them aside. Lines of one level in a row, blank ones
apart, are a passage, at level 0 one of the message's own. A passage is normalised (lower case, runs of white space one space)
and hashed; an own passage is known by the whole of it and by each line. A quoted passage or line links to the first earlier
message of its conversation with that hash, else, with at least ``LEAST`` characters, to the first message anywhere before it
in the order of (conversation, turn). Of the linked messages a message answers the one met at its lowest quote level, by most
hashes, then in its own conversation, then the latest. Answers are followed to a message that answers none, whose conversation
is the thread. Messages stand in a thread in the order of (conversation, turn), so after what they answer.

First messages are an aggregate by hash, so a passage that many messages hold or quote is never paired with itself. Rows of one
(conversation, turn) share their links. A null or empty text has no passages; null conversations and turns link to nothing and
come first; a null role is written empty; repeated rows stay; an empty table gives an empty result. The place in a thread is
counted per range partition, so that a thread of any size takes many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.session import written

LEAST = 12
PREFIX = r"^(?:[ \t]*>)+"
SAYS = r"(?:wrote|schrieb|écrit|escribió) ?:\s*$"
ROUNDS = 60  # pointers jump twice as far in each


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def _own_lines() -> Column:
    """Lines without quotes and without the line that announces a quote."""
    lines = _lines()
    quoted = lambda c: F.coalesce(c.rlike(PREFIX), F.lit(False))
    return F.filter(lines, lambda x, i: ~(quoted(x) | (x.rlike(SAYS) & quoted(F.get(lines, i + 1)))))


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, hash, long``: the normalised passages and lines of each message; ``messages`` has a ``row``."""
    line = messages.select("row", "conv_id", "turn", F.posexplode(_lines()).alias("i", "line"))
    parsed = line.select(
        "row", "conv_id", "turn", "i",
        F.length(F.regexp_replace(F.regexp_extract("line", PREFIX, 0), "[^>]", "")).alias("level"),
        _normal(F.regexp_replace("line", PREFIX, "")).alias("body"),
    )
    in_order = Window.partitionBy("row").orderBy("i")  # a message, which is one row already
    begins = (F.col("body") == "") | (F.lag("body", 1, "").over(in_order) == "") | (F.lag("level", 1, -1).over(in_order) != F.col("level"))
    placed = parsed.withColumn("begins", begins.cast("int")).withColumn("passage", F.sum("begins").over(in_order)).where("body <> ''")
    whole = placed.groupBy("row", "conv_id", "turn", "level", "passage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), " ").alias("body"))
    single = placed.select("row", "conv_id", "turn", "level", "passage", "body")
    return whole.unionByName(single).select("conv_id", "turn", "level", F.md5("body").alias("hash"), (F.length("body") >= LEAST).alias("long")).distinct()


def answers(found: DataFrame) -> DataFrame:
    """``conv_id, turn, up_conv, up_turn``: the message that each quoting message answers."""
    known = found.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    own, quoted = known.where("level = 0"), known.where("level > 0")
    here = own.groupBy("hash", "conv_id").agg(F.min("turn").alias("here_turn"))
    anywhere = own.where("long").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    met = quoted.join(here, ["hash", "conv_id"], "left").join(anywhere, "hash", "left")
    local = F.col("here_turn") < F.col("turn")
    before = F.col("first") < F.struct("conv_id", "turn")
    up = F.when(local, F.struct("conv_id", F.col("here_turn").alias("turn"))).when(before, F.col("first"))
    linked = met.select("conv_id", "turn", "level", "hash", up.alias("up")).where("up IS NOT NULL")
    votes = linked.groupBy("conv_id", "turn", "level", "up").agg(F.countDistinct("hash").alias("n"))
    rank = F.struct((-F.col("level")).alias("l"), "n", (F.col("up.conv_id") == F.col("conv_id")).alias("h"), "up")
    best = votes.groupBy("conv_id", "turn").agg(F.max(rank).alias("best"))
    return best.select("conv_id", "turn", F.col("best.up.conv_id").alias("up_conv"), F.col("best.up.turn").alias("up_turn"))


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, thread_id, depth`` of the messages that answer another, by pointer jumping."""
    jump = written(links.select("conv_id", "turn", F.col("up_conv").alias("to_conv"), F.col("up_turn").alias("to_turn"), F.lit(1).cast("long").alias("depth")), "jumps")
    for _ in range(ROUNDS):
        onward = jump.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("to_conv").alias("next_conv"), F.col("to_turn").alias("next_turn"), F.col("depth").alias("more"))
        moved = jump.join(onward, ["to_conv", "to_turn"], "left")
        jump = written(moved.select("conv_id", "turn", F.coalesce("next_conv", "to_conv").alias("to_conv"), F.coalesce("next_turn", "to_turn").alias("to_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")), "jumps")
        if jump.where("moved").isEmpty():
            return jump.select("conv_id", "turn", F.col("to_conv").alias("thread_id"), "depth")
        jump = jump.drop("moved")
    raise RuntimeError(f"answers did not settle in {ROUNDS} rounds")


def linked(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, thread_id, position, depth, up_conv, up_turn, n_quoted, body, chat`` of each row of ``df``."""
    picked = df.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    messages = written(picked, "messages")
    links = written(answers(written(passages(messages), "passages")), "answers")
    body = F.trim(F.array_join(_own_lines(), "\n"), F.lit(" \n\t\r"))
    quoted = F.size(F.filter(_lines(), lambda x: x.rlike(PREFIX)))
    told = messages.select("conv_id", "turn", "role", body.alias("body"), quoted.cast("long").alias("n_quoted"), F.md5(F.coalesce("text", F.lit(""))).alias("of_text"))
    told = told.join(links, ["conv_id", "turn"], "left").join(threads(links), ["conv_id", "turn"], "left")
    told = told.withColumn("thread_id", F.coalesce("thread_id", "conv_id")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    order = ["thread_id", "conv_id", "turn", "role", "of_text"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(told.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "threads")
    counts = ranged.groupBy("thread_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("thread_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select(F.col("thread_id").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("range", "thread_id").orderBy(*order[1:])))
    joined = placed.join(offsets, F.col("thread_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("<|end|>"))
    return joined.select("conv_id", "turn", "role", "thread_id", (F.col("offset") + F.col("rank")).alias("position"), "depth", "up_conv", "up_turn", "n_quoted", "body", chat.alias("chat"))


def oracle_sql() -> str:
    """The same in SQL, with answers followed by recursion."""
    normal = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
    return rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS row FROM conversations),
l AS (SELECT row, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
p AS (SELECT row, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '{PREFIX}'), '[^>]', '', 'g')) AS level, {normal.format(f"regexp_replace(line, '{PREFIX}', '')")} AS body FROM l),
b AS (SELECT *, CASE WHEN body = '' OR lag(body, 1, '') OVER w = '' OR lag(level, 1, -1) OVER w <> level THEN 1 ELSE 0 END AS begins FROM p WINDOW w AS (PARTITION BY row ORDER BY i)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY row ORDER BY i) AS passage FROM b),
f AS (SELECT DISTINCT conv_id, turn, level, md5(body) AS hash, length(body) >= {LEAST} AS long FROM (
        SELECT row, conv_id, turn, level, string_agg(body, ' ' ORDER BY i) AS body FROM g WHERE body <> '' GROUP BY row, conv_id, turn, level, passage
        UNION ALL SELECT row, conv_id, turn, level, body FROM g WHERE body <> '') AS x WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
met AS (SELECT q.conv_id, q.turn, q.level, q.hash,
               CASE WHEN h.turn < q.turn THEN q.conv_id WHEN (a.c, a.t) < (q.conv_id, q.turn) THEN a.c END AS up_conv,
               CASE WHEN h.turn < q.turn THEN h.turn WHEN (a.c, a.t) < (q.conv_id, q.turn) THEN a.t END AS up_turn
        FROM f AS q LEFT JOIN (SELECT hash, conv_id, min(turn) AS turn FROM f WHERE level = 0 GROUP BY hash, conv_id) AS h ON h.hash = q.hash AND h.conv_id = q.conv_id
        LEFT JOIN (SELECT hash, c, t FROM (SELECT hash, conv_id AS c, turn AS t, row_number() OVER (PARTITION BY hash ORDER BY conv_id, turn) AS k FROM f WHERE level = 0 AND long) AS o WHERE k = 1) AS a ON a.hash = q.hash
        WHERE q.level > 0),
v AS (SELECT conv_id, turn, level, up_conv, up_turn, count(DISTINCT hash) AS n FROM met WHERE up_conv IS NOT NULL GROUP BY ALL),
links AS (SELECT conv_id, turn, up_conv, up_turn FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, up_conv = conv_id DESC, up_conv DESC, up_turn DESC) AS k FROM v) AS r WHERE k = 1),
walk AS (SELECT conv_id, turn, up_conv AS c, up_turn AS t, 1 AS depth FROM links
         UNION ALL SELECT walk.conv_id, walk.turn, links.up_conv, links.up_turn, depth + 1 FROM walk JOIN links ON links.conv_id = walk.c AND links.turn = walk.t),
root AS (SELECT conv_id, turn, arg_max(c, depth) AS thread_id, max(depth) AS depth FROM walk GROUP BY conv_id, turn),
told AS (SELECT m.conv_id, m.turn, role, coalesce(thread_id, m.conv_id) AS thread_id, coalesce(depth, 0) AS depth, up_conv, up_turn, md5(text) AS of_text, string_split(text, chr(10)) AS ls
         FROM m LEFT JOIN links ON links.conv_id = m.conv_id AND links.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn),
said AS (SELECT *, len(list_filter(ls, lambda x: regexp_matches(x, '{PREFIX}'))) AS n_quoted,
                trim(array_to_string(list_filter(ls, lambda x, i: NOT (regexp_matches(x, '{PREFIX}') OR (regexp_matches(x, '{SAYS}') AND coalesce(regexp_matches(ls[i + 1], '{PREFIX}'), false)))), chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM told)
SELECT conv_id, turn, role, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, of_text) AS position, depth, up_conv, up_turn, n_quoted, body,
       '<|' || coalesce(role, '') || '|>' || chr(10) || body || '<|end|>' AS chat
FROM said
"""
