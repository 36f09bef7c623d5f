"""Filter interaction audit: what every filter removes at every place of every order.

A document is measured once: a mask of the filters that it fails, its part and its labels. Rows are counted into cells of
(part, mask, quality, toxic), at most 128 a part whatever the input. Each cell then folds across the array of all orders,
a constant of the plan that goes to every task with it: ``aggregate`` walks an order and remembers whether an earlier filter
has removed the cell, ``transform`` does so for all 120, which gives 600 structs weighted by the cell's rows. The structs of
a part's cells are merged by elementwise sums.

Filters, each over a whole text (words are maximal runs of other characters than space and ``\\t`` to ``\\r``): A fewer than 100
words; B distinct words under 80 % of words; C letters A-Z over 10 % of code points; D any of ``#$%&*|``; E the text of a
smaller doc_id, anywhere in the table. A row of a repeated doc_id is not its own copy; a null doc_id is no copy and has none.

Null texts are empty, null parts are the empty part, rows of unknown labels count as neither good nor toxic, several labels of
a doc_id count if any does; repeated rows count as often as they occur; a part without documents does not occur, so an empty
table gives an empty result. No task holds a group of copies: they are counted by (text digest, part, labels) before they meet.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
SALTS = 64  # partitions over which rows without a doc_id are spread: they meet no label
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that need the text alone."""
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(failures: dict[str, Column]) -> Column:
    mask = F.lit(0)
    for name, failed in failures.items():
        mask = mask + F.when(failed, 1 << FILTERS.index(name)).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, good, toxic, n``: documents by part, failed filters (bit i for filter i) and labels."""
    d = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
    )
    d = d.select("doc_id", "part", _mask(text_failures(F.col("text"))).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    d = d.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = known.select(F.col("doc_id").alias("_id"), F.lit(0).alias("_salt"), "good", "toxic")
    d = d.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("int"))
    d = d.join(known.withColumnRenamed("_salt", "_known"), (F.col("doc_id") == F.col("_id")) & (F.col("_salt") == F.col("_known")), "left")
    good, toxic = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    # the smallest doc_id of a text and its rows, by part and labels first, then over the few such groups of a text
    d = d.groupBy("digest", "part", "mask", good, toxic).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    d = d.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "nameless", "first")).alias("groups"))
    d = d.select("least", F.inline("groups"))
    originals = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    d = d.select("part", "mask", "good", "toxic", originals.alias("originals"), (F.col("n") - originals).alias("copies"))
    copy = F.lit(1 << FILTERS.index("E"))
    kinds = F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), F.col("copies").alias("n")))
    d = d.select("part", "good", "toxic", F.inline(kinds)).where("n > 0")
    return d.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _folded(cell: Column, orders: Column) -> Column:
    """600 structs of one cell, one for each step of each order; a filter is its bit."""
    zero = F.lit(0).cast("long")
    n = cell["n"]

    def row(f: Column, gone: Column, step: Column) -> Column:
        fails = cell["mask"].bitwiseAND(f) != 0
        here = fails & ~gone
        return F.struct(
            f.alias("f"), step.alias("step"), F.when(~gone & ~fails, n).otherwise(zero).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"),
            F.when(fails & gone, n).otherwise(zero).alias("redundant"), F.when(cell["mask"] == f, n).otherwise(zero).alias("unique_fails"),
            F.when(here & cell["good"], n).otherwise(zero).alias("good_lost"), F.when(here & cell["toxic"], n).otherwise(zero).alias("toxic_lost"),
        )

    kind = "array<struct<f:int,step:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"

    def walk(order: Column) -> Column:
        start = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("rows"))

        def step(state: Column, f: Column) -> Column:
            rows = F.concat(state["rows"], F.array(row(f, state["gone"], F.size(state["rows"]) + 1)))
            return F.struct((state["gone"] | (cell["mask"].bitwiseAND(f) != 0)).alias("gone"), rows.alias("rows"))

        return F.aggregate(order, start, step)["rows"]

    return F.flatten(F.transform(orders, walk))


def interactions(counted: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with the counts of ``COUNTS`` and ``shapley`` for each part of ``counted`` (see ``cells``)."""
    every = list(permutations(range(len(FILTERS))))
    bits = F.array(*[F.lit(1 << f) for f in range(len(FILTERS))])
    orders = F.array(*[F.array(*[F.lit(1 << f) for f in o]) for o in every])
    names = F.array(*[F.lit("".join(FILTERS[f] for f in o)) for o in every])
    d = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # at most 128 cells

    def add(a: Column, b: Column) -> Column:
        return F.struct(a["f"].alias("f"), a["step"].alias("step"), *[(a[c] + b[c]).alias(c) for c in COUNTS])

    nothing = F.struct(F.lit(0).alias("mask"), F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate("cells", _folded(nothing, orders), lambda total, cell: F.zip_with(total, _folded(cell, orders), add))
    d = d.select("part", merged.alias("rows"))

    def removed(f: Column) -> Column:
        return F.aggregate("rows", F.lit(0).cast("long"), lambda total, r: total + F.when(r["f"] == f, r["removed"]).otherwise(0))

    d = d.select("part", F.transform(bits, removed).alias("shares"), F.posexplode("rows").alias("at", "row"))
    order = F.element_at(names, F.floor(F.col("at") / len(FILTERS)).cast("int") + 1)
    return d.select("part", order.alias("filter_order"), "row.step", *[f"row.{c}" for c in COUNTS], F.element_at("shares", F.array_position(bits, F.col("row.f")).cast("int")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    return interactions(cells(docs, labels, id_col, text_col, part_col))


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT d.*, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, good, toxic, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step:step] AS f, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(failed, f) AS fails, translate(failed, earlier, '') <> failed AS gone FROM c, s) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r"""
