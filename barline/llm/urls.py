"""URL filtering by association rules that Spark's FP-growth mines from labelled urls.

A url becomes at most eight tokens: scheme, top-level and registered domain, first host label, first two path segments (a number
is ``#``), the file extension of its last one, and the first query key. Urls that a listed rule judges are the labelled ones;
their tokens and verdict are the transactions. Of the mined combinations those with a verdict as consequent, at least
``support`` of the transactions and ``confidence`` stay. A url without a listed rule is judged by the mined rule that fits with
the highest confidence, then support, then most tokens, then first in order of its tokens; without any, by the commoner label.

Mined rules match by an inverted index: urls are reduced to the distinct sets of their tokens that occur in rules, each set's
tokens look up the rules that hold them, and a rule fits a set if it is met once for each of its tokens. The tokens in rules
number at most 8 / support, whatever the input.

Null urls and those without ``://`` have empty host and path and no tokens but are judged as any other; repeated rows and ids
stay; with no labelled url every verdict is allow; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.session import written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE = 0.01, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, scheme, host, path, query`` of each row."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("page_id"), F.when(at > 0, F.substring(url, F.lit(1), at - 1)).otherwise(F.lit("")).alias("scheme"), rest.alias("rest")).select(
        "page_id",
        F.translate("scheme", UPPER, LOWER).alias("scheme"),
        F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("rest", "^[^?#]*\\?([^#]*)", 1).alias("query"),
    )


def tokens() -> Column:
    """Array of the tokens of a parsed url."""
    labels, segments = F.split("host", "\\."), F.filter(F.split("path", "/"), lambda s: s != "")
    named = lambda kind, value: F.when(value != "", F.concat(F.lit(f"{kind}="), value))
    segment = lambda i: F.regexp_replace(F.get(segments, F.lit(i)), "^[0-9]+$", "#")
    n = F.size(labels)
    found = F.array_compact(
        F.array(
            named("scheme", F.col("scheme")),
            named("tld", F.get(labels, n - 1)),
            F.when(n >= 2, F.concat(F.lit("domain="), F.get(labels, n - 2), F.lit("."), F.get(labels, n - 1))),
            F.when(n >= 3, F.concat(F.lit("label="), F.get(labels, F.lit(0)))),
            named("first", segment(0)),
            named("second", segment(1)),
            named("type", F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1)),
            named("key", F.regexp_extract("query", "^([^=&]+)", 1)),
        )
    )
    return F.transform(found, lambda t: F.replace(t, F.lit(" "), F.lit("%20")))  # sets of tokens are written with spaces


def listed(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest listed rule that fits, as a struct of its text and verdict; null without one."""
    fitting = [
        F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, host, path in rules
    ]
    return F.array_max(F.array_compact(F.array(*fitting))) if fitting else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def mined(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """``rule_id, tokens, verdict, confidence, support`` of the mined rules; ``labelled`` has ``tokens, verdict``."""
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.get("consequent", F.lit(0)).startswith("verdict="))
    chosen = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(F.get("consequent", F.lit(0)), "=", -1).alias("verdict"), "confidence", "support")
    return chosen.withColumn("rule_id", F.array_join("tokens", " "))


def judged(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, mined``: the listed rule and the mined one that judged each row."""
    urls = written(parsed(df, id_col, url_col).select("page_id", "host", "path", tokens().alias("tokens"), listed(rules).alias("listed")), "urls")
    labelled = urls.where(F.col("listed").isNotNull()).select("tokens", F.col("listed.verdict").alias("verdict"))
    votes = {r.verdict: r["count"] for r in labelled.groupBy("verdict").count().collect()}  # one row a verdict
    common = min(votes, key=lambda v: (-votes[v], v), default="allow")
    out = lambda verdict, of: urls.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", verdict).alias("verdict"), of.alias("mined"))
    if not votes:
        return out(F.lit(common), F.lit(None).cast("string"))
    found = written(mined(labelled, support, confidence), "url_rules")
    in_rules = [r[0] for r in found.select(F.explode("tokens")).distinct().collect()]  # at most 8 / support
    if not in_rules:
        return out(F.lit(common), F.lit(None).cast("string"))
    known = F.array(*[F.lit(t) for t in sorted(in_rules)])
    marked = urls.withColumn("known", F.when(F.col("listed").isNull(), F.array_join(F.array_sort(F.array_intersect("tokens", known)), " ")))
    sets = marked.where("known <> ''").select("known").distinct()
    index = found.select("rule_id", F.size("tokens").alias("size"), "verdict", "confidence", "support", F.explode("tokens").alias("token"))
    hits = sets.select("known", F.explode(F.split("known", " ")).alias("token")).join(index, "token")
    fits = hits.groupBy("known", "rule_id").agg(F.first("size").alias("size"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.count(F.lit(1)).alias("met")).where("met = size")
    best = fits.groupBy("known").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.col("size")).alias("z"), "rule_id", "verdict")).alias("best"))
    joined = marked.join(best, "known", "left")
    return joined.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "best.verdict", F.lit(common)).alias("verdict"), F.col("best.rule_id").alias("mined"))


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> str:
    """The same in SQL, by counting every subset of every labelled url's tokens."""
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    fitting = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in rules)
    segment = "regexp_replace(segments[{}], '^[0-9]+$', '#')"
    return f"""
WITH listed_rules AS ({fitting}),
cut AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, 1, instr(url, '://') - 1) ELSE '' END AS scheme,
               CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, n, {lower.format("scheme")} AS scheme, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                  regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM cut),
parts AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) AS kind,
                 regexp_extract(query, '^([^=&]+)', 1) AS key FROM parsed),
urls AS (SELECT page_id, n, host, path, list_sort(list_transform(list_filter([
            CASE WHEN scheme <> '' THEN 'scheme=' || scheme END,
            CASE WHEN labels[-1] <> '' THEN 'tld=' || labels[-1] END,
            CASE WHEN len(labels) >= 2 THEN 'domain=' || labels[-2] || '.' || labels[-1] END,
            CASE WHEN len(labels) >= 3 THEN 'label=' || labels[1] END,
            CASE WHEN {segment.format(1)} <> '' THEN 'first=' || {segment.format(1)} END,
            CASE WHEN {segment.format(2)} <> '' THEN 'second=' || {segment.format(2)} END,
            CASE WHEN kind <> '' THEN 'type=' || kind END,
            CASE WHEN key <> '' THEN 'key=' || key END], lambda t: t IS NOT NULL), lambda t: replace(t, ' ', '%20'))) AS tokens FROM parts),
fits AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM urls JOIN listed_rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY n),
labelled AS (SELECT tokens, verdict FROM urls JOIN fits USING (n)),
total AS (SELECT count(*) AS n FROM labelled),
common AS (SELECT coalesce((SELECT verdict FROM labelled GROUP BY verdict ORDER BY count(*) DESC, verdict LIMIT 1), 'allow') AS verdict),
subsets AS (SELECT verdict, array_to_string(list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1), ' ') AS rule_id, bit_count(mask) AS size
            FROM (SELECT tokens, verdict, unnest(range(1, 1 << len(tokens))) AS mask FROM labelled)),
counted AS (SELECT rule_id, size, verdict, count(*) AS joint, sum(count(*)) OVER (PARTITION BY rule_id) AS alone FROM subsets GROUP BY rule_id, size, verdict),
rules AS (SELECT rule_id, size, verdict, CAST(joint AS DOUBLE) / alone AS confidence, CAST(joint AS DOUBLE) / n AS support FROM counted, total
          WHERE joint >= ceil({support} * n) AND CAST(joint AS DOUBLE) / alone >= {confidence}),
open_urls AS (SELECT * FROM urls WHERE n NOT IN (SELECT n FROM fits)),
best AS (SELECT u.n, r.verdict, r.rule_id, row_number() OVER (PARTITION BY u.n ORDER BY r.confidence DESC, r.support DESC, r.size DESC, r.rule_id) AS place
         FROM open_urls u JOIN rules r ON list_has_all(u.tokens, string_split(r.rule_id, ' ')))
SELECT page_id, host, path, rule, coalesce(f.verdict, b.verdict, c.verdict) AS verdict, rule_id AS mined
FROM urls LEFT JOIN fits f USING (n) LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (n), common c
"""
