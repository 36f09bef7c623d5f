"""The registered corpus queries, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import audit, counts, golay, language, lines, packing, pieces, quotes, resampling, tiling, toxicity, tree, urls
from barline.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_recurrent_score(spark: SparkSession, folder: str) -> DataFrame:
    return language.scored(table(spark, folder, "documents"))


def op2_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.deduplicated(table(spark, folder, "documents"))
    spans = F.array_join(F.transform("deleted", lambda d: F.concat(d["start"].cast("string"), F.lit("+"), d["lines"].cast("string"))), " ")
    n = F.aggregate("deleted", F.lit(0).cast("long"), lambda total, d: total + d["lines"])
    return found.select("doc_id", "n_lines", n.alias("n_deleted"), spans.alias("deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(table(spark, folder, "documents"), PIECES)


def op6_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return tree.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"))


def op8_simhash_golay(spark: SparkSession, folder: str) -> DataFrame:
    found = golay.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", golay.hexadecimal().alias("fingerprint"), "component_id")


def op9_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), PIECES)


def op10_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.linked(table(spark, folder, "conversations"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), WORDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_recurrent_score, op2_string_tiling, op3_line_dedup, op4_toxicity, op5_token_counts, op6_kmeans_tree, op7_url_rules, op8_simhash_golay, op9_piece_encoding, op10_quote_links,
        op11_importance_resampling, op12_filter_audit, op13_best_fit_packing,
    )
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.oracle_sql(), "op7_url_rules": urls.oracle_sql(), "op10_quote_links": quotes.oracle_sql(),
    "op11_importance_resampling": resampling.oracle_sql(), "op12_filter_audit": audit.oracle_sql(),
}
