"""The corpus operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, decontam, htmltext, negatives, quality, repeats, secrets, simhash, topk, toxicity, urltree, warc
from .sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), vocabulary())


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their perplexity and their language's threshold."""
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep_text=False)
    return out.where("verdict.keep").select("doc_id", "lang", F.exp("verdict.log_ppl").alias("perplexity"), F.exp("verdict.threshold").alias("threshold"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge_urls(table(spark, sf_dir, "pages"))


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_dense_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 have a neighbour's label, as a noisy corpus would."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(e.select("vec_id", label.alias("label"), "embedding"))


def op12_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op13_screened_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_html_text, op2_qgram_decontamination, op3_kdtree_topk, op4_forest_secrets, op5_warc_dictionary, op6_suffix_repeats, op7_trie_bpe, op8_kneser_ney_quality, op9_url_templates, op10_covering_simhash, op11_dense_negatives, op12_lexicon_toxicity, op13_screened_centroids)
}

__all__ = ["ORACLES", "QUERIES", "table", "vocabulary"]
