"""One query per numbered operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, decontaminate, importance, jaccard_join, lattice_lm, line_dedup, oracle, packing, prefix_trie, secrets, token_count, token_files, toxicity, url_filters


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is that of the lattice learned from the training rows, in which a word seen there is one more path."""
    scores = lattice_lm.lattice_scores(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("mixed_score").alias("score"), F.col("score").alias("own_score"), "tuned_score")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(_documents(spark, sf_dir)))


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_id_files(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Host, path and verdict of the rules that op12 applies.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_benchmark_leaks, op2_nearest_vectors, op3_toxicity, op4_retrieval_packing, op5_fuzzy_lines, op6_lattice_scores, op7_ngram_jaccard_join, op8_secret_scan, op9_token_id_files, op10_token_counts, op11_prefix_trie, op12_url_filters, op13_importance_resampling)
}

#: DuckDB SQL where SQL can express a query on whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": oracle.PREFIX_TRIE, "op12_url_filters": oracle.url_filters(URL_RULES), "op13_importance_resampling": oracle.IMPORTANCE}
