"""The registered queries opN_<name> of the subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archlens.llm import contexttree, decontamination, divergence, jaccard, language, oracles, packing, pii, quality, sharding, substrings, suffixes, tokencounts, vectorcodes

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.prefix_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_bloom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op5_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexttree.score(_documents(spark, sf_dir))


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op8_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")


def op10_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op11_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(_documents(spark, sf_dir)))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_nnls_packing": op2_nnls_packing,
    "op3_prefix_counts": op3_prefix_counts,
    "op4_bloom_language": op4_bloom_language,
    "op5_signature_trees": op5_signature_trees,
    "op6_context_tree": op6_context_tree,
    "op7_rendezvous": op7_rendezvous,
    "op8_pigeonhole_edits": op8_pigeonhole_edits,
    "op9_suffix_automata": op9_suffix_automata,
    "op10_suffix_sort": op10_suffix_sort,
    "op11_va_codes": op11_va_codes,
    "op12_deobfuscation": op12_deobfuscation,
    "op13_divergence_audit": op13_divergence_audit,
}

ORACLES: dict[str, str] = {
    "op1_line_frequency": quality.ORACLE,
    "op5_signature_trees": oracles.NEAR_DUPLICATES,
    "op7_rendezvous": sharding.oracle(),
    "op9_suffix_automata": oracles.repeated_words(substrings.WINDOW),
    "op10_suffix_sort": oracles.repeated_bytes(suffixes.WINDOW),
    "op11_va_codes": vectorcodes.oracle(),
    "op13_divergence_audit": divergence.ORACLE,
}
