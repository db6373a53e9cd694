"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelens.llm import alignment, fingerprints, forest, licenses, mixing, negatives, outliers, packing, quality, secrets, suffixes, superkmers, toxicity
from framelens.llm.common import read_table


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.VOCABULARY))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(read_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op5_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.robust_outliers(read_table(spark, sf_dir, "documents"))


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_seen_windows(read_table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path(alignment.BYTE_VOCABULARY), public_tokenizers.path(alignment.PIECE_VOCABULARY))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(spark, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pack_sequences, op2_suffix_array, op3_spot_signatures, op4_mix_sources, op5_factorisation_machine, op6_secret_scan, op7_lsh_forest, op8_toxicity, op9_robust_outliers, op10_super_kmers, op11_license_scan, op12_align_tokenizers, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict:
    return {"op4_mix_sources": mixing.ORACLE, "op11_license_scan": licenses.oracle(), "op13_hard_negatives": negatives.ORACLE}
