"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import align, chat, decontaminate, fingerprints, langid, manifest, minhash, ngram_join, packing, repeats, secret_scan, toxicity, warc_store
from evigraph.llm._spark import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archive(read_table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(read_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read_table(spark, sf_dir, "documents"), manifest.lower_tampered())


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_warc_store": op4_warc_store,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_repeats": op9_repeats,
    "op10_secret_scan": op10_secret_scan,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_minhash": op13_minhash,
}
ORACLE_SQL = {
    "op4_warc_store": warc_store.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op10_secret_scan": secret_scan.oracle(),
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_minhash": minhash.ORACLE,
}
