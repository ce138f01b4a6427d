"""The registered queries of the training-data operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapse.llm import bpe, decontam, divergence, langid, licenses, line_dedup, lmscore, near_dedup, pii, quality, search, secrets, substring_dedup
from lapse.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; any byte-level BPE file of the tokenizers library will do."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(read(spark, sf_dir, "documents")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.component_ids(read(spark, sf_dir, "documents"), size=4, percent=80).drop("text_hash")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.training_rows(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.license_spans(read(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.pii_spans(read(spark, sf_dir, "documents")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path()))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_line_dedup, op2_secret_scan, op3_near_dedup, op4_quality_rules, op5_language_id, op6_decontamination,
    op7_license_scan, op8_pii, op9_lm_scoring, op10_bpe, op11_substring_dedup, op12_source_divergence, op13_ranked_search)}
#: Decontamination, language identification, licenses, PII's learned part, language models and BPE have no SQL form;
#: tests/llm holds them against brute force, held-out accuracy or an exact round trip.
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op2_secret_scan": secrets.ORACLE,
                           "op3_near_dedup": near_dedup.ORACLE, "op4_quality_rules": quality.ORACLE,
                           "op11_substring_dedup": substring_dedup.ORACLE, "op12_source_divergence": divergence.ORACLE,
                           "op13_ranked_search": search.ORACLE}
