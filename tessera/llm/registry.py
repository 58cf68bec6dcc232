"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from tessera.llm import decontaminate, language, licenses, mixing, near_dedup, ngram, quality, secrets, telephony, toxicity
from tessera.llm.common import table

ORACLE_SQL: dict[str, str] = {}


def _op1(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2(spark, sf_dir):
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op3(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def _op4(spark, sf_dir):
    return telephony.decode(telephony.recordings(table(spark, sf_dir, "documents")))


def _op5(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op6(spark, sf_dir):
    return mixing.copies(table(spark, sf_dir, "documents"))


def _op7(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def _op8(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op9(spark, sf_dir):
    return ngram.score(table(spark, sf_dir, "documents"))


def _op10(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": _op1,
    "op2_toxicity_severity": _op2,
    "op3_language_spans": _op3,
    "op4_telephony_audio": _op4,
    "op5_license_scan": _op5,
    "op6_mixing_to_target_weights": _op6,
    "op7_secret_scan": _op7,
    "op8_benchmark_decontamination": _op8,
    "op9_ngram_language_model": _op9,
    "op10_minhash_near_dedup": _op10,
}
