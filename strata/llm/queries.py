"""Registered queries of the training-data operators on text; what SQL can state of them is compared with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import leakage, lookalike, mixing, mojibake, reading, truncation
from strata.session import table

NAMES = ["layer_name", "name_unicode"]


def _model(spark: SparkSession, d: str) -> mojibake.Plausibility:
    return mojibake.plausibility(table(spark, d, "layers"), NAMES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "layers"), _model(spark, d)).select("path", "idx", "field")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(table(spark, d, "layers"), _model(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "layers")).select("path", "idx", "field")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "layers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.disguised(table(spark, d, "layers"), table(spark, d, "text_layers"), _model(spark, d)).select("path", "idx", "field")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(lookalike.values_of(table(spark, d, "layers"), table(spark, d, "text_layers")), _model(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(f"run >= {leakage.RUN}").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.items_report(_leaks(spark, d), table(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    return mixing.kept(p7_shares(spark, d))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(p8_levels(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_restored, p4_found, p4_forms, p6_found, p6_leaks, p6_items, p7_mixture, p7_shares, p7_kept, p8_levels, p8_profile)}


def oracle_sql() -> dict[str, str]:
    return {"p7_kept": "SELECT source, true AS within_share, true AS within_repeats FROM mix_targets GROUP BY source"}
