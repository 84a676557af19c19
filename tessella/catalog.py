"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as courses: lines scored, weighted and gated."""
    return plans.g01_g07_g15_module_gate(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
