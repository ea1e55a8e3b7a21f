"""All registered queries of the reference operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregates, encodings, evaluation, extensions, joins, profiles, scans, states, streams, windows  # noqa: F401
from .registry import REGISTERED, Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.yearly_skill(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in REGISTERED.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
