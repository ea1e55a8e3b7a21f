"""Typed scans and sinks. All paths are read and written by Spark, so they may be in any store it knows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header and, perhaps, a byte order mark; bad values become null. Columns are found by name."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds if f.name in raw.columns]
    if missing := sorted({f.name for f in kinds} - set(raw.columns)):
        raise ValueError(f"missing columns: {missing}")
    out = raw.select(*typed)
    return out.select(*columns) if columns else out


def scan_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def prefix(df: DataFrame, season: str, last: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows up to a season; the filter reaches the Parquet scan."""
    kept = df.where(F.col(season) <= last)
    return kept.select(*columns) if columns else kept


def write_artifact(df: DataFrame, path: str, stage: str, season: int) -> None:
    """Predictions of a stage and season, as a partition of one table."""
    rows = df.withColumns({"stage": F.lit(stage), "season": F.lit(season)})
    rows.write.mode("append").partitionBy("stage", "season").parquet(path)


def scan_artifact(spark: SparkSession, path: str, stage: str, season: int, required: Sequence[str] = ("row_index", "y")) -> DataFrame:
    """Predictions of a stage and season; the partition filter prunes the scan."""
    df = spark.read.parquet(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.where((F.col("stage") == stage) & (F.col("season") == season))


def scan_markdown(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of pipe tables: trimmed cells, without rules and headings."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c"))
    rows = rows.where((F.size("c") == len(columns)) & ~F.col("c")[0].rlike("^:?-+:?$") & (F.col("c")[0] != columns[0]))
    return rows.select(*[F.col("c")[i].alias(n) for i, n in enumerate(columns)])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """An immutable report: an error if the path exists."""
    df.write.mode("errorifexists").parquet(path)


def json_report(df: DataFrame) -> DataFrame:
    """Rows as JSON text; non-finite numbers become null."""
    safe = []
    for f in df.schema:
        c = F.col(f.name)
        finite = F.isnan(c) | (F.abs(c) == float("inf")) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else None
        safe.append((F.when(~finite, c) if finite is not None else c).alias(f.name))
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))
