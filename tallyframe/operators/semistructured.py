"""Semi-structured columns: JSON parsed once into VARIANT, typed access by path, and discovery of paths and types.

Malformed JSON parses to null and is counted as malformed; a missing path, or a value that doesn't fit the type asked for,
is null. Discovery goes down `depth` levels; what lies deeper is reported with its container.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MALFORMED = "MALFORMED"


def parsed(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the column's JSON as VARIANT in `out`, null if malformed."""
    return df.withColumn(out, F.try_parse_json(F.col(column)))


def field(variant: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(variant), path, kind)


def discovered_paths(df: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """path, type, n of everything in the column's JSON texts; elements of arrays share the path `[*]`. Null texts don't count."""
    spark = df.sparkSession
    level = df.where(F.col(column).isNotNull()).select(F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v"))
    kind = F.when(F.col("v").isNull(), MALFORMED).otherwise(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))
    out = None
    for at in range(depth + 1):
        typed = level.select("path", kind.alias("type"))
        found = typed.groupBy("path", "type").agg(F.count("*").alias("n"))
        out = found if out is None else out.unionByName(found)
        if at < depth:
            inner = level.where(F.col("v").isNotNull() & kind.isin("OBJECT", "ARRAY")).alias("up")
            parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("up.v").outer()).alias("part"))
            name = F.when(F.col("part.key").isNull(), F.lit("[*]")).otherwise(F.concat(F.lit("."), F.col("part.key")))
            level = parts.select(F.concat("up.path", name).alias("path"), F.col("part.value").alias("v"))
    return out.groupBy("path", "type").agg(F.sum("n").alias("n"))
