"""Mergeable sketches as state: one HLL and one KLL sketch for each key and season, merged into what lies before a season.

Approximate on purpose, and never in place of the exact operators. The rows are read once; later seasons, coarser keys and
other quantiles come from the sketches, a few kilobytes each. With LG_K = 12 the standard error of a distinct count is
1.04 / 64; with KLL_K = 400 a quantile's rank is off by less than one hundredth with high probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
#: Bounds that tests and queries hold estimates to: four standard errors, and the rank error of a quantile.
DISTINCT_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (LG_K / 2), 0.02


def season_sketches(df: DataFrame, keys: Sequence[str], season: str, counted: str, value: str) -> DataFrame:
    """keys, season, n and the sketches of the distinct values of `counted` and of the distribution of `value`. Nulls don't count."""
    return df.groupBy(*keys, season).agg(F.count("*").alias("n"), F.hll_sketch_agg(counted, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of coarser keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def before_season(sketches: DataFrame, asked: DataFrame, keys: Sequence[str], season: str) -> DataFrame:
    """For each row of asked (keys, season; distinct) the merged sketches of the key's earlier seasons; no row where there are none."""
    earlier = sketches.withColumnRenamed(season, "_before")
    return merged(asked.select(*keys, season).join(earlier, list(keys)).where(F.col("_before") < F.col(season)), [*keys, season])


def read_out(sketches: DataFrame, qs: Sequence[float]) -> DataFrame:
    """sketches with approx_distinct and quantiles (array in the order of qs)."""
    at = [F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(q))) for q in qs]
    return sketches.withColumns({"approx_distinct": F.hll_sketch_estimate("distinct_sketch"), "quantiles": F.array(*at)}).drop("distinct_sketch", "value_sketch")
