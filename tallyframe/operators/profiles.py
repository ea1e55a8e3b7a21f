"""Entity profiles of physical measurements: moments, mixes and shrunk deltas, each from one or two aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import shrink
from .aggregates import mixture_moments, pooled_correlation, variance_parts
from .quantiles import exact_quantiles


def simple_profile(df: DataFrame, entity: str, group: str, groups: Sequence[str], metric: str) -> DataFrame:
    """n, mean and deviation of the metric pooled over groups, and the share of each group."""
    shares = df.groupBy(entity).agg(*[F.avg((F.col(group) == g).cast("double")).alias(f"share_{g}") for g in groups])
    return mixture_moments(df, entity, [group], metric).join(shares, entity)


def rich_profile(df: DataFrame, entity: str, group: str, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and deviation of each metric, shares of groups and means by group, in one aggregation."""
    in_group = lambda g: F.col(group) == g
    return df.groupBy(entity).agg(
        F.count("*").alias("n"),
        *[f(m).alias(f"{m}_{s}") for m in metrics for f, s in ((F.avg, "mean"), (F.stddev_samp, "sd"))],
        *[F.avg(in_group(g).cast("double")).alias(f"share_{g}") for g in groups],
        *[F.avg(F.when(in_group(g), F.col(m))).alias(f"{m}_{g}") for m in metrics for g in groups],
    )


def stability_profile(df: DataFrame, entity: str, cell: Sequence[str], group: str, x: str, y: str) -> DataFrame:
    """Within and between variance of x, its correlation with y inside cells, and the entropy of the group mix."""
    parts = variance_parts(df, entity, cell, x)
    r = pooled_correlation(df, entity, cell, x, y)
    counts = df.groupBy(entity, group).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(entity))
    mix = counts.withColumn("_p", p).groupBy(entity).agg(F.sum(-F.col("_p") * F.ln(F.greatest("_p", F.lit(1e-12)))).alias("entropy"))
    return parts.join(r, entity).join(mix, entity)


def group_stability(df: DataFrame, entity: str, group: str, groups: Sequence[str], metric: str) -> DataFrame:
    held = lambda g: F.when(F.col(group) == g, F.col(metric))
    return df.groupBy(entity).agg(*[c for g in groups for c in (F.count(held(g)).alias(f"n_{g}"), F.stddev_samp(held(g)).alias(f"sd_{g}"))])


def cell_deltas(df: DataFrame, entity: str, cell: str, metric: str, k: float) -> DataFrame:
    """Cell mean shrunk to the entity's mean, and its delta."""
    whole = df.groupBy(entity).agg(F.avg(metric).alias("mean"))
    cells = df.groupBy(entity, cell).agg(F.sum(metric).alias("_s"), F.count(metric).alias("n")).join(whole, entity)
    smooth = shrink(F.col("_s"), F.col("n"), k, F.col("mean"))
    return cells.select(entity, cell, "n", smooth.alias("smooth"), (smooth - F.col("mean")).alias("delta"))


def mix_deltas(df: DataFrame, entity: str, cell: str, group: str, groups: Sequence[str], k: float) -> DataFrame:
    """Share of each group in a cell shrunk to the entity's overall share, as deltas."""
    is_ = lambda g: (F.col(group) == g).cast("double")
    whole = df.groupBy(entity).agg(*[F.avg(is_(g)).alias(f"_p{g}") for g in groups])
    cells = df.groupBy(entity, cell).agg(F.count("*").alias("n"), *[F.sum(is_(g)).alias(f"_s{g}") for g in groups]).join(whole, entity)
    return cells.select(entity, cell, "n", *[(shrink(F.col(f"_s{g}"), F.col("n"), k, F.col(f"_p{g}")) - F.col(f"_p{g}")).alias(f"d_{g}") for g in groups])


def trend_profile(recent: DataFrame, long_run: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Recent minus long-run values over the union of entities; null where either side lacks the entity."""
    a, b = recent.select(entity, *columns).alias("a"), long_run.select(entity, *columns).alias("b")
    both = a.join(b, F.col(f"a.{entity}") == F.col(f"b.{entity}"), "full")
    return both.select(F.coalesce(f"a.{entity}", f"b.{entity}").alias(entity), *[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in columns])


def workload_profile(df: DataFrame, entity: str, game: str, order: Sequence[str], tails: Sequence[int], unknown: int = -1) -> DataFrame:
    """Games, mean rows per game and shares of games with at least so many rows; a row `unknown` holds the mean of all."""
    games = df.groupBy(entity, game).agg(F.count("*").alias("_n"))
    facts = [F.count("*").alias("games"), F.avg("_n").alias("mean_rows"), *[F.avg((F.col("_n") >= x).cast("double")).alias(f"tail_{x}") for x in tails]]
    return games.groupBy(entity).agg(*facts).unionByName(games.agg(F.lit(unknown).cast("long").alias(entity), *facts))


def repeatability(df: DataFrame, entity: str, game: str, group: str, metric: str, least: int = 3) -> DataFrame:
    """variance_parts() inside cells of game and group that have at least `least` rows."""
    cells = df.groupBy(entity, game, group).agg(F.count(metric).alias("n"), F.avg(metric).alias("m"), F.var_samp(metric).alias("v")).where(F.col("n") >= least)
    sums = cells.groupBy(entity).agg(F.count("*").alias("cells"), F.sum("n").alias("n"), (F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("within"))
    return sums


def band(x: Column, edges: Sequence[float]) -> Column:
    return sum(((x > e).cast("int") for e in edges), F.lit(0))


def impute_from_cells(df: DataFrame, train: Column, keys: Sequence[str], metric: str, k: float, out: str) -> DataFrame:
    """Expected value of a metric from training cells, shrunk to the training mean; known for any row."""
    rows = df.where(train)
    whole = rows.agg(F.avg(metric).alias("_m"))
    cells = rows.groupBy(*keys).agg(F.sum(metric).alias("_s"), F.count(metric).alias("_n"))
    joined = df.join(cells, list(keys), "left").crossJoin(F.broadcast(whole))
    return joined.withColumn(out, (F.coalesce("_s", F.lit(0.0)) + k * F.col("_m")) / (F.coalesce("_n", F.lit(0)) + k)).drop("_s", "_n", "_m")


def archetypes(table: DataFrame, id: str, columns: Sequence[str], components: int, k: int, seed: int = 7) -> DataFrame:
    """id, archetype, distance and margin to the second nearest, after median imputation, scaling and PCA."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    medians = exact_quantiles(table.select(each.alias("e")).select("e.*"), ["name"], "x", (0.5,)).collect()  # a row a column
    table = table.fillna({r["name"]: r["quantiles"][0] for r in medians})
    steps = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(withMean=True, inputCol="_raw", outputCol="_scaled"), PCA(k=components, inputCol="_scaled", outputCol="_pc"), KMeans(k=k, seed=seed, featuresCol="_pc", predictionCol="archetype"),
    ]
    model = Pipeline(stages=steps).fit(table)
    placed = model.transform(table).withColumn("_v", vector_to_array("_pc"))
    gaps = [F.sqrt(F.aggregate(F.zip_with("_v", F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in model.stages[-1].clusterCenters()]
    near = F.array_sort(F.array(*gaps))
    return placed.select(id, "archetype", near[0].alias("distance"), (near[1] - near[0]).alias("margin"))
