"""Grouped operators. Group keys that are null form no group unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def mode(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value of each group, ties to the smallest; combined by value before the groups meet."""
    counts = known_keys(df, keys).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    top = counts.groupBy(*keys).agg(F.max("_n").alias("_top"))
    return counts.join(top, list(keys)).where("_n = _top").groupBy(*keys).agg(F.min(value).alias(out))


def shares(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts of each value and its share within the keys (within all rows if there are none)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """Values of each group's last row by a total order; one aggregation, no sort."""
    return known_keys(df, keys).groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each group, with their place from the end (1 is the last)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return known_keys(df, keys).withColumn("from_end", place).where(F.col("from_end") <= n)


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """A column of counts for each listed value; 0 where a group has none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def target_groups(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Count, sum and rate of the target for each single key, all in one pass: key, value, n, s, rate."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    grouped = df.select(each.alias("g"), F.col(target).alias("_y")).groupBy("g.key", "g.value").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
    return grouped.withColumn("rate", F.col("s") / F.col("n"))


def decayed(df: DataFrame, keys: Sequence[str], value: str, season: str, at: int, decay: float) -> DataFrame:
    """Sum and weight of earlier seasons, a season k back weighing decay^(k-1)."""
    w = F.pow(F.lit(decay), F.lit(at - 1) - F.col(season))
    return known_keys(df.where(F.col(season) < at), keys).groupBy(*keys).agg(F.sum(w * F.col(value)).alias("ws"), F.sum(w).alias("w"))


def variance_parts(df: DataFrame, entity: str, cell: Sequence[str], value: str) -> DataFrame:
    """Pooled variance within cells and between their means, and the share within, for each entity."""
    cells = df.groupBy(entity, *cell).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    sums = cells.groupBy(entity).agg(
        F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("v")).alias("ss"), F.sum(F.col("n") - 1).alias("df"),
        F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"),
    )
    within = F.when(F.col("df") > 0, F.col("ss") / F.col("df")).otherwise(0.0)
    between = F.greatest(F.col("nmm") / F.col("n") - F.pow(F.col("nm") / F.col("n"), 2), F.lit(0.0))
    sums = sums.select(entity, "n", within.alias("within"), between.alias("between"))
    total = F.col("within") + F.col("between")
    return sums.withColumn("within_share", F.when(total > 0, F.col("within") / total).otherwise(0.0))


def mixture_moments(df: DataFrame, entity: str, cell: Sequence[str], value: str) -> DataFrame:
    """Mean and deviation of an entity from the moments of its cells (sample variances, missing as 0)."""
    cells = df.groupBy(entity, *cell).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    sums = cells.groupBy(entity).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))).alias("nv"))
    mean = F.col("nm") / F.col("n")
    return sums.select(entity, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("nv") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))


def pooled_correlation(df: DataFrame, entity: str, cell: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of x and y within an entity after the means of its cells are removed.

    Cells are summed first: the centred sums follow from sums and squares, so no row is sorted.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # Values are taken relative to the whole's mean, so that squares keep their digits.
    base = both.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    both = both.crossJoin(F.broadcast(base)).withColumns({"_x": F.col(x) - F.col("_mx"), "_y": F.col(y) - F.col("_my")})
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cells = both.groupBy(entity, *cell).agg(
        F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.sum(F.col("_x") * F.col("_y")).alias("xy")
    )
    sums = cells.groupBy(entity).agg(F.sum(F.col("xy") - sx * sy / n).alias("xy"), F.sum(F.col("xx") - sx * sx / n).alias("xx"), F.sum(F.col("yy") - sy * sy / n).alias("yy"))
    r = F.when((F.col("xx") > 1e-12) & (F.col("yy") > 1e-12), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0)
    return sums.select(entity, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)).alias("r"))


def ellipse(vx: Column, vy: Column, r: Column) -> tuple[Column, Column]:
    """Log area and axis ratio of the covariance ellipse, from the closed-form eigenvalues."""
    cov = r * F.sqrt(vx * vy)
    mid, gap = (vx + vy) / 2, F.sqrt(F.pow((vx - vy) / 2, 2) + cov * cov)
    big, small = F.greatest(mid + gap, F.lit(1e-12)), F.greatest(mid - gap, F.lit(1e-12))
    return F.ln(F.sqrt(big * small)), F.sqrt(big / small)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r, n for all pairs of columns, over the rows where both are there; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[c for k, (a, b) in enumerate(pairs) for c in (F.corr(a, b).alias(f"r{k}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{k}"))])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def gram(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Means of all products of two columns, as g_a_b: enough to score any linear blend of them without the rows."""
    products = [F.avg(F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return (df.groupBy(*keys) if keys else df).agg(F.count("*").alias("n"), *products)


def shift_share(df: DataFrame, entity: str, season: str, target: str, least: int) -> DataFrame:
    """For adjacent seasons the change of the mean, split into change within entities and change of their shares."""
    cell = df.groupBy(entity, season).agg(F.count("*").alias("n"), F.avg(target).alias("m"))
    whole = df.groupBy(season).agg(F.count("*").alias("total"), F.avg(target).alias("mean"))
    now, before = cell.alias("b"), cell.alias("a")
    pairs = now.join(before, (F.col(f"b.{entity}") == F.col(f"a.{entity}")) & (F.col(f"b.{season}") == F.col(f"a.{season}") + 1))
    pairs = pairs.where((F.col("a.n") >= least) & (F.col("b.n") >= least))
    within = pairs.groupBy(F.col(f"b.{season}").alias(season)).agg(F.sum(F.col("b.n") * (F.col("b.m") - F.col("a.m"))).alias("within"))
    next_ = whole.select((F.col(season) + 1).alias(season), F.col("mean").alias("previous"))
    both = whole.join(next_, season).join(within, season, "left")
    change = F.col("mean") - F.col("previous")
    inside = F.coalesce(F.col("within") / F.col("total"), F.lit(0.0))
    return both.select(season, change.alias("change"), inside.alias("within"), (change - inside).alias("composition"))


def nested_deviation(df: DataFrame, parent: Sequence[str], child: Sequence[str], value: str, k: float) -> DataFrame:
    """Child mean minus parent mean, times n / (n + k)."""
    low = known_keys(df, child).groupBy(*child).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    high = known_keys(df, parent).groupBy(*parent).agg(F.avg(value).alias("pm"))
    return low.join(high, list(parent)).select(*child, "n", (F.col("n") / (F.col("n") + k) * (F.col("m") - F.col("pm"))).alias("dev"))


def two_level_contrast(df: DataFrame, entity: str, level: Column, value: str, k: float) -> DataFrame:
    """Mean where level holds minus mean where not, shrunk by the effective count n0 n1 / (n0 + n1)."""
    v = F.col(value)
    sums = known_keys(df, [entity]).groupBy(entity).agg(
        F.count_if(level).alias("n1"), F.count_if(~level).alias("n0"), F.sum(F.when(level, v)).alias("s1"), F.sum(F.when(~level, v)).alias("s0")
    ).where("n0 > 0 and n1 > 0")
    eff = F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))
    return sums.select(entity, eff.alias("n_eff"), (eff / (eff + k) * (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0"))).alias("contrast"))


def profile(df: DataFrame, columns: Sequence[str], target: str, quantiles: Sequence[float]) -> DataFrame:
    """A row for each column: count, missing, mean, sd, min, max, correlation with the target and exact quantiles."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("name"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"),
                F.min(x).alias("low"), F.max(x).alias("high"), F.corr(x, F.col(target).cast("double")).alias("r"),
            )
        )
    moments = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("x")).select("x.*")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*")
    return moments.join(exact_quantiles(values, ["name"], "x", quantiles), "name", "left")


def duplicates(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Groups of equal rows, surplus rows and rows in groups that hold both targets."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"), F.min(target).alias("a"), F.max(target).alias("b"))
    return groups.agg(
        F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
        F.coalesce(F.sum(F.when(F.col("a") < F.col("b"), F.col("n"))), F.lit(0)).alias("conflicting"),
    )


def violations(df: DataFrame, rules: dict[str, Column], id: str, examples: int = 5) -> DataFrame:
    """rule, n, first ids that break it, in order of the id. The counts are one pass; examples are a bounded top."""
    broken = lambda r: ~F.coalesce(r, F.lit(False))
    hits = F.explode(F.array_compact(F.array(*[F.when(broken(rule), F.lit(name)) for name, rule in rules.items()])))
    rows = df.select(hits.alias("rule"), F.col(id).alias("_id"))
    counts = rows.groupBy("rule").agg(F.count("*").alias("n"))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("_id"))).where(F.col("_k") <= examples)
    shown = first.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_id")), lambda x: x.cast("string")), ",").alias("examples"))
    named = df.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    return named.join(counts, "rule", "left").join(shown, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))
