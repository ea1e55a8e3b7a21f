"""State frozen before a season, and empirical-Bayes rates built on it.

Loops over seasons become one aggregation by (keys, season) and a range window over the few seasons of a key. Query
keys without rows in their own season are added with zero counts first, so that older history is not lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import shrink
from .aggregates import last_row
from .quantiles import exact_quantiles


def asof_counters(df: DataFrame, entity: Sequence[str], order: Sequence[str], target: str, n: str = "n", rate: str = "rate", digits: int = 6) -> DataFrame:
    """Earlier rows of the entity and their mean target, as a log would publish them: rounded, null at n = 0."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: F.count(F.lit(1)).over(w), rate: F.round(F.avg(F.col(target)).over(w), digits)})


def season_rows(df: DataFrame, keys: Sequence[str], season: str, sums: dict[str, Column]) -> DataFrame:
    """The values to be summed by before_season(), which combines them in its own aggregation."""
    return df.dropna(subset=list(keys)).select(*keys, season, *[c.alias(name) for name, c in sums.items()])


def season_sums(df: DataFrame, keys: Sequence[str], season: str, sums: dict[str, Column]) -> DataFrame:
    return season_rows(df, keys, season, sums).groupBy(*keys, season).agg(*[F.sum(name).alias(name) for name in sums])


def before_season(sums: DataFrame, wanted: DataFrame | None, keys: Sequence[str], season: str, names: Sequence[str], width: int | None = None) -> DataFrame:
    """Sums over the seasons before each wanted (keys, season), over `width` of them if given; 0 without history.

    Without `wanted`, all (keys, season) of sums are meant. One aggregation and one window over its few rows per key.
    """
    if wanted is None:
        both = sums.select(*keys, season, *names, F.lit(True).alias("_asked"))
    else:
        zero = wanted.select(*keys, season).dropna(subset=list(keys)).select("*", *[F.lit(0).alias(n) for n in names], F.lit(True).alias("_asked"))
        both = sums.select(*keys, season, *names, F.lit(None).cast("boolean").alias("_asked")).unionByName(zero)
    merged = both.groupBy(*keys, season).agg(*[F.sum(n).alias(n) for n in names], F.max("_asked").alias("_asked"))
    w = Window.partitionBy(*keys).orderBy(season).rangeBetween(Window.unboundedPreceding if width is None else -width, -1)
    return merged.select(*keys, season, "_asked", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names]).where("_asked").drop("_asked")


def season_end_state(df: DataFrame, entity: str, season: str, order: Sequence[str], n: str, rates: dict[str, str], target: str | None) -> DataFrame:
    """entity, season, n_end and a count for each rate: the counters at the end of the entity's latest earlier season.

    The last row of that season holds counters before itself; with a target its own event is added (n + 1, count + target),
    without one the counters stay as they stand. 0 for an entity without history.
    """
    counts = {out: F.rint(F.coalesce(F.col(rate), F.lit(0.0)) * F.col(n)) for out, rate in rates.items()}
    if target is not None:
        counts = {out: c + F.col(target) for out, c in counts.items()}
    end = df.withColumns({"n_end": F.col(n) + (0 if target is None else 1), **counts})
    ends = last_row(end, [entity, season], order, "n_end", *rates)
    asked = df.select(entity, season).dropna(subset=[entity]).distinct()
    both = asked.join(ends, [entity, season], "left").withColumn("_state", F.struct("n_end", *rates))
    w = Window.partitionBy(entity).orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    state = F.last("_state").over(w)
    return both.select(entity, season, *[F.coalesce(state[c], F.lit(0)).cast("long").alias(c) for c in ("n_end", *rates)])


def season_to_date(df: DataFrame, state: DataFrame, entity: str, season: str, n: str, rate: str, count_end: str, prior: Column, k: float) -> DataFrame:
    """Counts of the current season by difference of counters, and eight features of them.

    Differences that can't be are invalid and count as no events.
    """
    out = df.join(state, [entity, season], "left")
    dn = F.col(n) - F.coalesce("n_end", F.lit(0))
    ds = F.rint(F.coalesce(F.col(rate), F.lit(0.0)) * F.col(n)) - F.coalesce(count_end, F.lit(0))
    out = out.withColumns({"_dn": dn, "_ds": ds}).withColumn("invalid", ((F.col("_dn") < 0) | (F.col("_ds") < 0) | (F.col("_ds") > F.col("_dn"))).cast("int"))
    good = F.col("invalid") == 0
    out = out.withColumns({"n_season": F.when(good, F.col("_dn")).otherwise(0).cast("long"), "s_season": F.when(good, F.col("_ds")).otherwise(0).cast("long")})
    smooth = shrink(F.col("s_season"), F.col("n_season"), k, prior)
    return out.withColumns({
        "rate_season": smooth, "delta_season": smooth - prior, "log_n": F.log1p("n_season"),
        "zero": (F.col("n_season") == 0).cast("int"), "unseen": (F.coalesce("n_end", F.lit(0)) == 0).cast("int"),
    }).drop("_dn", "_ds")


def prior_before_season(df: DataFrame, season: str, target: str, width: int | None = None, empty: float = 0.5) -> DataFrame:
    """season, prior: the mean target of all earlier rows (or of `width` seasons); `empty` without any.

    A row for each season, to be broadcast: dealt by season, all rows of one would go to one task.
    """
    sums = df.groupBy(season).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    w = Window.orderBy(season).rangeBetween(Window.unboundedPreceding if width is None else -width, -1)
    return F.broadcast(sums.select(season, F.coalesce(F.sum("_s").over(w) / F.sum("_n").over(w), F.lit(empty)).alias("prior")))


def group_prior_before_season(df: DataFrame, groups: Sequence[str], season: str, target: str) -> DataFrame:
    """groups, season, prior: the group's mean target before the season, else the global one."""
    sums = season_rows(df, groups, season, {"_s": F.col(target), "_n": F.lit(1)})
    local = before_season(sums, None, groups, season, ["_s", "_n"])
    return local.join(prior_before_season(df, season, target), season).select(*groups, season, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.col("prior")).alias("prior"))


def history_rates(df: DataFrame, keys: Sequence[str], season: str, target: str, k: float, width: int | None = None, prefix: str = "h") -> DataFrame:
    """df with rate, delta, log_n and unseen of its key before its season, shrunk to the prior before that season."""
    sums = season_rows(df, keys, season, {"_s": F.col(target), "_n": F.lit(1)})
    table = before_season(sums, None, keys, season, ["_s", "_n"], width).join(prior_before_season(df, season, target, width), season)
    rate = shrink(F.col("_s"), F.col("_n"), k, F.col("prior"))
    table = table.select(
        *keys, season, rate.alias(f"{prefix}_rate"), (rate - F.col("prior")).alias(f"{prefix}_delta"),
        F.log1p("_n").alias(f"{prefix}_log_n"), (F.col("_n") == 0).cast("int").alias(f"{prefix}_unseen"),
    )
    return df.join(table, [*keys, season], "left")


def previous_season_deviation(df: DataFrame, keys: Sequence[str], season: str, target: str, k: float, out: str) -> DataFrame:
    """Shrunk rate of the key in the season before, minus that season's mean; null if it has no rows there."""
    league = df.groupBy(season).agg(F.avg(target).alias("_league"))
    table = season_sums(df, keys, season, {"_s": F.col(target), "_n": F.lit(1)}).join(league, season)
    table = table.select(*keys, (F.col(season) + 1).alias(season), (shrink(F.col("_s"), F.col("_n"), k, F.col("_league")) - F.col("_league")).alias(out))
    return df.join(table, [*keys, season], "left")


def leave_one_out(df: DataFrame, target: str, keys: Sequence[str], k: float, prior: Column, out: str, eps: float = 1e-4) -> DataFrame:
    """df with the shrunk rate of the row's group without the row itself, within [eps, 1 - eps]. Null keys make a group.

    Groups are summed in the tasks before the shuffle and joined back, so that a hot group is one row.
    """
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    sums = df.groupBy(*named).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    rate = shrink(F.col("_s") - F.col(target), F.col("_n") - 1, k, prior)
    held = df.join(sums, same).withColumn(out, F.least(F.greatest(rate, F.lit(eps)), F.lit(1 - eps)))
    return held.drop("_s", "_n", *[f"_k{i}" for i in range(len(keys))])


def leave_one_out_hierarchy(df: DataFrame, season: str, target: str, levels: Sequence[tuple[str, Sequence[str], float]], scoring: bool = False) -> DataFrame:
    """Rates along nested keys, each shrunk to the level above.

    Training rows use their own season without themselves; with scoring=True rows use the season before. For each
    level: rate, delta to the parent, reliability, log_n, trusted_delta, post_sd.
    """
    own = F.lit(0) if scoring else F.col(target)
    one = F.lit(0) if scoring else F.lit(1)
    # All levels are summed from the finest cells, and meet the rows in one join; null keys keep their coarser levels.
    cell = [*dict.fromkeys(c for _, keys, _ in levels for c in keys), season]
    sums = df.groupBy(*cell).agg(F.sum(target).alias("_s"), F.count("*").alias("_n"))
    out = sums.select(*cell)
    for i, keys in ((99, []), *((i, keys) for i, (_, keys, _) in enumerate(levels))):
        table = sums.groupBy(*keys, season).agg(F.sum("_s").alias(f"_s{i}"), F.sum("_n").alias(f"_n{i}"))
        out = out.join(table.withColumn(season, F.col(season) + 1) if scoring else table, [*keys, season], "left")
    renamed = out.withColumnsRenamed({c: f"_key_{c}" for c in cell})
    same = [df[c].eqNullSafe(renamed[f"_key_{c}"]) for c in cell]
    out = df.join(renamed, same, "left").drop(*[f"_key_{c}" for c in cell])
    parent = F.when(F.col("_n99") - one > 0, (F.col("_s99") - own) / F.greatest(F.col("_n99") - one, F.lit(1))).otherwise(0.5)
    columns = {}
    for i, (name, keys, k) in enumerate(levels):
        n = F.greatest(F.coalesce(F.col(f"_n{i}"), F.lit(0)) - one, F.lit(0))
        rate = shrink(F.coalesce(F.col(f"_s{i}"), F.lit(0)) - F.when(F.col(f"_n{i}").isNull(), 0).otherwise(own), n, k, parent)
        trust = n / (n + k)
        columns |= {
            f"{name}_rate": rate, f"{name}_delta": rate - parent, f"{name}_reliability": trust, f"{name}_log_n": F.log1p(n),
            f"{name}_trusted_delta": trust * (rate - parent), f"{name}_post_sd": F.sqrt(F.greatest(rate * (1 - rate) / (n + k + 1), F.lit(0.0))),
        }
        out = out.withColumn(f"_rate{i}", rate)
        parent = F.col(f"_rate{i}")
    return out.withColumns(columns).drop(*[f"_{c}{i}" for i in (*range(len(levels)), 99) for c in ("s", "n", "rate")])


def platoon(df: DataFrame, entity: str, cell: str, season: str, target: str, k_entity: float, k_cell: float) -> DataFrame:
    """entity, cell, season: shrunk entity rate before the season and the cell's shrunk residual from it.

    The residual's base changes with the season; sum(y - base) = sum(y) - n * base keeps it a running sum.
    """
    def past(keys: list[str], y: str, n: str) -> DataFrame:
        return before_season(season_rows(df, keys, season, {y: F.col(target), n: F.lit(1)}), None, keys, season, [y, n])

    both = past([entity, cell], "_y", "_n").join(past([entity], "_all_y", "_all_n"), [entity, season]).join(prior_before_season(df, season, target), season)
    base = shrink(F.col("_all_y"), F.col("_all_n"), k_entity, F.col("prior"))
    residual = (F.col("_y") - F.col("_n") * base) / (F.col("_n") + k_cell)
    return both.select(entity, cell, season, base.alias("base"), residual.alias("residual"), F.log1p("_n").alias("log_n"), (F.col("_n") == 0).cast("int").alias("unseen"))


def centred_platoon(df: DataFrame, regime: Sequence[str], cell: Sequence[str], season: str, target: str, k: float, width: int | None = None) -> DataFrame:
    """Residuals from the mean of (season, regime), summed over earlier seasons by cell and shrunk by n + k."""
    means = df.groupBy(season, *regime).agg(F.avg(target).alias("_m"))
    centred = df.join(means, [season, *regime]).withColumn("_r", F.col(target) - F.col("_m"))
    table = before_season(season_rows(centred, cell, season, {"_sum": F.col("_r"), "_n": F.lit(1)}), None, cell, season, ["_sum", "_n"], width)
    return table.select(*cell, season, (F.col("_sum") / (F.col("_n") + k)).alias("residual"), F.col("_n").alias("n"))


def adaptive_state(df: DataFrame, entity: str, season: str, target: str, at: int, low: float = 20.0, high: float = 500.0, cold: float = 120.0) -> DataFrame:
    """entity, prior, k: where an entity stands before season `at` and how much that weighs, by its own drift.

    The drift is the squared change of season effects beyond sampling noise, winsorised, shrunk to the mean of all.
    """
    past = df.where(F.col(season) < at)
    league = past.groupBy(season).agg(F.avg(target).alias("league"))
    w = Window.partitionBy(entity).orderBy(season)
    table = past.groupBy(entity, season).agg(F.sum(target).alias("s"), F.count("*").alias("n")).join(league, season)
    rate = F.col("s") / F.col("n")
    table = table.withColumns({"effect": rate - F.col("league"), "noise": rate * (1 - rate) / F.col("n")})
    table = table.withColumns({"pe": F.lag("effect").over(w), "pv": F.lag("noise").over(w), "pn": F.lag("n").over(w)})
    table = table.withColumn("drift", F.greatest(F.pow(F.col("effect") - F.col("pe"), 2) - F.col("noise") - F.col("pv"), F.lit(0.0)))
    wide = table.where("pe is not null and n >= 100 and pn >= 100")
    cap = exact_quantiles(wide, [], "drift", (0.9,)).select(F.col("quantiles")[0].alias("cap"))
    whole = wide.join(F.broadcast(cap), how="left").agg(F.greatest(F.coalesce(F.avg(F.least("drift", "cap")), F.lit(0.0)), F.lit(1e-6)).alias("g"))
    own = table.where("pe is not null and n >= 30 and pn >= 30").groupBy(entity).agg(F.sum("drift").alias("ds"), F.count("*").alias("dn"))
    latest = table.groupBy(entity).agg(F.max_by(F.struct("effect", "noise", "n"), season).alias("x")).select(entity, "x.*")
    now = league.agg(F.max_by("league", season).alias("m"))
    out = latest.join(own, entity, "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(now))
    drift = F.when(F.col("dn").isNotNull(), F.least(F.greatest((F.col("ds") + 3 * F.col("g")) / (F.col("dn") + 3), F.col("g") / 10), F.col("g") * 10)).otherwise(F.col("g"))
    k = F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.greatest(F.col("noise") + drift, F.lit(1e-9)), F.lit(low)), F.lit(high))
    prior = F.least(F.greatest(F.col("m") + F.col("n") / (F.col("n") + cold) * F.col("effect"), F.lit(0.05)), F.lit(0.95))
    return out.select(entity, prior.alias("prior"), k.alias("k"))


def player_forecast(df: DataFrame, entity: str, season: str, target: str, at: int, decay: float = 0.7) -> DataFrame:
    """Career, last and recent rates, volatility, slope and a forecast for each entity before season `at`."""
    yearly = df.where(F.col(season) < at).groupBy(entity, season).agg(F.avg(target).alias("r"), F.count("*").alias("n"))
    w = F.pow(F.lit(decay), F.lit(at - 1) - F.col(season)) * F.col("n")
    out = yearly.groupBy(entity).agg(
        (F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("career"), F.max_by("r", season).alias("last"), (F.sum(w * F.col("r")) / F.sum(w)).alias("recent"),
        F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("volatility"), F.coalesce(F.regr_slope("r", season), F.lit(0.0)).alias("slope"),
    )
    forecast = 0.5 * F.col("last") + 0.3 * F.col("recent") + 0.2 * F.col("career") + 0.25 * F.col("slope")
    return out.withColumn("forecast", F.least(F.greatest(forecast, F.lit(0.02)), F.lit(0.98)))


def residual_effects(df: DataFrame, key_sets: Sequence[Sequence[str]], residual: str, ks: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, keys, value, k, effect = sum(residual) / (n + k) for each key set and k; all key sets in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit("+".join(ks_)).alias("keys"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("__missing__")) for c in ks_]).alias("value")) for ks_ in key_sets]))
    sums = df.select(*by, each.alias("g"), F.col(residual).alias("_r")).groupBy(*by, "g.keys", "g.value").agg(F.sum("_r").alias("_s"), F.count("*").alias("n"))
    return sums.select(*by, "keys", "value", "n", F.explode(F.array(*[F.lit(float(k)) for k in ks])).alias("k"), "_s").select(*by, "keys", "value", "n", "k", (F.col("_s") / (F.col("n") + F.col("k"))).alias("effect"))


def recent_form(r1: Column, r3: Column, r5: Column, career: Column) -> dict[str, Column]:
    """Weighted recent rate, mean, differences and range of 1-, 3- and 5-game rates, missing ones replaced."""
    known = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in (r1, r3, r5)), F.lit(0))
    total = sum((F.coalesce(r, F.lit(0.0)) for r in (r1, r3, r5)), F.lit(0.0))
    mean = F.when(known > 0, total / F.when(known > 0, known)).otherwise(F.coalesce(career, F.lit(0.5)))
    weighted = 0.5 * F.coalesce(r1, mean) + 0.3 * F.coalesce(r3, mean) + 0.2 * F.coalesce(r5, mean)
    gap = lambda a, b: F.coalesce(a - b, F.lit(0.0))
    span = F.coalesce(F.greatest(r1, r3, r5), mean) - F.coalesce(F.least(r1, r3, r5), mean)
    return {"weighted": weighted, "mean": mean, "d13": gap(r1, r3), "d35": gap(r3, r5), "d15": gap(r1, r5), "range": span, "over_career": gap(weighted, career), "missing": 3 - known}


#: Fixed values of the season boundary: most rows of an open game, least deviation of a game's rows, least variance of
#: events, and the least distance of a rate from 0 and 1.
OPEN_ROWS, LEAST_SPREAD, LEAST_VARIANCE, RATE_MARGIN = 140, 8.0, 4.0, 1e-4


def log_normal_density(x: Column, mean: Column, sd: Column) -> Column:
    """Up to a constant."""
    return -F.pow((x - mean) / sd, 2) / 2 - F.ln(sd)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once a row, however often `use` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def season_boundary(seen: Column, recent: Column, tails: Column, games: Column) -> Column:
    """How far a window of recent games reaches back into the season before, as a posterior over its places.

    seen (n, s) are rows and events of the current season, recent (n, s) those of the window, tails the totals (n, s) of
    the last 1, 2, ... games before the season, games (mean, sd, rate) an entity's rows a game and event rate. If h games
    of the season are complete, the window less the longest fitting tail holds them, and what else was seen is the open
    game. Complete games are normal in rows, with mean h * mean, and binomial in events by a normal approximation; an
    open game longer than the mean is penalised as the upper half of a normal.

    Returns a struct: expected_n and expected_s of the open game, mode (the likeliest h, ties to the smaller) and
    confidence (its probability). Without a possible h, or with nulls, all are 0 and mode is -1.
    """
    spread = F.greatest(games["sd"], F.lit(LEAST_SPREAD))
    rate = F.least(F.greatest(games["rate"], F.lit(RATE_MARGIN)), F.lit(1 - RATE_MARGIN))

    def hypothesis(tail: Column, i: Column) -> Column:
        complete = F.size(tails) - 1 - i
        done_n, done_s = recent["n"] - tail["n"], recent["s"] - tail["s"]
        open_n, open_s = seen["n"] - done_n, seen["s"] - done_s
        possible = done_s.between(F.lit(0), done_n) & open_s.between(F.lit(0), open_n) & (open_n <= OPEN_ROWS) & (recent["n"] > 0) & ((complete > 0) | (done_n == 0))
        rows = log_normal_density(done_n, complete * games["mean"], F.greatest(spread * F.sqrt(complete), F.lit(LEAST_SPREAD)))
        events = log_normal_density(done_s, done_n * rate, F.sqrt(F.greatest(done_n * rate * (1 - rate), F.lit(LEAST_VARIANCE))))
        excess = F.greatest((open_n - games["mean"]) / spread, F.lit(0.0))
        weight = F.when(complete > 0, rows + events).otherwise(0.0) - excess * excess / 2
        return F.struct(F.when(possible, weight).alias("log"), (-complete).alias("rank"), open_n.cast("double").alias("n"), open_s.cast("double").alias("s"))

    grown = lambda sums, h, w: F.struct(*[(sums[c] + w * x).alias(c) for c, x in (("w", F.lit(1.0)), ("n", h["n"]), ("s", h["s"]))])

    def result(known: Column, best: Column, sums: Column) -> Column:
        share = lambda x: F.coalesce(x / F.nullif(sums["w"], F.lit(0.0)), F.lit(0.0))
        return F.struct(share(sums["n"]).alias("expected_n"), share(sums["s"]).alias("expected_s"), F.coalesce(-best["rank"], F.lit(-1)).alias("mode"), share(F.lit(1.0)).alias("confidence"))

    def weighed(known: Column, best: Column) -> Column:
        return F.aggregate(known, F.struct(*[F.lit(0.0).alias(c) for c in "wns"]), lambda sums, h: grown(sums, h, F.exp(h["log"] - best["log"])))

    known = F.filter(F.transform(tails, hypothesis), lambda h: h["log"].isNotNull())
    return once(known, lambda known: once(F.array_max(known), lambda best: once(weighed(known, best), lambda sums: result(known, best, sums))))


def normalised(df: DataFrame, row: Sequence[str], x: Column, out: str) -> DataFrame:
    """x over its sum within the row's keys; equal shares where the sum is 0."""
    w = Window.partitionBy(*row)
    df = df.withColumn("_x", x)
    total = F.sum("_x").over(w)
    return df.withColumn(out, F.when(total > 0, F.col("_x") / total).otherwise(1 / F.count("*").over(w))).drop("_x")


def centred_effect(df: DataFrame, entity: str, cell: Sequence[str], target: str, k: float) -> DataFrame:
    """Shrunk cell mean minus the entity's mean, then minus the count-weighted mean of these in the entity."""
    whole = df.groupBy(entity).agg(F.avg(target).alias("_m"))
    cells = df.groupBy(entity, *cell).agg(F.sum(target).alias("_s"), F.count("*").alias("n")).join(whole, entity)
    cells = cells.withColumn("_e", shrink(F.col("_s"), F.col("n"), k, F.col("_m")) - F.col("_m"))
    w = Window.partitionBy(entity)
    return cells.select(entity, *cell, "n", (F.col("_e") - F.sum(F.col("_e") * F.col("n")).over(w) / F.sum("n").over(w)).alias("effect"))


def consensus(a: Column, b: Column) -> Column:
    """sign(a) * min(|a|, |b|) where the signs agree, else 0."""
    return F.when(F.signum(a) == F.signum(b), F.signum(a) * F.least(F.abs(a), F.abs(b))).otherwise(0.0)
