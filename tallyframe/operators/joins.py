"""Lookups and joins with contracts. Small sides are left to the planner, which knows their sizes at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join many to one; missing values become the defaults."""
    out = df.join(table.select(*keys, *defaults), list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> None:
    """An error if a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name}: key {twice[0].asDict()} is not unique")


def contracted_join(a: DataFrame, b: DataFrame, keys: Sequence[str], contract: str = "one_to_one") -> DataFrame:
    """Inner join that fails unless the sides are unique as the contract says."""
    if contract not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(contract)
    if contract != "many_to_one":
        assert_unique(a, keys, "left side")
    if contract != "one_to_many":
        assert_unique(b, keys, "right side")
    return a.join(b, list(keys))


def suffixed_join(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Inner join; columns that both sides have get suffixes."""
    shared = (set(a.columns) & set(b.columns)) - set(keys)
    return a.withColumnsRenamed({c: c + left for c in shared}).join(b.withColumnsRenamed({c: c + right for c in shared}), list(keys))


def fallback_lookup(df: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], value: str, out: str, default: float) -> DataFrame:
    """The value of the first table that has the row's key, else the default."""
    names = []
    for i, (table, keys) in enumerate(tables):
        names.append(f"_v{i}")
        df = df.join(table.select(*keys, F.col(value).alias(names[-1])), list(keys), "left")
    return df.withColumn(out, F.coalesce(*map(F.col, names), F.lit(default))).drop(*names)


def grid(df: DataFrame, dims: dict[str, Sequence | None], values: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """All combinations of the dimensions, with values where there are any, else defaults.

    A dimension with None takes the distinct values of df; the others are listed by the caller and so are few.
    """
    keys = list(dims)
    out = df.select(*[k for k, v in dims.items() if v is None]).distinct()
    for k, v in dims.items():
        if v is not None:
            out = out.withColumn(k, F.explode(F.array(*map(F.lit, v))))
    return lookup(out, values, keys, defaults)


def aligned(a: DataFrame, b: DataFrame, key: str, target: str) -> DataFrame:
    """Join two prediction artifacts row by row; an error if rows or targets differ."""
    both = a.join(b.withColumnRenamed(target, "_target"), key, "full")
    bad = both.agg(F.count_if(~F.col(target).eqNullSafe(F.col("_target"))).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} rows are not aligned")
    return a.join(b.drop(target), key)


# Linkage of two event logs that share no key.


def fingerprints(df: DataFrame, group: Sequence[str], state: str, out: str = "print") -> DataFrame:
    """Digest of each group's multiset of states, and its size. States are counted first, so groups stay short."""
    counts = df.groupBy(*group, state).agg(F.count("*").alias("_c"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.col(state).cast("string"), F.col("_c").cast("string"))))
    return counts.groupBy(*group).agg(F.md5(F.array_join(parts, ",")).alias(out), F.sum("_c").alias("size"))


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose sides both occur once."""
    n = lambda k: F.count("*").over(Window.partitionBy(k))
    return pairs.withColumns({"_a": n(a), "_b": n(b)}).where("_a = 1 and _b = 1").drop("_a", "_b")


def zip_rows(a: DataFrame, b: DataFrame, pairs: DataFrame, left: str, right: str, order_a: Sequence, order_b: Sequence) -> DataFrame:
    """Rows of matched groups side by side, by their place in the group."""
    x = a.withColumn("_rn", F.row_number().over(Window.partitionBy(left).orderBy(*order_a)))
    y = b.withColumn("_rn", F.row_number().over(Window.partitionBy(right).orderBy(*order_b)))
    return x.join(pairs.select(left, right), left).join(y, [right, "_rn"]).withColumnRenamed("_rn", "place")


def multiset_dice(a: DataFrame, b: DataFrame, pairs: DataFrame, left: str, right: str, state: str) -> DataFrame:
    """pairs with dice = 2 * shared / (n1 + n2) over multisets and jaccard over sets of states."""
    ca, cb = a.groupBy(left, state).agg(F.count("*").alias("_ca")), b.groupBy(right, state).agg(F.count("*").alias("_cb"))
    shared = pairs.select(left, right).join(ca, left).join(cb, [right, state]).groupBy(left, right).agg(F.sum(F.least("_ca", "_cb")).alias("_s"), F.count("*").alias("_k"))
    na = ca.groupBy(left).agg(F.sum("_ca").alias("_na"), F.count("*").alias("_da"))
    nb = cb.groupBy(right).agg(F.sum("_cb").alias("_nb"), F.count("*").alias("_db"))
    out = pairs.join(shared, [left, right], "left").join(na, left).join(nb, right).na.fill(0, ["_s", "_k"])
    dice = 2 * F.col("_s") / (F.col("_na") + F.col("_nb"))
    jaccard = F.col("_k") / (F.col("_da") + F.col("_db") - F.col("_k"))
    return out.withColumns({"dice": dice, "jaccard": jaccard}).drop("_s", "_k", "_na", "_nb", "_da", "_db")


#: Rows up to which a group's states go along with each of its rows. Larger groups meet without; the result is the same.
CARRIED = 64


def carried(rows: DataFrame, group: str, block: Sequence[str], state: str, end: str) -> DataFrame:
    """A row for each block of each group of CARRIED rows at most: its states, counts, and the hashes of its blocks before this one."""
    names = {c: f"{c}{end}" for c in ("_states", "_n", "_d", "_before")}
    known = F.lit(True)
    for c in block:
        known &= F.col(c).isNotNull()
    at = F.collect_set(F.when(known, F.struct(F.xxhash64(*block).alias("_key"), *block)))
    small = rows.withColumn("_rows", F.count("*").over(Window.partitionBy(group))).where(F.col("_rows") <= CARRIED)
    one = small.groupBy(group).agg(at.alias("_at"), F.collect_list(state).alias("_states"), F.count("*").alias("_n"), F.max(F.col(state).isNull()).alias("_none"))
    one = one.withColumn("_d", F.size(F.array_distinct("_states")) + F.col("_none").cast("int"))
    each = one.select(group, "_states", "_n", "_d", F.col("_at._key").alias("_keys"), F.explode("_at").alias("_here"))
    before = F.filter("_keys", lambda k: k < F.col("_here._key"))
    return each.select(group, "_states", "_n", "_d", before.alias("_before"), *[F.col("_here")[c].alias(c) for c in block]).withColumnsRenamed(names)


def carried_measures(met: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, dice, jaccard of pairs that carry states and counts (_n: rows, _d: distinct states) of both groups."""
    k = F.array_intersect("_states", "_states2")
    of = lambda states, v: F.size(F.filter(states, lambda u: u == v))
    shared = F.aggregate(k, F.lit(0), lambda n, v: n + F.least(of("_states", v), of("_states2", v)))
    once = (F.col("_n") == F.col("_d")) | (F.col("_n2") == F.col("_d2"))
    met = met.select(left, right, "_n", "_n2", "_d", "_d2", F.size(k).alias("_k"), F.when(once, F.size(k)).otherwise(shared).cast("long").alias("_s"))
    whole = F.col(left).isNotNull() & F.col(right).isNotNull()
    dice, jaccard = 2 * F.col("_s") / (F.col("_n") + F.col("_n2")), F.col("_k") / (F.col("_d") + F.col("_d2") - F.col("_k"))
    return met.select(left, right, F.when(whole, dice).alias("dice"), F.when(whole, jaccard).alias("jaccard"))


def pairs_of_blocks(a: DataFrame, b: DataFrame, left: str, right: str, block: Sequence[str]) -> DataFrame:
    """Distinct pairs of groups of which some rows agree in the block columns, by a join of the rows."""
    return a.select(left, *block).join(b.select(right, *block), list(block)).select(left, right).distinct()


def blocked_pairs(a: DataFrame, b: DataFrame, left: str, right: str, block: Sequence[str], state: str) -> DataFrame:
    """Each pair of groups of which some rows agree in the block columns, once, with dice and jaccard as multiset_dice has them.

    Groups are short as a rule, so a row takes its group's states into the join by block, and a pair is whole where it meets:
    it is reported in the first block (by hash) that both share, and pairs are neither shuffled nor counted. Pairs of which a
    group has more than CARRIED rows go the way of pairs_of_blocks and multiset_dice. A null group has null measures.
    """
    x, y = carried(a, left, block, state, ""), carried(b, right, block, state, "2")
    met = x.join(y, list(block)).where(~F.arrays_overlap("_before", "_before2"))
    out = carried_measures(met, left, right)
    large = {g: stored(rows.groupBy(g).agg(F.count("*").alias("_rows")).where(F.col("_rows") > CARRIED).select(g)) for rows, g in ((a, left), (b, right))}
    if all(df.isEmpty() for df in large.values()):
        return out
    split = lambda rows, g: [rows.join(large[g].withColumnRenamed(g, "_g"), F.col(g).eqNullSafe(F.col("_g")), how) for how in ("left_semi", "left_anti")]
    (_, small), (hot, _) = split(a, left), split(b, right)
    pairs = stored(pairs_of_blocks(split(a, left)[0], b, left, right, block).unionByName(pairs_of_blocks(small, hot, left, right, block)))
    whole = F.col(left).isNotNull() & F.col(right).isNotNull()
    more = multiset_dice(a, b, pairs.dropna(), left, right, state).select(left, right, "dice", "jaccard")
    none = pairs.where(~whole).select(left, right, F.lit(None).cast("double").alias("dice"), F.lit(None).cast("double").alias("jaccard"))
    return out.unionByName(more).unionByName(none)


def mutual_best(scored: DataFrame, a: str, b: str, score: str, margin: float) -> DataFrame:
    """Pairs that are each other's best by at least the margin over the runner-up (none counts as 0)."""
    wa, wb = Window.partitionBy(a).orderBy(F.desc(score), b), Window.partitionBy(b).orderBy(F.desc(score), a)
    ahead = lambda w: F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0))
    ranked = scored.withColumns({"_ra": F.row_number().over(wa), "_rb": F.row_number().over(wb), "_ma": ahead(wa), "_mb": ahead(wb)})
    return ranked.where((F.col("_ra") == 1) & (F.col("_rb") == 1) & (F.col("_ma") >= margin) & (F.col("_mb") >= margin)).drop("_ra", "_rb", "_ma", "_mb")


def identity_map(rows: DataFrame, a: str, b: str, purity: float, injective: bool = True) -> DataFrame:
    """For each a the b seen with it most often (ties to the smaller), its share, if at least purity."""
    counts = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    best = counts.groupBy(a).agg(F.sum("n").alias("_total"), F.max(F.struct("n", (-F.col(b)).alias("_neg"), F.col(b).alias("_b"))).alias("_top"))
    out = best.select(a, F.col("_top._b").alias(b), F.col("_top.n").alias("n"), (F.col("_top.n") / F.col("_total")).alias("purity")).where(F.col("purity") >= purity)
    if injective:
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy(b).orderBy(F.desc("n"), a))).where("_k = 1").drop("_k")
    return out


def weighted_quantile(df: DataFrame, value: str, weight: str, q: Sequence[float]) -> DataFrame:
    """Smallest values whose cumulative weight reaches q of the total. df is summed by value first."""
    sums = df.groupBy(value).agg(F.sum(weight).alias("_w"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumns({"_c": F.sum("_w").over(w), "_t": F.sum("_w").over(Window.partitionBy())})
    at = lambda x: F.min(F.when(F.col("_c") >= x * F.col("_t"), F.col(value)))
    return run.agg(*[at(x).alias(f"q{int(100 * x)}") for x in q])


def expand_from_history(queries: DataFrame, history: DataFrame, keys: Sequence[str], entity: str, order: Sequence[str], value: str, n: int) -> DataFrame:
    """Mean of value over up to n evenly spaced history rows of the query's entity, for each distinct key, joined back."""
    from .samples import evenly_spaced

    wanted = queries.select(*keys).distinct()
    sample = evenly_spaced(history.select(entity, *order, value), [entity], order, n)
    means = wanted.join(sample, entity).groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("sampled"))
    return queries.join(means, list(keys), "left")
