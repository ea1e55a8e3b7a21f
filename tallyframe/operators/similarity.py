"""Set-similarity join of two logs, and alignment of the sequences of matched groups.

The join finds all pairs of groups whose multisets of states have a Dice similarity of at least a threshold, without making
the pairs of a block. The k-th occurrence of a state in its group is an element, so multisets become sets. All elements have
one order, rare ones first. Two sets of sizes m and n reach the threshold t only with an overlap of t (m + n) / 2, and only if
the smaller has t / (2 - t) of the larger's size; so each shares one of its first n - ceil(t n / (2 - t)) + 1 elements, its
prefix. Pairs meet in prefixes; their sizes and what lies behind the shared element bound the overlap, and the pairs that
this leaves are verified by their counts. An element that many groups share is late in the order and lies in no prefix.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import CARRIED, carried_measures, multiset_dice
from .stored import stored

SLACK = 1e-9

#: Buckets of hashed states whose counts order the states of short groups; a table of so many rows is broadcast.
RANKS = 1 << 16


def elements(rows: DataFrame, group: str, state: str) -> DataFrame:
    """_g, _e: a row for each element (state, number of its occurrence) of each group; null groups and states have none."""
    known = rows.where(F.col(group).isNotNull() & F.col(state).isNotNull())
    counts = known.groupBy(F.col(group).alias("_g"), F.col(state).alias("_state")).agg(F.count("*").alias("_n"))
    return counts.select("_g", "_state", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k")).select("_g", F.struct("_state", "_k").alias("_e"))


def prefixes(rows: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """_g, _e, _pos (from 0), _size: the prefix of each group in the order of the elements' frequency."""
    order = Window.partitionBy("_g").orderBy("_f", "_e")
    placed = rows.join(frequency, "_e").withColumns({"_pos": F.row_number().over(order) - 1, "_size": F.count("*").over(Window.partitionBy("_g"))})
    length = F.col("_size") - F.ceil(F.col("_size") * (least / (2 - least)) - SLACK) + 1
    return placed.where(F.col("_pos") < length).drop("_f")


def similar_candidates(a: DataFrame, b: DataFrame, left: str, right: str, state: str, least: float) -> DataFrame:
    """Distinct pairs (left, right) that may reach the threshold; all that do are among them."""
    if not 0 < least <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    x, y = elements(a, left, state), elements(b, right, state)
    frequency = stored(x.unionByName(y).groupBy("_e").agg(F.count("*").alias("_f")))
    p = prefixes(x, frequency, least).withColumnsRenamed({"_g": left})
    q = prefixes(y, frequency, least).withColumnsRenamed({"_g": right, "_pos": "_pos2", "_size": "_size2"})
    most = F.least(F.col("_size") - F.col("_pos"), F.col("_size2") - F.col("_pos2"))
    return p.join(q, "_e").where(2 * most >= least * (F.col("_size") + F.col("_size2")) - SLACK).select(left, right).distinct()


def ranks(a: DataFrame, b: DataFrame, state: str) -> DataFrame:
    """_bucket, _f: the rows of each of RANKS buckets of hashed states, of both logs. By it frequent states come late; among the
    states of a bucket any order does, so the states need not be counted one by one."""
    return stored(a.select(state).unionByName(b.select(state)).groupBy(bucket(state).alias("_bucket")).agg(F.count("*").alias("_f")))


def bucket(state: str) -> Column:
    return F.pmod(F.xxhash64(state), F.lit(RANKS)).cast("int")


def block_key(block: Sequence[str]) -> Column:
    """Hash of the block columns; null if one of them is, as then the row agrees with none."""
    known = F.lit(True)
    for c in block:
        known &= F.col(c).isNotNull()
    return F.when(known, F.xxhash64(*block))


def carried_prefixes(rows: DataFrame, ranked: DataFrame, group: str, state: str, least: float, block: Sequence[str], end: str) -> DataFrame:
    """A row for each state of the prefix of each group of CARRIED rows at most: with it go the group's states in the common
    order, its counts and its blocks. A group's rows are shuffled once, and what follows from the states is not carried.

    The occurrences of a state are neighbours in that order, so groups that share a later one share the first one before.
    """
    known = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(state).alias("_e"), *([block_key(block).alias("_block")] if block else []))
    small = known.withColumn("_rows", F.count("*").over(Window.partitionBy("_g"))).where(F.col("_rows") <= CARRIED).withColumn("_bucket", bucket("_e"))
    at = F.when(F.col("_e").isNotNull(), F.struct("_f", "_e"))
    one = small.join(F.broadcast(ranked), "_bucket").groupBy("_g").agg(
        F.sort_array(F.collect_list(at)).alias("_all"), F.count("*").alias("_n"), F.max(F.col("_e").isNull()).cast("int").alias("_none"), *([F.collect_set("_block").alias("_blocks")] if block else [])
    )
    one = one.select("*", F.col("_all._e").alias("_states")).where(F.size("_states") > 0)
    length = F.size("_states") - F.ceil(F.size("_states") * (least / (2 - least)) - SLACK) + 1
    kept = ["_states", "_n", "_d", *(["_blocks"] if block else [])]
    one = one.select("_g", "_states", F.col("_n").cast("int").alias("_n"), (F.size(F.array_distinct("_states")) + F.col("_none")).alias("_d"), *kept[3:], length.cast("int").alias("_length"))
    each = one.select(F.col("_g").alias(group), *kept, F.explode(F.array_distinct(F.slice("_states", F.lit(1), F.col("_length")))).alias("_e"))
    return each.withColumnsRenamed({c: f"{c}{end}" for c in kept})


def similar_pairs(a: DataFrame, b: DataFrame, left: str, right: str, state: str, least: float, block: Sequence[str] = ()) -> DataFrame:
    """left, right, dice, jaccard of all pairs with a Dice similarity of at least `least`.

    With block columns, only pairs count of which some rows agree in them. Groups are short as a rule, so the rows of a prefix
    take their group's states along, and a pair is verified where it meets first: pairs are neither shuffled nor counted. Those
    of which a group has more than CARRIED elements go the way of similar_candidates, and join the counts of the candidates
    alone. Sums of counts are whole, so the threshold holds up to rounding.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    ranked = ranks(a, b, state)
    x, y = carried_prefixes(a, ranked, left, state, least, block, ""), carried_prefixes(b, ranked, right, state, least, block, "2")
    before = [F.array_position(c, F.col("_e")).cast("int") - 1 for c in ("_states", "_states2")]
    size = [F.size("_states"), F.size("_states2")]
    most = F.least(size[0] - before[0], size[1] - before[1])
    first = ~F.arrays_overlap(F.slice("_states", F.lit(1), before[0]), F.slice("_states2", F.lit(1), before[1]))
    met = x.join(y, "_e").where(2 * most >= least * (size[0] + size[1]) - SLACK).where(first)
    if block:
        met = met.where(F.arrays_overlap("_blocks", "_blocks2"))
    out = carried_measures(met, left, right).where(F.col("dice") >= least - SLACK)
    large = {g: stored(rows.groupBy(g).agg(F.count("*").alias("_rows")).where(F.col("_rows") > CARRIED).select(g)) for rows, g in ((a, left), (b, right))}
    if all(df.isEmpty() for df in large.values()):
        return out
    pairs = similar_candidates(a, b, left, right, state, least)
    marked = pairs.join(large[left].withColumn("_l", F.lit(True)), left, "left").join(large[right].withColumn("_r", F.lit(True)), right, "left")
    pairs = marked.where("_l or _r").select(left, right)
    if block:
        key = block_key(block)
        of = lambda rows, group, out: rows.groupBy(group).agg(F.collect_set(key).alias(out))
        pairs = pairs.join(of(a, left, "_x"), left).join(of(b, right, "_y"), right).where(F.arrays_overlap("_x", "_y")).drop("_x", "_y")
    more = multiset_dice(a, b, stored(pairs), left, right, state).where(F.col("dice") >= least - SLACK)
    return out.unionByName(more.select(left, right, "dice", "jaccard"))


def best_links(a: DataFrame, b: DataFrame, left: str, right: str, state: str, least: float, margin: float, block: Sequence[str] = ()) -> DataFrame:
    """Pairs of at least `least` that are each other's best by the margin or more over any runner-up of whatever similarity.

    Runner-ups below least - margin can't stand in the way, so the join needs no more than those above.
    """
    from .joins import mutual_best

    near = similar_pairs(a, b, left, right, state, max(least - margin, 1e-6), block)
    return mutual_best(near, left, right, "dice", margin).where(F.col("dice") >= least - SLACK)


def common_subsequence(a: Sequence, b: Sequence, band: int) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence among those with |i - j| <= band: of several, the first in order of places.

    Hunt and Szymanski: each match gets the length of the longest chain that it begins, by search among the chains' starts,
    from the last row to the first. The chain then takes the first match of each length.
    """
    places: dict = {}
    for j, s in enumerate(b):
        places.setdefault(s, []).append(j)
    starts: list[int] = []  # the negated largest start of a chain of each length, ascending
    ranks: list[list[tuple[int, int]]] = []
    for i in range(len(a) - 1, -1, -1):
        js = places.get(a[i], ())
        # Ascending j: a match in the same row must not extend another one of it.
        for j in js[bisect_left(js, i - band) : bisect_left(js, i + band + 1)]:
            k = bisect_left(starts, -j)
            if k == len(starts):
                starts.append(-j)
                ranks.append([])
            else:
                starts[k] = -j
            ranks[k].append((i, j))
    out, last = [], (-1, -1)
    for matches in reversed(ranks):
        last = min(m for m in matches if m[0] > last[0] and m[1] > last[1])
        out.append(last)
    return out


def align_sequences(a: DataFrame, b: DataFrame, pairs: DataFrame, left: str, right: str, order: str, state: str, least: float) -> DataFrame:
    """Rows of matched groups paired along a longest common subsequence of their states.

    left, right, order_a, order_b for the pairs whose ratio 2 * matched / (n1 + n2) is at least `least`. Such a pair leaves
    at most (1 - least) (n1 + n2) rows unmatched, and so matches no rows further apart than that: the search is held to this
    band. Of several longest subsequences the one with the first places is taken. A group's rows form one array, so that
    pairs are spread over the cluster, and null states match nothing.
    """

    def side(rows: DataFrame, key: str, out: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(state).cast("string").alias("s")))).alias(out))

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def matched(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            band = int((1 - least) * (len(p) + len(q)) + 1e-9)
            p, q = [s if s is not None else (0, i) for i, s in enumerate(p)], [s if s is not None else (1, i) for i, s in enumerate(q)]
            found = common_subsequence(p, q, band)
            out.append(found if 2 * len(found) >= least * (len(p) + len(q)) - 1e-9 else [])
        return pd.Series(out, dtype=object)

    both = pairs.select(left, right).join(side(a, left, "_x"), left).join(side(b, right, "_y"), right)
    found = both.select(left, right, F.col("_x.o").alias("_p"), F.col("_y.o").alias("_q"), F.explode(matched("_x.s", "_y.s")).alias("_m"))
    at = lambda many, k: F.get(many, F.col(f"_m.{k}"))
    return found.select(left, right, at("_p", "i").alias("order_a"), at("_q", "j").alias("order_b"))
