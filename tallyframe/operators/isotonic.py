"""Exact isotonic regression: adjacent violators pooled as a merge of stacks of blocks over ranges of predictions.

Sums by distinct prediction are dealt into ranges of their order, and each task pools its own into a stack of blocks with
rising means. Pooling is associative: the stack of two neighbouring ranges is what pooling makes of their stacks' blocks. So
rounds merge neighbouring ranges, up to FAN at once, wherever a range's last mean isn't below the next one's first, until no
two neighbours are left that violate the order. Nothing is rounded. What travels are blocks, of which 0/1 outcomes of N rows
make N^(2/3) or so at most, as their means are different fractions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import interval_join
from .stored import stored

FAN = 8
BLOCK = ["low", "high", "s", "n"]


def pool(stack: list[list[float]], blocks: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Put blocks (low, high, sum, rows), in order, on a stack with rising means; those that don't rise are pooled."""
    for low, high, s, n in blocks:
        top = [low, high, s, n]
        while stack and stack[-1][2] * top[3] >= top[2] * stack[-1][3]:
            low, _, s, n = stack.pop()
            top = [low, top[1], s + top[2], n + top[3]]
        stack.append(top)
    return stack


def isotonic_blocks(df: DataFrame, y: str, p: str) -> DataFrame:
    """low, high, value, n: the blocks of predictions that share a value, with the rows in them. Null and NaN rows don't count."""
    known = df.select(F.col(p).cast("double").alias("low"), F.col(y).cast("double").alias("y")).where("low is not null and y is not null and not isnan(low) and not isnan(y)")
    sums = known.groupBy("low").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("n"))

    def pool_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list[float]] = []
        part = 0
        for pdf in batches:
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            pool(stack, zip(pdf["low"], pdf["low"], pdf["s"], pdf["n"], strict=True))
        yield pd.DataFrame(stack, columns=BLOCK).assign(part=part)

    def pool_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        return pd.DataFrame(pool([], pdf[BLOCK].itertuples(index=False, name=None)), columns=BLOCK).assign(part=pdf["part"].min())

    schema = "low double, high double, s double, n double, part int"
    ranged = sums.repartitionByRange("low").sortWithinPartitions("low").withColumn("part", F.spark_partition_id())
    blocks = stored(ranged.mapInPandas(pool_task, schema))
    while True:
        ends = blocks.groupBy("part").agg(F.min(F.struct("low", "s", "n")).alias("first"), F.max(F.struct("low", "s", "n")).alias("last")).orderBy("part").collect()  # one row a range
        group, of, size = {}, None, 0
        for before, r in zip([None, *ends], ends, strict=False):
            joins = before is not None and size < FAN and before["last"]["s"] * r["first"]["n"] >= r["first"]["s"] * before["last"]["n"]
            of, size = (of, size + 1) if joins else (r["part"], 1)
            group[r["part"]] = of
        if all(a == b for a, b in group.items()):
            break
        moves = {a: b for a, b in group.items() if a != b}
        target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in moves.items() for x in pair]), F.col("part")), F.col("part"))
        alone = [r["part"] for r in ends if group[r["part"]] == r["part"] and r["part"] not in moves.values()]
        merged = blocks.where(~F.col("part").isin(alone)).withColumn("of", target).groupBy("of").applyInPandas(pool_group, schema)
        blocks = stored(blocks.where(F.col("part").isin(alone)).unionByName(merged))
    return blocks.select("low", "high", (F.col("s") / F.col("n")).alias("value"), F.col("n").cast("long").alias("n"))


def isotonic_fit(df: DataFrame, y: str, p: str) -> DataFrame:
    """p, value for each distinct known prediction."""
    blocks = stored(isotonic_blocks(df, y, p))
    points = df.select(F.col(p).cast("double").alias("p")).where("p is not null and not isnan(p)").distinct().withColumn("_p", F.col("p"))
    return interval_join(points, blocks, ("p", "_p"), ("low", "high")).select("p", "value")
