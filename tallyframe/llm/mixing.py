"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Each source takes whole passes over its documents plus those whose hash lies below a threshold. The threshold comes
from histograms: sizes are summed by source and hash bucket, the bucket in which the budget runs out is cut into finer
buckets, and so on until it holds one hash. Nothing is sorted but the histograms, and reruns agree.

The hash is of id and text. Rows that share it, equal in both (null ids too), can be a large part of a source: those at the
threshold are split by the hash of a row number, with the same histograms. As they are alike, reruns still agree.

Defined cases: a null text has size 0 and hashes like an empty one; a null source is a source, the last; a null id hashes like
the text `null`; a source of size 0 has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash and of one histogram's buckets.
HASH_BITS, LEVEL_BITS = 60, 12
MAX_REPEATS = 3
#: Sources up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(*parts: Column) -> Column:
    """The first 60 bits of the md5 of the parts as text, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target. sizes has a row for each source.

    Targets share the total by weight, none above `repeats` times its source's size; what is above goes to the others
    by weight. With the sources ordered by cap over weight, those before the first one that can take its share get
    their caps. The windows run over one row for each source.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("double")
    known = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(repeats)).alias("cap"))
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    known = known.select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("spent"), F.sum("w").over(rest).alias("left"),
        F.sum("source_size").over(Window.partitionBy()).cast("double").alias("total"), F.row_number().over(rank).alias("at"),
    )
    able = F.when(F.col("cap") * F.col("left") >= (F.col("total") - F.col("spent")) * F.col("w"), F.struct("at", "spent", "left"))
    known = known.withColumn("first", F.min(able).over(Window.partitionBy()))
    share = (F.col("total") - F.col("first.spent")) * F.col("w") / F.col("first.left")
    return known.select("source", "source_size", F.when(F.col("at") < F.col("first.at"), F.col("cap")).otherwise(F.least("cap", share)).alias("target"))


def meet(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """Join by source, null like any other value."""
    other = per_source.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(other) if small else other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def hash_thresholds(sized: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """source, bound, whole, tied, rest: rows with a hash below bound are taken, and those with bound itself if whole.

    tied: rows that share the bound; rest: what the budget leaves to them.

    sized: source, h, size. budgets: source, budget, less than the source's size.
    """
    open_ = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    shift = HASH_BITS
    while True:
        shift -= LEVEL_BITS
        inside = meet(sized, open_, small).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        grouped = inside.groupBy("source", F.shiftright("h", shift).alias("bucket"))
        sums = grouped.agg(F.sum("size").alias("sum"), F.count("*").alias("tied"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("budget").alias("budget"), F.first("below").alias("below"))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("below") + F.sum("sum").over(order))
        crossing = sums.where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", "sum", "tied", "low", "high", "budget", "upto")).alias("x"))
        found = checkpointed(crossing.select("source", "x.*"))
        if shift == 0 or not found.where("low < high").limit(1).count():
            break
        open_ = found.select("source", "budget", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("sum")).alias("below"))
    rest = F.col("budget") - (F.col("upto") - F.col("sum"))
    return found.select("source", F.col("low").alias("bound"), (F.col("upto") - F.col("budget") < rest).alias("whole"), "tied", rest.alias("rest"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, source, size, source_size, target, taken for each row of docs; taken / size copies of it go into the mix."""
    row = [F.col(id).alias("i"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")]
    key = row_hash(F.coalesce(F.col(id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))
    sized = checkpointed(docs.select(*row, key.alias("h"), F.monotonically_increasing_id().alias("u")))
    sizes = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    small = sizes.count() <= BROADCAST_SOURCES
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = checkpointed(source_targets(sizes, weights, repeats).withColumn("full", full))
    budgets = targets.select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))
    bounds = hash_thresholds(sized.select("source", "h", "size"), budgets, small)
    ties = bounds.where("tied > 1")
    at = ties.select("source", "bound", F.col("rest").alias("budget"))
    if not ties.isEmpty():
        # Of equal rows the threshold takes some, as near to the budget as whole rows come.
        tied = meet(sized.select("source", "h", "u", "size"), at, small).where(F.col("h") == F.col("bound"))
        split = hash_thresholds(tied.select("source", row_hash(F.col("u")).alias("h"), "size"), at.select("source", "budget"), small)
        split = split.select(F.col("source").alias("_t"), F.col("bound").alias("second"), F.col("whole").alias("second_whole"))
        bounds = bounds.join(split, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    else:
        bounds = bounds.withColumns({"second": F.lit(None).cast("long"), "second_whole": F.lit(False)})
    plan = targets.join(bounds.drop("tied", "rest").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    number = F.when(F.col("second").isNotNull() & (F.col("h") == F.col("bound")), row_hash(F.col("u")))
    inside = F.when(F.col("second").isNull(), F.col("whole")).otherwise((number < F.col("second")) | ((number == F.col("second")) & F.col("second_whole")))
    once = F.coalesce((F.col("h") < F.col("bound")) | ((F.col("h") == F.col("bound")) & inside), F.lit(False))
    mixed = meet(sized, plan, small).withColumn("taken", F.col("size") * (F.col("full") + once.cast("long")))
    return mixed.select(F.col("i").alias(id), "source", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, (pos % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM sizes),
ranked AS (
  SELECT *, row_number() OVER r AS n, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (sum(source_size) OVER ())::DOUBLE AS total
  FROM weighed WINDOW r AS (ORDER BY cap / w, source NULLS LAST)),
cut AS (SELECT n, spent, rest FROM ranked WHERE cap * rest >= (total - spent) * w ORDER BY n LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN r.n < c.n THEN cap ELSE least(cap, (total - c.spent) * w / c.rest) END AS target FROM ranked r CROSS JOIN cut c),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, t ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT *, row_number() OVER (PARTITION BY source, h) AS t FROM sized)),
crossing AS (
  SELECT r.source, min((h, t)) AS x FROM placed r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
  WHERE upto > target - whole * source_size GROUP BY r.source)
SELECT s.doc_id, s.size, p.source_size, p.target,
  (s.size * (p.whole + CASE WHEN (s.h, s.t) < c.x THEN 1 WHEN (s.h, s.t) = c.x AND upto - (target - whole * p.source_size) < (target - whole * p.source_size) - (upto - s.size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN crossing c ON s.source IS NOT DISTINCT FROM c.source
"""
