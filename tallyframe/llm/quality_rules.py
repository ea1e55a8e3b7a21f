"""Quality rules whose thresholds adapt to language and source, learned from mergeable quantile sketches.

A text's measures are counted in one pass over it. Each measure of a document is a whole number: a share in thousandths.
A sketch of a measure is a table of counts by bin, and sketches merge by adding counts: bins are exact up to 2^SUB_BITS and
from there on 2^(SUB_BITS - 1) to each power of two, so a quantile is off by less than 2^(1 - SUB_BITS) of its value, in
whatever order rows come. There is a sketch for each language, source and measure; those of small groups merge into their
language's, and those of small languages into the whole's. Fences lie FENCE interquartile ranges beyond the quartiles, where a
range counts as no less than the measure's least spread, so that groups that hardly vary drop nothing for trifles. A
document that passes the base rules is kept if all measures lie within the fences of its group.

Defined cases: null texts have no words and fail; null languages and sources are values of their own; repeated rows count as
often as they stand in the table; words are between ASCII spaces; a line counts if it has a word; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rules: fewest words, and largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bins of a sketch: exact below 2^SUB_BITS.
SUB_BITS = 7
#: Interquartile ranges between a quartile and its fence; fewest documents of a group with fences of its own.
FENCE, LEAST_DOCS = 3, 100
#: Groups up to this many are broadcast to the documents; more are joined by salted keys.
BROADCAST_GROUPS, SALTS = 100_000, 16
COUNTED = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Measure:
    """1000 * above div below; spread: the least interquartile range that counts, fixed or in thousandths of the median."""

    name: str
    above: str
    below: str
    spread: int
    relative: bool = False
    lower: bool = False


MEASURES = (
    Measure("word_length", "word_chars", "n_words", 100, relative=True, lower=True),
    Measure("symbols", "n_symbols", "n_words", 50),
    Measure("dup_lines", "n_dup_lines", "n_lines", 150),
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    codes, width = ids, len(known)
    for k in range(1, window):
        if width * len(known) >= 1 << 62:  # rank what has been read so far, so that codes stay exact
            kinds, codes = np.unique(codes, return_inverse=True)
            width = len(kinds)
        codes = codes[:-1] * len(known) + ids[k:]
        width *= len(known)
    _, at, times = np.unique(codes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + window, -1)
    return int((np.cumsum(inside)[:n] > 0).sum())


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of COUNTED for a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = np.count_nonzero((np.frombuffer(b"".join(words), dtype=np.uint8) & 0xC0) != 0x80)  # bytes that begin a code point
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def text_counts(text: Column) -> Column:
    """Struct of COUNTED."""

    @F.pandas_udf(COUNTED)
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_text(t) for t in texts], columns=[c.split()[0] for c in COUNTED.split(", ")], dtype=np.int64)

    return count(text)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measure(m: Measure) -> Column:
    """The measure of a row of counts, 0 where there is nothing to divide by."""
    return F.when(F.col(m.below) > 0, F.expr(f"(1000 * {m.above}) div {m.below}")).otherwise(F.lit(0)).cast("long")


def bin_of(value: Column) -> Column:
    """The smallest value of the value's bin."""
    shift = F.greatest(F.length(F.bin(value)) - SUB_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counted: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """lang, source, measure, bin, n: the sketch of each group. Sketches of parts of a table merge by summing n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), bin_of(measure(m)).alias("bin")) for m in measures])).alias("p")
    return counted.select("lang", "source", pairs).groupBy("lang", "source", "p.measure", "p.bin").agg(F.count("*").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], qs: tuple[float, ...]) -> DataFrame:
    """keys, docs and q0, q1, ...: the bins that hold the ranks floor(q * (docs - 1))."""
    group = Window.partitionBy(*keys)
    run = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "docs": F.sum("n").over(group)})
    at = [F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("docs") - 1)), F.col("bin"))).alias(f"q{i}") for i, q in enumerate(qs)]
    return run.groupBy(*keys).agg(F.max("docs").alias("docs"), *at)


def fences(sketch: DataFrame, measures: tuple[Measure, ...] = MEASURES, fence: int = FENCE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source and an array of (low, high) by measure for each group of a sketch: its own or those it merges into."""
    qs = (0.25, 0.5, 0.75)
    limit = lambda docs, low, high: F.struct(F.col(docs).alias("docs"), F.col(low).alias("low"), F.col(high).alias("high"))

    def limits(level: DataFrame, keys: list[str], name: str) -> DataFrame:
        summed = level.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        found, arms = sketch_quantiles(summed, [*keys, "measure"], qs), []
        for m in measures:
            least = F.expr(f"({m.spread} * q1) div 1000") if m.relative else F.lit(m.spread)
            spread = fence * F.greatest(F.col("q2") - F.col("q0"), least)
            low = F.col("q0") - spread if m.lower else F.lit(None).cast("long")
            arms.append(F.max(F.when(F.col("measure") == m.name, F.struct(F.col("docs"), low.alias("low"), (F.col("q2") + spread).alias("high")))).alias(m.name))
        wide = found.groupBy(*keys).agg(*arms)
        return wide.select(*keys, F.array(*[limit(f"{m.name}.docs", f"{m.name}.low", f"{m.name}.high") for m in measures]).alias(name))

    own = limits(sketch, ["lang", "source"], "own")
    by_lang = checkpointed(sketch.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")))
    langs = limits(by_lang, ["lang"], "by_lang").withColumnRenamed("lang", "_lang")
    whole = limits(by_lang, [], "whole")
    joined = own.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).crossJoin(F.broadcast(whole))  # whole: one row
    enough = lambda name: F.get(name, F.lit(0))["docs"] >= least_docs
    return joined.select("lang", "source", F.when(enough("own"), F.col("own")).when(enough("by_lang"), F.col("by_lang")).otherwise(F.col("whole")).alias("limits"))


def within(counted: DataFrame, limits: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """counted with `within`: whether all measures lie within the limits of the row's group; null where it has none."""
    small = limits.count() <= BROADCAST_GROUPS
    other = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if small:
        joined = counted.join(F.broadcast(other), same, "left")
    else:
        salted = counted.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        other = other.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(other, same & (F.col("_salt") == F.col("_other")), "left").drop("_salt", "_other")
    fits = F.lit(True)
    for i, m in enumerate(measures):
        at = F.get("limits", F.lit(i))
        fits &= measure(m).between(F.coalesce(at["low"], F.lit(0)), at["high"])
    return joined.withColumn("within", fits).drop("_lang", "_source", "limits")


def judge_quality(docs: DataFrame, measures: tuple[Measure, ...] = MEASURES, fence: int = FENCE, least_docs: int = LEAST_DOCS, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """id, lang, source, the counts, base_failed and kept for each row of docs. Thresholds are learned from the rows that pass the base."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col(id).alias("i"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_counts(F.col(text)).alias("c"))
    counted = checkpointed(counted.select("i", "lang", "source", "c.*").withColumn("base_failed", base_failed()))
    sketch = checkpointed(sketches(counted.where("not base_failed"), measures))
    judged = within(counted, checkpointed(fences(sketch, measures, fence, least_docs)), measures)
    kept = ~F.col("base_failed") & F.coalesce("within", F.lit(True))
    return judged.select(F.col("i").alias(id), F.col("lang").alias(lang), F.col("source").alias(source), *[c.split()[0] for c in COUNTED.split(", ")], "base_failed", kept.alias("kept"))


def fence_sql(name: str, keys: str) -> str:
    """Named query of the limits of one level: keys (a list that ends with a comma, or nothing), measure, docs, low, high."""
    arms = lambda f: "CASE measure " + " ".join(f"WHEN '{m.name}' THEN {f(m)}" for m in MEASURES) + " END"
    spread = f"{FENCE} * greatest(q2 - q0, {arms(lambda m: f'({m.spread} * q1) // 1000' if m.relative else m.spread)})"
    place = lambda q: f"min(bin) FILTER (upto > floor({q} * (docs - 1)))"
    return f"""{name}_run AS (
  SELECT {keys} measure, bin, sum(sum(n)) OVER (PARTITION BY {keys} measure ORDER BY bin) AS upto, sum(sum(n)) OVER (PARTITION BY {keys} measure) AS docs
  FROM sketch GROUP BY {keys} measure, bin),
{name}_q AS (SELECT {keys} measure, max(docs) AS docs, {place(0.25)} AS q0, {place(0.5)} AS q1, {place(0.75)} AS q2 FROM {name}_run GROUP BY {keys} measure),
{name} AS (SELECT {keys} measure, docs, {arms(lambda m: f'q0 - {spread}' if m.lower else '0')} AS low, q2 + {spread} AS high FROM {name}_q)"""


VALUE_SQL = ", ".join(f"CASE WHEN {m.below} > 0 THEN (1000 * {m.above}) // {m.below} ELSE 0 END AS {m.name}" for m in MEASURES)

ORACLE_SQL = rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
repeats AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS place FROM twice) GROUP BY r),
counted AS MATERIALIZED (
  SELECT r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * n_words AS base_failed
  FROM texts LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
measured AS MATERIALIZED (SELECT *, {VALUE_SQL} FROM counted),
long_form AS (UNPIVOT (SELECT r, lang, source, base_failed, {", ".join(m.name for m in MEASURES)} FROM measured) ON {", ".join(m.name for m in MEASURES)} INTO NAME measure VALUE v),
shifted AS (SELECT *, CASE WHEN v < {1 << SUB_BITS} THEN 1 ELSE 1::BIGINT << (floor(log2(v))::INTEGER - {SUB_BITS - 1}) END AS unit FROM long_form),
sketch AS MATERIALIZED (SELECT lang, source, measure, (v // unit) * unit AS bin, count(*) AS n FROM shifted WHERE NOT base_failed GROUP BY ALL),
{fence_sql("own", "lang, source,")},
{fence_sql("langs", "lang,")},
{fence_sql("whole", "")},
outside AS (
  SELECT DISTINCT f.r FROM long_form f
  JOIN own o ON f.lang IS NOT DISTINCT FROM o.lang AND f.source IS NOT DISTINCT FROM o.source AND f.measure = o.measure
  JOIN langs l ON f.lang IS NOT DISTINCT FROM l.lang AND f.measure = l.measure JOIN whole w ON f.measure = w.measure
  WHERE CASE WHEN o.docs >= {LEAST_DOCS} THEN v NOT BETWEEN o.low AND o.high WHEN l.docs >= {LEAST_DOCS} THEN v NOT BETWEEN l.low AND l.high
    ELSE v NOT BETWEEN w.low AND w.high END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.r IS NULL AS kept
FROM counted c LEFT JOIN outside o USING (r)
"""
