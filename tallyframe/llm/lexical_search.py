"""Ranked lexical search: WAND over shards of documents, whose best are merged.

One pass over the documents packs them into shards of a bounded size, with the postings of terms that any item asks for (a
bit table of a fixed size picks them; a false positive only adds a posting). Counts over all documents give each term its
weight. The items are then searched in blocks of a bounded size: each block is broadcast and visits every shard. In a shard
a term's largest impact bounds what it can add. For each item the cursors of its terms stand at their next documents; in the
order of these the bounds are summed, and the pivot is the first document whose sum reaches the item's threshold, its k-th
best score. Cursors behind the pivot skip to it, and only a pivot whose own terms' bounds reach the threshold is scored. The
items of a block take their steps side by side, in numpy. Thresholds carry over to a task's further shards. No document that
could be among the k best is skipped, those that tie with the k-th included.

A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums w * (10^9 tf div (1000 tf + 8 m)) with
m = 10 + 90 n N div L over the item's terms, once each, in 64-bit integers.

Defined cases: null texts have no terms; documents without terms don't count in N; each row of either table is a document or
an item of its own, so repeated ids have rows of their own; null ids rank behind others of their score; ties go to the
smaller id; documents that score 0 aren't returned; an item without known terms has no rows; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed
from .near_copies import bit_table, in_table

#: Documents and postings of a shard, pairs of item and term in a block of items, and items that step side by side.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_PAIRS, LANES = 4096, 1 << 20, 1 << 18, 256
#: Seed of Spark's xxhash64.
SEED = 42
#: A-Z become a-z, all other ASCII but digits and a-z separates terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PAST = 1 << 31  # behind every document of a shard
SHARD = "docs long, tokens long, terms array<string>, dfs array<int>, ids binary, no_id binary, lengths binary, places binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


@dataclass
class Shard:
    """Postings of a shard in order of term, then document: key is term << 32 | document."""

    ids: np.ndarray
    no_id: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # largest impact of each term


@dataclass
class Block:
    """Items with their terms (numbers in `terms`) and weights, padded with -1 and 0."""

    u: np.ndarray
    item: list[int | None]
    terms: dict[str, int]
    term: list[np.ndarray]
    weight: list[np.ndarray]


def pack_shard(rows: list[tuple[int | None, int, dict[bytes, int]]]) -> dict:
    """A row of SHARD from documents (id, number of terms, counts of the terms that are asked for)."""
    terms = sorted(set().union(*[r[2] for r in rows]))
    number = {t: i for i, t in enumerate(terms)}
    term = np.array([number[t] for r in rows for t in r[2]], dtype=np.int64)
    place = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
    tf = np.array([n for r in rows for n in r[2].values()], dtype=np.int64)
    order = np.argsort(term, kind="stable")
    lengths = np.array([r[1] for r in rows], dtype=np.int64)
    return {
        "docs": int((lengths > 0).sum()), "tokens": int(lengths.sum()), "terms": [t.decode("utf-8", "surrogatepass") for t in terms], "dfs": np.bincount(term, minlength=len(terms)).astype(np.int32),
        "ids": np.array([r[0] or 0 for r in rows], dtype=np.int64).tobytes(), "no_id": np.array([r[0] is None for r in rows]).tobytes(), "lengths": lengths.tobytes(),
        "places": place[order].tobytes(), "tfs": tf[order].tobytes(),
    }


def build_index(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """The shards (SHARD) of docs, with postings of the terms in wanted (term)."""
    table = bit_table(wanted.select(F.xxhash64("term").alias("h")), "h")

    def known(counts: Counter) -> dict[bytes, int]:
        hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in counts], dtype=np.uint64).view(np.int64)
        return {t: n for (t, n), held in zip(counts.items(), in_table(table.value, hashes), strict=True) if held} if counts else {}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, postings = [], 0
        for pdf in batches:
            for i, t in zip(pdf["i"], pdf["t"], strict=True):
                words = terms_of(t)
                rows.append((None if pd.isna(i) else int(i), len(words), known(Counter(words))))
                postings += len(rows[-1][2])
                if len(rows) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield pd.DataFrame([pack_shard(rows)])
                    rows, postings = [], 0
        if rows:
            yield pd.DataFrame([pack_shard(rows)])

    # Ids travel as text, since pandas would turn longs with nulls into doubles.
    shards = checkpointed(docs.select(F.col(id).cast("string").alias("i"), F.col(text).alias("t")).mapInPandas(pack, SHARD))
    table.destroy()
    return shards


def open_shard(row, n_docs: int, n_tokens: int) -> Shard:
    lengths, tf = np.frombuffer(row.lengths, dtype=np.int64), np.frombuffer(row.tfs, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(row.dfs, dtype=np.int64)]).astype(np.int64)
    place = np.frombuffer(row.places, dtype=np.int32).astype(np.int64)
    m = 10 + (90 * lengths * n_docs) // max(1, n_tokens)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place])
    most = np.maximum.reduceat(impact, starts[:-1]) if len(impact) else np.zeros(0, dtype=np.int64)
    keys = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) << 32 | place
    return Shard(np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.no_id, dtype=bool), starts, keys, impact, most)


class Lanes:
    """Items side by side: cursors (place in the postings, document), bounds, thresholds and the best so far."""

    def __init__(self, shard: Shard, term: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int):
        self.shard, self.k = shard, k
        self.lane = np.arange(len(term))
        held = np.where(term >= 0, term, 0)
        self.term, self.weight = term, weight
        self.at = np.where(term >= 0, shard.starts[held], 0)
        self.end = np.where(term >= 0, shard.starts[held + 1], 0)
        self.bound = np.where(term >= 0, weight * shard.most[held], 0)
        self.doc = self.read(self.at, self.end)
        self.least = least.copy()
        self.score = np.zeros((len(term), k), dtype=np.int64)
        self.best = np.full((len(term), k), -1, dtype=np.int64)
        self.scored = 0

    def read(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        keys = self.shard.keys
        return np.where(at < end, keys[np.minimum(at, len(keys) - 1)] & 0xFFFFFFFF, PAST)

    def keep(self, on: np.ndarray) -> None:
        for name in ("lane", "term", "weight", "at", "end", "bound", "doc"):
            setattr(self, name, getattr(self, name)[on])

    def pivots(self) -> np.ndarray:
        """The first document of each item whose terms' bounds, summed in the cursors' order, reach its threshold; else PAST."""
        bits = self.doc.shape[1].bit_length()
        order = np.sort(self.doc << bits | np.arange(self.doc.shape[1]), axis=1)
        upto = np.cumsum(np.take_along_axis(self.bound, order & ((1 << bits) - 1), axis=1), axis=1)
        enough = upto >= self.least[self.lane][:, None]
        first = enough.argmax(axis=1)
        rows = np.arange(len(order))
        return np.where(enough[rows, first], order[rows, first] >> bits, PAST)

    def insert(self, lane: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Put scored documents in place of the items' worst, where they are better."""
        s = self.shard
        held = self.best[lane]
        # Larger is worse: lower score, no id, larger id; an empty place is the worst.
        lowest = self.score[lane].min(axis=1)
        ties = self.score[lane] == lowest[:, None]
        rank = np.where(held < 0, np.inf, s.no_id[held] * 1.0)
        rank = np.where(ties, rank, -np.inf)
        ties &= rank == rank.max(axis=1)[:, None]
        worst = np.where(ties, s.ids[held], np.iinfo(np.int64).min).argmax(axis=1)
        rows = np.arange(len(lane))
        worst = np.where(ties[rows, worst], worst, ties.argmax(axis=1))
        old = held[rows, worst]
        empty = old < 0
        better = (score > lowest) | empty | ((score == lowest) & ((s.no_id[doc] < s.no_id[old]) | ((s.no_id[doc] == s.no_id[old]) & (s.ids[doc] < s.ids[old]))))
        lane, worst, doc, score = lane[better], worst[better], doc[better], score[better]
        self.score[lane, worst], self.best[lane, worst] = score, doc
        self.least[lane] = np.maximum(self.least[lane], self.score[lane].min(axis=1))

    def run(self) -> None:
        while len(self.lane):
            pivot = self.pivots()
            if (pivot == PAST).any():
                self.keep(pivot < PAST)
                pivot = pivot[pivot < PAST]
                if not len(self.lane):
                    return
            row, col = np.nonzero(self.doc < pivot[:, None])
            self.at[row, col] = np.searchsorted(self.shard.keys, self.term[row, col] << 32 | pivot[row])
            self.doc[row, col] = self.read(self.at[row, col], self.end[row, col])
            here = self.doc == pivot[:, None]
            full = (self.bound * here).sum(axis=1) >= self.least[self.lane]
            row, col = np.nonzero(here)
            on = full[row]
            if on.any():
                r, c = row[on], col[on]
                # Sums of integers below 2^53 are exact in doubles.
                score = np.bincount(r, self.weight[r, c] * self.shard.impact[self.at[r, c]], minlength=len(pivot)).astype(np.int64)
                self.scored += int(full.sum())
                good = full & (score >= self.least[self.lane])
                if good.any():
                    self.insert(self.lane[good], pivot[good], score[good])
            self.at[row, col] += 1
            self.doc[row, col] = self.read(self.at[row, col], self.end[row, col])


def search_shard(shard: Shard, terms: list[str], block: Block, least: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """(number of the item in the block, document, score) of the k best of a shard, and how many documents were scored.

    least holds each item's threshold, and rises.
    """
    local = np.full(len(block.terms) + 1, -1, dtype=np.int64)
    for i, t in enumerate(terms):
        if (n := block.terms.get(t)) is not None:
            local[n] = i
    out, scored = [], 0
    if not len(shard.keys):
        return out, scored
    for low in range(0, len(block.u), LANES):
        part = range(low, min(low + LANES, len(block.u)))
        found = [local[block.term[i]] for i in part]
        wide = max(int((f >= 0).sum()) for f in found)
        if wide == 0:
            continue
        term, weight = np.full((len(part), wide), -1, dtype=np.int64), np.zeros((len(part), wide), dtype=np.int64)
        for r, (i, f) in enumerate(zip(part, found, strict=True)):
            on = f >= 0
            term[r, : on.sum()], weight[r, : on.sum()] = f[on], block.weight[i][on]
        lanes = Lanes(shard, term, weight, least[low : low + len(part)], k)
        lanes.run()
        r, c = np.nonzero((lanes.best >= 0) & (lanes.score >= least[low : low + len(part), None]))
        out.append((r + low, lanes.best[r, c], lanes.score[r, c]))
        least[low : low + len(part)] = lanes.least
        scored += lanes.scored
    return out, scored


def item_blocks(items: DataFrame, weights: DataFrame, block_pairs: int) -> Iterator[Block]:
    """Blocks of items (u, item, terms) with the weights (term, w) of their known terms; of some block_pairs pairs each."""
    pairs = items.select("u", "item", F.explode("terms").alias("term")).join(weights, "term")
    grouped = checkpointed(pairs.groupBy("u", "item").agg(F.collect_list(F.struct("term", "w")).alias("pairs")))
    total = grouped.agg(F.sum(F.size("pairs"))).first()[0] or 0
    blocks = max(1, -(-total // block_pairs))
    dealt = grouped.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)))
    for b in range(blocks if total else 0):
        rows = sorted(dealt.where(F.col("block") == b).select("u", "item", "pairs").collect(), key=lambda r: len(r["pairs"]))
        number: dict[str, int] = {}
        term = [np.array([number.setdefault(p["term"], len(number)) for p in r["pairs"]], dtype=np.int64) for r in rows]
        yield Block(np.array([r["u"] for r in rows], dtype=np.int64), [r["item"] for r in rows], number, term, [np.array([p["w"] for p in r["pairs"]], dtype=np.int64) for r in rows])


def lexical_top_k(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item, rank, doc_id, score: the k documents of docs that score highest for each row of items."""
    spark = docs.sparkSession
    bounded_batches(spark)

    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([[t.decode("utf-8", "surrogatepass") for t in dict.fromkeys(terms_of(x))] for x in texts], dtype=object)

    asked = checkpointed(items.select(F.monotonically_increasing_id().alias("u"), F.col(item).cast("long").alias("item"), distinct_terms(F.col(item_text)).alias("terms")))
    shards = build_index(docs, asked.select(F.explode("terms").alias("term")).distinct(), id, text)
    n_docs, n_tokens = (x or 0 for x in shards.agg(F.sum("docs"), F.sum("tokens")).first())
    dfs = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.dfs").alias("df"))
    weights = dfs.select("term", F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).alias("w"))
    found = None
    for block in item_blocks(asked, weights, block_pairs):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            b = shared.value
            least = np.ones(len(b.u), dtype=np.int64)  # scores are above 0
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    shard = open_shard(row, n_docs, n_tokens)
                    hits, _ = search_shard(shard, row.terms, b, least, k)
                    if hits:
                        i, doc, score = (np.concatenate(x) for x in zip(*hits, strict=True))
                        ids = pd.array(shard.ids[doc], dtype="Int64")
                        ids[shard.no_id[doc]] = pd.NA
                        yield pd.DataFrame({"u": b.u[i], "item": pd.array([b.item[x] for x in i], dtype="Int64"), "doc": ids, "score": score})

        hits = shards.mapInPandas(search, "u long, item long, doc long, score long")
        order = Window.partitionBy("u").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        best = checkpointed(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        shared.destroy()
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "u long, item long, doc long, score long, rank int")
    return found.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id), "score")


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS w FROM documents),
facts AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_tokens FROM docs),
postings AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
dfs AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, facts GROUP BY term, n_docs),
items AS MATERIALIZED (SELECT row_number() OVER () AS u, item_id, list_distinct({TERMS_SQL}) AS w FROM benchmark),
pairs AS (SELECT u, item_id, unnest(w) AS term FROM items),
scored AS (
  SELECT u, item_id, d.doc_id, sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_tokens))))::BIGINT AS score
  FROM pairs JOIN dfs f USING (term) JOIN postings p USING (term) JOIN docs d USING (r), facts GROUP BY u, item_id, r, d.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY u ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
