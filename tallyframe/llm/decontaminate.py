"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised (lower case, runs of anything but letters and digits become one space). For an item of m
characters and e allowed edits, a copy with at most e edits shares at least m + 1 - Q * (e + 1) of the item's
character q-grams on diagonals at most e apart. Hits of q-grams are counted in diagonal bands that overlap by e, so
that some band holds them all; bands that reach the bound are aligned within the band, and copies within the budget
are reported. No copy within the budget is missed. The budget is 8 % of an item's characters, but at most what leaves the
bound positive: an item of 13 to 15 characters is allowed no edit. Hits are made and counted in slices along a text, and
a band is closed once the text has passed it, so that memory is bounded by a slice and the open bands of the items.

Defined cases: null and empty texts match nothing; an item of fewer than Q normalised characters has no q-gram and is
reported where it stands exactly, as whole words; one without a letter or digit is never reported; equal items are
reported each under its own id; items without text or id are ignored; documents without an id are reported with a null
id; repeated documents are judged alike; of several copies of an item in one text the one with the fewest edits, then
the first, is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Q = 8
#: Edits allowed per character of an item.
EDIT_RATE = 0.08
#: Characters of benchmark text that are broadcast at once; more items make more passes over the documents.
BLOCK_CHARS = 8 << 20
FILTER_BITS = 22
#: Characters of documents whose q-grams are held at once.
CHUNK_CHARS = 1 << 20
#: Hits of q-grams that are held at once, and cells of the table of shared q-grams that spares texts without a band.
SLICE_HITS, PAIR_CELLS = 1 << 20, 1 << 22
#: 1 for each character of the basic plane that is a letter or digit.
WORD_CHAR = np.fromiter((chr(i).isalnum() for i in range(0x10000)), dtype=bool, count=0x10000)


def normalise(text: str | None) -> str:
    if not text:
        return ""
    points = code_points(text.lower()).copy()
    word = WORD_CHAR[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        word[i] = chr(points[i]).isalnum()
    points[~word] = 32
    word[1:] |= word[:-1].copy()  # the first of a run of separators stays
    return points[word].tobytes().decode("utf-32-le", "surrogatepass").strip()


def budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item of m characters, at most what the lemma's bound leaves positive."""
    return min(int(rate * m), m // q - 1)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 characters from each position on, by doubling."""
    h, span = points.astype(np.uint64), 1
    while span < Q:
        h = h[:-span] * np.uint64(pow(0x9E3779B97F4A7C15, span, 1 << 64)) + h[span:]
        span *= 2
    return h ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class GramIndex:
    ids: list[int]
    texts: list[str]
    hashes: np.ndarray  # sorted, one for each (item, position)
    item: np.ndarray
    position: np.ndarray
    seen: np.ndarray  # filter over the low bits of hashes
    budgets: np.ndarray
    bounds: np.ndarray  # q-grams that a copy shares at least
    short: dict[str, list[int]]  # places in ids and texts of the items without a q-gram, which follow the others


def index_items(items: list[tuple[int, str]]) -> GramIndex:
    known = [(i, n) for i, t in items if (n := normalise(t))]
    known.sort(key=lambda x: len(x[1]) < Q)
    ids, every = [i for i, _ in known], [n for _, n in known]
    texts = [n for n in every if len(n) >= Q]
    short: dict[str, list[int]] = {}
    for k in range(len(texts), len(every)):
        short.setdefault(every[k], []).append(k)
    grams = [gram_hashes(code_points(t)) for t in texts]
    hashes = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(g) for g in grams]).astype(np.int64)
    position = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    seen = np.zeros(1 << FILTER_BITS, dtype=bool)
    seen[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    budgets = np.array([budget(len(t)) for t in texts], dtype=np.int64)
    return GramIndex(ids, every, hashes[order], item[order], position[order], seen, budgets, lengths + 1 - Q * (budgets + 1), short)


def banded_edits(item: str, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """Fewest edits between the item and a stretch of text whose alignment stays on diagonals low to high.

    Returns (edits, start, end) in characters of text; ties go to the earliest end, then the latest start.
    """
    a, b = code_points(item), code_points(text)
    width, m, n = high - low + 1, len(a), len(b)
    far = np.int32(1 << 20)
    lanes = np.arange(width, dtype=np.int32)
    at = lanes + low  # end position in text on each diagonal after 0 characters of the item
    cost = np.where((at >= 0) & (at <= n), 0, far).astype(np.int32)
    start = at.copy()
    for i in range(1, m + 1):
        end = at + i
        inside = (end >= 0) & (end <= n)
        equal = np.zeros(width, dtype=bool)
        ok = (end >= 1) & (end <= n)
        equal[ok] = b[end[ok] - 1] == a[i - 1]
        step = cost + np.where(equal, 0, 1)
        step[~ok] = far
        skip = np.append(cost[1:], far) + 1  # the item's character is missing in the text
        origin = np.where(step <= skip, start, np.append(start[1:], 0))
        best = np.where(inside, np.minimum(step, skip), far)
        key = best - lanes  # characters of the text that the item lacks: from lower diagonals
        reach = np.minimum.accumulate(key)
        source = np.maximum.accumulate(np.where(key == reach, lanes, 0))
        better = reach + lanes < best
        cost = np.minimum(best, reach + lanes)
        start = np.where(better, origin[source], origin)
        cost[~inside] = far
    end = at + m
    k = int(np.lexsort((end, cost))[0])
    return (int(cost[k]), int(start[k]), int(end[k])) if cost[k] < far else None


def candidate_bands(points: np.ndarray, starts: np.ndarray, index: GramIndex) -> np.ndarray:
    """Rows (text, item, band) whose shared q-grams reach the item's bound; points holds the texts end to end."""
    none = np.zeros((0, 3), dtype=np.int64)
    if len(points) < Q or not len(index.hashes):
        return none
    h = gram_hashes(points)
    at = np.flatnonzero(index.seen[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
    left = np.searchsorted(index.hashes, h[at], side="left")
    times = np.searchsorted(index.hashes, h[at], side="right") - left
    at, left, times = at[times > 0], left[times > 0], times[times > 0]
    if not len(at):
        return none
    n, hits = len(index.budgets), np.cumsum(times)
    ends = np.unique(np.append(np.searchsorted(hits, np.arange(SLICE_HITS, hits[-1], SLICE_HITS), side="right"), len(at)))
    slices = [(lo, hi) for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True) if lo < hi]

    def expand(lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Pair of text and item, place in the text and position in the item of the hits of a slice."""
        t = times[lo:hi]
        entry = np.repeat(left[lo:hi] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        text = np.searchsorted(starts, at[lo:hi], side="right") - 1
        return np.repeat(text * n, t) + index.item[entry], np.repeat(at[lo:hi] - starts[text], t), index.position[entry]

    shared = None
    if len(starts) * n <= PAIR_CELLS:  # a text that shares too few q-grams with an item in all has no band
        shared = np.zeros(len(starts) * n, dtype=np.int64)
        for cut in slices:
            shared += np.bincount(expand(*cut)[0], minlength=len(shared))
    open_ = np.zeros((3, 0), dtype=np.int64)  # pair, band, position; each once
    found = [none]
    for k, cut in enumerate(slices):
        pair, place, position = expand(*cut)
        if shared is not None:
            keep = shared[pair] >= index.bounds[pair % n]
            pair, place, position = pair[keep], place[keep], position[keep]
        wide, budgets = 2 * index.budgets[pair % n] + 2, index.budgets[pair % n]
        band = (place - position) // wide
        again = place - position - band * wide < budgets  # also at the end of the band before
        rows = np.stack([np.concatenate([pair, pair[again]]), np.concatenate([band, band[again] - 1]), np.concatenate([position, position[again]])])
        rows = np.concatenate([open_, rows], axis=1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.lexsort(rows[::-1])]
        change = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, np.append(True, change)]  # each q-gram of the item counts once
        pair, band, _ = rows
        closed = np.ones(len(pair), dtype=bool)
        if k + 1 < len(slices):
            budgets, bound = index.budgets[pair % n], index.bounds[pair % n]
            items_grams = bound + Q * (budgets + 1) - Q  # the last position of the item, plus 1
            closed = starts[pair // n] + (band + 1) * (2 * budgets + 2) + budgets + items_grams <= at[cut[1]]
        open_ = rows[:, ~closed]
        pair, band = pair[closed], band[closed]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1]))[: len(pair)])
        count = np.diff(np.append(first, len(pair)))
        good = first[count >= index.bounds[pair[first] % n]]
        found.append(np.stack([pair[good] // n, pair[good] % n, band[good]], axis=1))
    found = np.concatenate(found)
    return found[np.lexsort(found.T[::-1])]


def short_copies(text: str, short: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
    """(item, start) of the first exact place of each short item among the words of a normalised text."""
    at, seen = [i for i, c in enumerate(text) if c == " " or i == 0], set()
    begins = [i + (text[i] == " ") for i in at]
    for b in begins:
        end = b
        while True:
            end = text.find(" ", end + 1)
            stop = len(text) if end < 0 else end
            if stop - b >= Q:
                break
            if (word := text[b:stop]) in short and word not in seen:
                seen.add(word)
                yield from ((item, b) for item in short[word])
            if end < 0:
                break


def find_copies(texts: list[str | None], index: GramIndex) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the best copy of each item in each text; offsets in normalised characters."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    at = 0
    while at < len(texts):
        part, held = [], 0
        while at + len(part) < len(texts) and (not part or held < CHUNK_CHARS):
            part.append(normalise(texts[at + len(part)]))
            held += len(part[-1]) + 1
        joined = "\x00".join(part)
        starts = np.cumsum([0, *[len(t) + 1 for t in part[:-1]]])
        for t, item, band in candidate_bands(code_points(joined), starts, index).tolist():
            e, m, text = int(index.budgets[item]), len(index.texts[item]), part[t]
            low = band * (2 * e + 2) - e
            high = low + 2 * e + 2 + 3 * e
            begin = max(0, low)
            exact = text.find(index.texts[item], begin, high + m + 1)
            found = (0, exact, exact + m) if exact >= 0 else banded_edits(index.texts[item], text[begin : high + m + 1], low - begin, high - begin)
            if found and found[0] <= e:
                hit = found if exact >= 0 else (found[0], found[1] + begin, found[2] + begin)
                best[at + t, item] = min(best.get((at + t, item), hit), hit)
        if index.short:
            best |= {(at + t, item): (0, b, b + len(index.texts[item])) for t, text in enumerate(part) if text for item, b in short_copies(text, index.short)}
        at += len(part)
    return [(t, item, *hit) for (t, item), hit in sorted(best.items())]


def item_blocks(items: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, one block on the driver at a time."""
    block, held = [], 0
    for r in items.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(id, text).orderBy(id, text).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1])
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, edits, first_char, last_char (exclusive) for each item copied in each row of docs. No shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, item_id long, edits int, first_char long, last_char long"
    rows = docs.select(F.col(id).cast("string").alias("doc_id"), F.col(text).alias("t"))  # pandas would make null ids floats
    found = None
    for block in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index_items(block))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                hits = find_copies(pdf["t"].tolist(), index)
                yield pd.DataFrame([(pdf["doc_id"].iat[t], index.ids[i], e, a, b) for t, i, e, a, b in hits], columns=["doc_id", "item_id", "edits", "first_char", "last_char"])

        known = rows.mapInPandas(search, schema.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
        found = known if found is None else found.union(known)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a copy of an item; one pass per block of items."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def holds_copy(shared):
        def copied(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                hit = np.zeros(len(texts), dtype=bool)
                hit[[x[0] for x in find_copies(texts.tolist(), shared.value)]] = True
                yield pd.Series(hit)

        return F.pandas_udf("boolean")(copied)

    for block in item_blocks(items, item_id, item_text):
        docs = docs.where(~holds_copy(spark.sparkContext.broadcast(index_items(block)))(F.col(text)))
    return docs
