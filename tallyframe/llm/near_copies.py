"""Near copies: classes of texts whose SimHash fingerprints link, or whose sets of five-word shingles are alike, complete.

`one_of_each` links texts by the fingerprints and pivot tables of `simhash` first (radius 4). What is left follows exactly, between
the classes so found: all pairs of texts with a Jaccard similarity of 0.8 or more, whose fingerprints may be further apart.
This takes the pivot tables to sets in place of fingerprints: a set's fingerprint is its row of bits over the space of
shingle hashes, and the Hamming distance of two rows is the number of shingles that only one set has. The reference rows
are all unions of CELLS equal slices of that space. The largest difference of two sets' distances to them is the sum,
by slice, of the differences of their counts, so the table needs the counts alone. A pair of similarity s and sizes m, n has
at most (1 - s) / (1 + s) (m + n) shingles apart: pairs beyond it are discarded, and survivors verified on their texts.

Pairs meet by prefix filtering. All shingles have one order, rare ones first. Two sets of similarity s and more share at
least one of the first n - ceil(s n) + 1 shingles of each (n: the set's size); sizes, and the shingles passed before the
shared one, bound the possible overlap. Any order is correct; the counts behind it are of all texts, in a table of hashes.
Where texts meet, they are first linked in stars around one of them, each text to the centre that it meets most often, so
a round takes no more pairs than there are texts. Pairs are made only between the components left.
No step drops a pair that may be similar enough, and there are no caps.

Texts never move as a whole: only those of pairs that passed the table, and those that share a class. Tables of bits of a
fixed size pick them out of the scan; where one fills up, more rows move and the result stays the same.

Defined cases: words are between ASCII spaces, A-Z lower-cased; a text of fewer than five words has one shingle; texts
without words, null ones included, are alike; texts are told apart by 128 bits of hash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, release
from .simhash import RADIUS, SEED, components, fingerprint, link_fingerprints

#: Words of a shingle, and similarity from which on texts link.
SHINGLE, SIMILARITY = 5, 0.8
#: Slices of the space of hashes whose unions are the reference rows: of all texts, and of those whose pairs these leave.
CELLS, FINE_CELLS = 64, 1024
#: Cells of the table of counts that orders shingles.
ORDER_CELLS = 1 << 16
#: Bits of a shingle's hash that texts meet by. Equal bits of different shingles only add pairs to verify.
KEY_BITS = 48
#: Bits of a table that picks rows out of a scan: 8 MB.
PICK_BITS = 1 << 26
#: Rounds of stars before pairs are made.
STARS = 1


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words make one shingle, none make an empty set."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle_hashes; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def shingle_counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """How many texts of rows hold a shingle, by the shingle's hash modulo ORDER_CELLS."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(ORDER_CELLS, dtype=np.int64)
        for batch in batches:
            for t in batch["t"]:
                cells += np.bincount((shingle_hashes(t, shingle) % ORDER_CELLS).astype(np.int64), minlength=ORDER_CELLS)
        at = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": at, "n": cells[at]})

    found = rows.select(F.col("t").cast("binary").alias("t")).mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ORDER_CELLS, dtype=np.int64)
    counts[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def prefix(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set that a set at least so similar must share one of; 0 stands for the empty set."""
    n = len(hashes)
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    order = np.lexsort((hashes, counts[(hashes % len(counts)).astype(np.int64)]))
    return (hashes[order[: n - int(np.ceil(least * n - 1e-9)) + 1]] & np.uint64((1 << KEY_BITS) - 1)).view(np.int64)


def slice_counts(hashes: np.ndarray, cells: int = CELLS) -> bytes:
    """Shingles of a set in each slice of the space, a byte each. Clipping can't raise a difference of two of them."""
    n = np.bincount((hashes >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return np.minimum(n, 255).astype(np.uint8).tobytes()


def profiles(rows: DataFrame, shingle: int, least: float) -> tuple[Column, list[Broadcast]]:
    """struct(size, keys, pos, slices, fp) of column t, and what it reads: of the prefix's shingles those that may be in two rows, and their places."""
    shared = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, shingle))

    @F.pandas_udf("array<long>")
    def prefixes(texts: pd.Series) -> pd.Series:
        return pd.Series([prefix(shingle_hashes(t, shingle), shared.value, least) for t in texts], dtype=object)

    keys = rows.select(F.explode(prefixes(F.col("t").cast("binary"))).alias("key"))
    table = bit_table(keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "key")

    @F.pandas_udf("size int, keys array<long>, pos array<int>, slices binary, fp long")
    def made(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(t, shingle) for t in texts]
        keys = [prefix(s, shared.value, least) for s in sets]
        pos = [np.flatnonzero(in_table(table.value, k)).astype(np.int32) for k in keys]
        return pd.DataFrame({
            "size": np.array([len(s) for s in sets], dtype=np.int32), "keys": [k[at] for k, at in zip(keys, pos, strict=True)], "pos": pos,
            "slices": [slice_counts(s) for s in sets], "fp": np.array([fingerprint(t) for t in texts], dtype=np.int64),
        })

    return made(F.col("t").cast("binary")), [shared, table]


def bit_table(hashes: DataFrame, name: str) -> Broadcast:
    """A table of PICK_BITS bits, set where a hash (long column) of hashes falls; `picked` looks up in it."""
    cell = (F.pmod(name, F.lit(PICK_BITS)) + 1).alias("cell")  # Spark counts bits and buckets from 1
    parts = hashes.select(cell).groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros(PICK_BITS // 8, dtype=np.uint8)
    width = 1 << 12
    for r in parts.toLocalIterator():
        bits[(r["part"] - 1) * width : r["part"] * width] = np.frombuffer(r["bits"], dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def in_table(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes.astype(np.int64) % (8 * len(bits))
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def picked(table: Broadcast, hash: Column) -> Column:
    """Whether the table may hold the hash; false only if it doesn't."""

    @F.pandas_udf("boolean")
    def look(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_table(table.value, hashes.to_numpy()))

    return look(hash)


def numbered(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """i, t and the text's two hashes u, v of docs; a null text counts as empty."""
    rows = docs.select(F.col(id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.select("*", *[h.alias(n) for n, h in zip("uv", text_hashes(F.col("t")), strict=True)])


def text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def row_hash() -> Column:
    return F.xxhash64("u", "v", "i")


def may_link(a: str, b: str, least: float) -> Column:
    """What the sizes and the places of the shared shingle in both orders leave as overlap suffices."""
    most = F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos"))
    sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
    return (most * (1 + least) >= sizes * least - 1e-6) & (F.col(f"{a}.n") != F.col(f"{b}.n"))


def near_by_slices(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those that the pivot table (n, size, slices) of texts leaves."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, sizes: pd.Series) -> pd.Series:
        table = lambda s: np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1).astype(np.int64)
        apart = np.abs(table(x) - table(y)).sum(axis=1)
        return pd.Series(apart <= (1 - least) / (1 + least) * sizes.to_numpy() + 1e-6)

    side = lambda end: texts.select(F.col("n").alias(end), F.col("size").alias(f"size_{end}"), F.col("slices").alias(f"slices_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(near("slices_a", "slices_b", F.col("size_a") + F.col("size_b"))).select(pairs.columns)


def verified(pairs: DataFrame, met: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of pairs (a, b) of met texts those at least so similar; of a text's rows the one of the smallest id is read."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        sets: dict[int, np.ndarray] = {}  # of one batch; texts repeat in it

        def of(n: int, t: bytes) -> np.ndarray:
            if n not in sets:
                sets[n] = shingle_hashes(t, shingle)
            return sets[n]

        return pd.Series([similarity(of(i, s), of(j, t)) for i, j, s, t in zip(a, b, x, y, strict=True)], dtype="float64")

    @F.pandas_udf("size int, slices binary")
    def fine(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_hashes(t, shingle) for t in texts]
        return pd.DataFrame({"size": np.array([len(s) for s in sets], dtype=np.int32), "slices": [slice_counts(s, FINE_CELLS) for s in sets]})

    ends = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    wanted = checkpointed(met.join(ends, "n").select("n", "u", "v", "i"))
    table = bit_table(wanted.select(row_hash().alias("h")), "h")
    few = rows.where(picked(table, row_hash()))
    texts = few.groupBy("u", "v").agg(F.first(F.col("t").cast("binary")).alias("t"))
    texts = checkpointed(wanted.join(texts, ["u", "v"]).select("n", "t", fine("t").alias("p")))
    table.destroy()
    pairs = checkpointed(near_by_slices(pairs, texts.select("n", "p.*"), least))
    both = pairs.join(texts.select(F.col("n").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("n").alias("b"), F.col("t").alias("y")), "b")
    return checkpointed(both.where(alike("a", "b", "x", "y") >= least).select("a", "b"))


def simhash_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of texts (n, fp) whose fingerprints are in one class of `simhash`: each to the smallest of the class."""
    prints = checkpointed(nodes.groupBy("fp").agg(F.count("*").alias("n"), F.min("n").alias("low")))
    classes = checkpointed(prints.select("fp", "low").join(link_fingerprints(prints.select("fp", "n"), radius), "fp"))
    roots = classes.groupBy("comp").agg(F.min("low").alias("b"), F.count("*").alias("prints"))
    shared = classes.join(roots, "comp").select("fp", "b")
    return checkpointed(nodes.select(F.col("n").alias("a"), "fp").join(shared, "fp").where("a <> b").select("a", "b"))


def text_classes(rows: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (see `numbered`): the distinct texts (n, u, v, i: smallest id or null, copies), and n, root of those that link.

    With a radius, texts whose SimHash fingerprints differ in no more bits link first.
    """
    bounded_batches(rows.sparkSession)
    profile, read = profiles(rows, shingle, least)
    made = rows.select("i", "u", "v", profile.alias("p"))
    grouped = made.groupBy("u", "v").agg(F.first("p").alias("p"), F.min("i").alias("i"), F.count("*").alias("copies"))
    nodes = checkpointed(grouped.select(F.monotonically_increasing_id().alias("n"), "u", "v", "i", "copies", "p.*"))
    for table in read:
        table.destroy()
    release(rows.sparkSession)
    met = nodes.where(F.size("pos") > 0).drop("keys", "pos", "copies", "fp")
    placed = nodes.select("n", "size", F.explode(F.arrays_zip("keys", "pos")).alias("at")).select("n", "size", "at.*").withColumnRenamed("keys", "key")
    links = tried = labels = None
    if radius is None:
        placed = placed.withColumn("comp", F.col("n"))
    else:
        links = simhash_links(nodes, radius)
        placed = placed.join(links.withColumnsRenamed({"a": "n", "b": "comp"}), "n", "left").withColumn("comp", F.coalesce("comp", "n"))
    placed = checkpointed(placed)
    release(rows.sparkSession)
    for k in range(STARS + 1):
        # First the text that passed the least of its shingles, then any.
        rank = F.struct(-F.col("pos") / F.greatest("size", F.lit(1)), "n") if k == 0 else F.struct(F.xxhash64("n", F.lit(k)), "n")
        groups = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by(F.struct("n", "size", "pos", "comp"), rank).alias("c"))
        mixed = groups.where("low < high")
        if k < STARS:
            ends = placed.alias("x").join(mixed.select("key", "c.*").alias("y"), "key").where(F.col("x.comp") != F.col("y.comp"))
        else:
            # A bucket within one component stays so.
            placed = checkpointed(placed.join(mixed.select("key"), "key"))
            ends = placed.alias("x").join(placed.alias("y"), "key").where(F.col("x.comp") < F.col("y.comp"))
        met_at = ends.where(may_link("x", "y", least)).select(F.col("x.n").alias("a"), F.col("y.n").alias("b"))
        pairs = met_at.groupBy("a", "b").agg(F.count("*").alias("times")) if k < STARS else met_at.distinct()
        # Pairs that failed need no second look.
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        near = near_by_slices(pairs, met, least)
        if k < STARS:
            near = near.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
        near = checkpointed(near)
        looked = near.union(near.select("b", "a"))
        tried = looked if tried is None else tried.union(looked)
        linked = verified(near, met, rows, shingle, least)
        links = linked if links is None else links.union(linked)
        ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        labels = checkpointed(components(ends, links).select(F.col("fp").alias("n"), F.col("comp").alias("root")))
        if k < STARS:
            left = placed.select("n", "size", "key", "pos").join(mixed.select("key"), "key").join(labels, "n", "left")
            placed = checkpointed(left.select("n", "size", "key", "pos", F.coalesce("root", "n").alias("comp")))
        release(rows.sparkSession)
    return nodes.select("n", "u", "v", "i", "copies"), labels


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs of each class of near copies: of the smallest id (null ids last), then hash of the text, then row.

    Texts link by SimHash, as in `simhash`, and where their fingerprints are further apart by their sets of shingles.
    """
    rows = numbered(docs, id, text)
    nodes, labels = text_classes(rows, radius=RADIUS)
    shared = nodes.join(labels, "n", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "n"))
    least = shared.groupBy("root").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "u", "v")).alias("k"))
    texts = shared.join(least, "root").select("u", "v", F.col("k.i").alias("keep"), ((F.col("k.u") == F.col("u")) & (F.col("k.v") == F.col("v"))).alias("here"))
    texts = checkpointed(texts)
    table = bit_table(texts, "u")
    ids = rows.select("i", "u", "v").where(picked(table, F.col("u"))).groupBy("i", "u", "v").agg(F.count("*").alias("copies")).join(texts, ["u", "v"])
    ids = checkpointed(ids.select(F.col("i").alias("_i"), F.col("u").alias("_u"), F.col("v").alias("_v"), "copies", (F.col("here") & F.col("i").eqNullSafe(F.col("keep"))).alias("stays")))

    u, v = text_hashes(F.coalesce(docs[text], F.lit("")))
    same = (u == F.col("_u")) & (v == F.col("_v")) & docs[id].eqNullSafe(F.col("_i"))
    alone, among = docs.where(~picked(table, u)), docs.where(picked(table, u))
    repeated = ids.where("stays and copies > 1").select("_i", "_u", "_v")
    if repeated.isEmpty():
        return alone.unionByName(among.join(ids.where("not stays").select("_i", "_u", "_v"), same, "left_anti"))
    # Rows that repeat an id and a text: the smallest row.
    other = among.join(ids.where("not stays or copies > 1").select("_i", "_u", "_v"), same, "left_anti")
    single = among.join(repeated, same).groupBy("_i", "_u", "_v").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return alone.unionByName(other).unionByName(single)
