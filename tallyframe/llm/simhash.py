"""Near-duplicate classes by SimHash fingerprints and pivot distance tables.

Each text becomes a 64-bit fingerprint of its word shingles. Texts with one fingerprint form a class at once, so only
distinct fingerprints are compared. For each of them the Hamming distances to PIVOTS reference fingerprints are
precomputed. Two fingerprints at distance d differ by at most d in every coordinate of this table, so a pair with a
larger difference is discarded, and only the survivors' own distance is computed.

Pairs meet where they agree in all but `radius` of the blocks their bits are cut into (one of the choices must hold
for any pair within the radius). Where many meet, most are linked through the most frequent fingerprint of the bucket
first, and pairs are made only between different components; no link that would join two components is lost.

Defined cases: a text without words has fingerprint 0 and links like any other; null texts count as empty; a null id
never names a component unless all ids in it are null; repeated rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, settled

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
PIVOTS = 16
#: Fingerprints that chance may put into one bucket on average; beyond it the bits are cut into more blocks.
BUCKET = 4


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of the words between ASCII spaces, A-Z lower-cased; signed 64 bits."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        set_bits += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n).view(">i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return F.pandas_udf("long")(each)(text.cast("binary"))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: multiples of an odd constant, spread over the space."""
    return [(i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) for i in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """prints with the Hamming distances to the pivots, a byte each, packed into longs p0, p1, ..."""
    packed = []
    refs = pivots()
    for k in range(0, len(refs), 8):
        cell = F.lit(0).cast("long")
        for i, ref in enumerate(refs[k : k + 8]):
            cell = cell.bitwiseOR(F.shiftleft(F.bit_count(F.col(fp).bitwiseXOR(F.lit(signed(ref)))).cast("long"), 8 * i))
        packed.append(cell.alias(f"p{k // 8}"))
    return prints.select("*", *packed)


def within_pivots(a: str, b: str, radius: int) -> Column:
    """No coordinate of the two pivot tables differs by more than radius."""
    ok = F.lit(True)
    for k in range((PIVOTS + 7) // 8):
        for i in range(min(8, PIVOTS - 8 * k)):
            byte = lambda side: F.shiftrightunsigned(F.col(f"{side}.p{k}"), 8 * i).bitwiseAND(F.lit(255))  # noqa: B023, E731
            ok &= F.abs(byte(a) - byte(b)) <= radius
    return ok


def block_count(n: int, radius: int) -> int:
    """Blocks for n fingerprints: of radius + e blocks a pair agrees in e, that is in about 64 e / (radius + e) bits."""
    e = 2
    while e < 6 and n > BUCKET * 2 ** (BITS * e / (radius + e)):
        e += 1
    return radius + e


def block_masks(blocks: int) -> list[int]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def buckets(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """One row for each choice of blocks that a pair may agree in: the choice and the bits there."""
    choices = [sum(c) for c in combinations(block_masks(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(choices)])
    return prints.select("*", F.explode(keys).alias("key")).select("*", "key.choice", "key.bits").drop("key")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, comp for each vertex (fp): the smallest fp that the edges (a, b) reach.

    Rounds of taking the smallest label among the neighbours, then the label's own label, until nothing changes. Each
    round is written to the checkpoint folder; vertices without edges take no part.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("comp")))
    moved = True
    while moved:  # labels only fall, so this ends
        near = both.join(labels, both["b"] == labels["fp"]).groupBy("a").agg(F.min("comp").alias("m"))
        lower = labels.join(near, labels["fp"] == near["a"]).select("fp", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("fp").alias("comp"), F.col("comp").alias("root"))
        new = settled(lower.join(jump, "comp").select("fp", F.least("comp", "root").alias("comp"), "was"))
        moved = new.where("comp <> was").limit(1).count() > 0
        labels = new.select("fp", "comp")
    return vertices.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def link_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, comp for distinct fingerprints prints (fp, n: texts that have it)."""
    blocks = block_count(prints.count(), radius)
    keyed = buckets(prints.select("fp", "n"), radius, blocks)
    # The most frequent fingerprint of each bucket, as a star's centre; buckets of one are gone.
    centres = keyed.groupBy("choice", "bits").agg(F.count("*").alias("members"), F.max_by("fp", F.struct("n", "fp")).alias("centre")).where("members > 1").drop("members")
    shared = checkpointed(keyed.join(centres, ["choice", "bits"]).select("choice", "bits", "fp", "centre"))
    star = shared.where((F.col("fp") != F.col("centre")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= radius))
    star = checkpointed(star.select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct())
    first = components(prints, star)
    # Buckets that already lie in one component can't join any two.
    marked = shared.select("choice", "bits", "fp").join(first, "fp")
    mixed = marked.groupBy("choice", "bits").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("choice", "bits")
    sides = checkpointed(pivot_table(marked.join(mixed, ["choice", "bits"])))
    pairs = sides.alias("x").join(
        sides.alias("y"),
        (F.col("x.choice") == F.col("y.choice")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.comp") < F.col("y.comp"))
        & within_pivots("x", "y", radius) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius),
    )
    more = pairs.select(F.col("x.comp").alias("a"), F.col("y.comp").alias("b")).distinct()
    joined = components(first.select(F.col("comp").alias("fp")).distinct(), more)
    return first.join(joined.select(F.col("fp").alias("comp"), F.col("comp").alias("root")), "comp").select("fp", F.col("root").alias("comp"))


def near_duplicate_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id of the component) for each row of docs."""
    bounded_batches(docs.sparkSession)
    marked = checkpointed(docs.select(F.col(id).alias("i"), fingerprints(F.col(text), shingle).alias("fp")))
    prints = checkpointed(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("i").alias("first")))
    linked = checkpointed(link_fingerprints(prints, radius).join(prints.select("fp", "first"), "fp"))
    least = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = linked.join(least, "comp").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col("i").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
