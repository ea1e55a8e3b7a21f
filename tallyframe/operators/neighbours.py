"""Exact nearest prototypes of the query's own bucket, with pivots and the triangle inequality in place of all pairs.

Of a bucket of n prototypes about sqrt(n) are pivots. Each prototype lies in the cell of its nearest pivot and holds its
distance d to it. A query at distance e from the pivot is at least |e - d| away, so whole cells, and then the rows of a cell,
are left out by the k-th best distance so far, without being compared. Each query first visits its nearest cell, which gives
that distance. Queries near to each other then go in chunks to the pages of the cells that some of them can't leave out, a
bounded number of pages at a time; no row is made for a pair of query and cell. Rows travel as packed pages, blocks and
chunks of a bounded size, dealt by salt where a bucket or a cell is large, and tasks return the k best for each query.

Vectors of a bucket have one length. Equal prototypes of a bucket are held k + 1 times at most (of the smallest ids), which
is all that an answer can name. Null buckets, ids and vectors take no part; queries have ids of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .stored import stored

#: Rows routed at once, rows of a page and of a block of queries, most pivots of a bucket, and rows of pages that a chunk meets at once.
ROUTE_ROWS, PAGE_ROWS, BLOCK_ROWS, MAX_PIVOTS, MEET_ROWS = 4096, 512, 256, 1024, 16384
HASH = 1 << 31


def matrix(packed: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=float).reshape(len(packed), -1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b; near ones are taken from differences, where products would cancel."""
    out = np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))
    scale = np.sqrt((a * a).sum(axis=1).max(initial=0.0) + (b * b).sum(axis=1).max(initial=0.0))
    for i, j in zip(*np.nonzero(out < 1e-6 * scale), strict=True):
        out[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum())
    return out


def salted(rows: DataFrame, counts: DataFrame, keys: Sequence[str], most: int, by: str, out: str) -> DataFrame:
    """rows with a number that deals those of a key into parts of about `most` rows. counts: keys, n."""
    parts = F.ceil(F.col("n") / most)
    return rows.join(counts.select(*keys, "n"), list(keys)).withColumn(out, F.pmod(F.xxhash64(by, F.lit(7)), parts).cast("int")).drop("n")


def packs_of(packs: DataFrame, counts: DataFrame) -> DataFrame:
    """A copy of each bucket's pivots for each part of its rows."""
    parts = F.ceil(F.col("n") / ROUTE_ROWS).cast("int")
    return packs.join(counts.select("b", "n"), "b").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")


def place(rows: pd.DataFrame, pack: pd.DataFrame) -> pd.DataFrame:
    """The cell of each prototype and the distance to its pivot."""
    v = np.array(rows["v"].tolist(), dtype=float)
    to = apart(v, matrix(pack["pivots"].iloc[0]))
    cell = to.argmin(axis=1)
    return pd.DataFrame({"b": rows["b"], "j": rows["j"], "cell": cell.astype(np.int32), "dist": to[np.arange(len(v)), cell], "v": [x.tobytes() for x in v]})


def pack_page(page: pd.DataFrame) -> pd.DataFrame:
    page = page.sort_values(["dist", "j"])
    return pd.DataFrame({"b": page["b"].iloc[:1], "cell": page["cell"].iloc[:1], "js": [page["j"].to_numpy().tobytes()], "dists": [page["dist"].to_numpy().tobytes()], "vs": [b"".join(page["v"])]})


def pack_block(block: pd.DataFrame) -> pd.DataFrame:
    packed = {c: [block[x].to_numpy().tobytes()] for c, x in (("ids", "i"), ("tos", "to"), ("limits", "within"))}
    return pd.DataFrame({"b": block["b"].iloc[:1], "cell": block["cell"].iloc[:1], **packed, "qs": [b"".join(block["q"])]})


def slack(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-9) + 1e-9


def search_page(js, dists, v, ids, to, within, q, k: int) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """(id, prototype, distance) of the page's k best for each query, and how many distances were computed."""
    low, high = np.searchsorted(dists, to - slack(within)), np.searchsorted(dists, to + slack(within), side="right")
    out, computed = [], 0
    for r in range(len(ids)):
        part = slice(low[r], high[r])
        if part.start >= part.stop:
            continue
        far = np.sqrt(((v[part] - q[r]) ** 2).sum(axis=1))
        computed += len(far)
        good = np.flatnonzero((far <= slack(within[r])) & (js[part] != ids[r]))
        best = good[np.lexsort((js[part][good], far[good]))[:k]]
        out.append((np.full(len(best), ids[r]), js[part][best], far[best]))
    return out, computed


def reach(q: np.ndarray, within: np.ndarray, pack: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of queries: distances to the pivots, bounds by these, nearest cell, and which cells (columns) the bounds leave."""
    near, wide = np.array(pack["near"]), np.array(pack["wide"])
    to = apart(q, matrix(pack["pivots"]))
    if to.shape[1] > k:  # pivots are prototypes, and one of them may be the query itself
        within = np.minimum(within, np.partition(to, k, axis=1)[:, k])
    # A cell holds distances from `near` to `wide` of its pivot; an empty one has none.
    least = np.maximum(0.0, np.maximum(to - wide, near - to))
    return to, within, np.where(np.isfinite(wide), to, np.inf).argmin(axis=1), (least <= slack(within)[:, None]) & np.isfinite(wide)


def nearest_cells(queries: DataFrame, packs: DataFrame, kind: str, k: int) -> DataFrame:
    """b, cell, i, q, to, within: each query in its nearest cell."""

    def choose(rows: pd.DataFrame, pack: pd.DataFrame) -> pd.DataFrame:
        if not len(pack) or not len(rows):
            return pd.DataFrame({"b": rows["b"].iloc[:0], "cell": [], "i": [], "q": [], "to": [], "within": []})
        q = np.array(rows["v"].tolist(), dtype=float)
        to, within, cell, _ = reach(q, np.full(len(q), np.inf), pack.iloc[0], k)
        return pd.DataFrame({"b": rows["b"], "cell": cell.astype(np.int32), "i": rows["i"], "q": [x.tobytes() for x in q], "to": to[np.arange(len(q)), cell], "within": within})

    schema = f"b {kind}, cell int, i long, q binary, to double, within double"
    return queries.groupBy("b", "part").cogroup(packs.groupBy("b", "part")).applyInPandas(lambda key, x, y: choose(x, y), schema)


def pack_chunk(rows: pd.DataFrame, pack: pd.DataFrame, k: int) -> pd.DataFrame:
    """A chunk of queries, and the cells that some of them can't leave out."""
    if not len(pack) or not len(rows):
        return pd.DataFrame({"b": rows["b"].iloc[:0], "chunk": [], "part": [], "ids": [], "limits": [], "qs": [], "cells": []})
    q = matrix(rows["q"])
    _, within, _, chosen = reach(q, rows["within"].to_numpy(dtype=float), pack.iloc[0], k)
    return pd.DataFrame({
        "b": rows["b"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1], "ids": [rows["i"].to_numpy(dtype=np.int64).tobytes()],
        "limits": [within.tobytes()], "qs": [q.tobytes()], "cells": [np.flatnonzero(chosen.any(axis=0)).astype(np.int32)],
    }).reset_index(drop=True)


def search_chunk(chunk: pd.Series, pages: pd.DataFrame, k: int) -> pd.DataFrame:
    """i, j, dist: the k best rows of the pages for each query of the chunk. Bounds narrow from page to page."""
    ids, limits = np.frombuffer(chunk["ids"], dtype=np.int64), np.frombuffer(chunk["limits"], dtype=float).copy()
    q = np.frombuffer(chunk["qs"], dtype=float).reshape(len(ids), -1)
    best_r, best_j, best_d = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    norms = (q * q).sum(axis=1)
    for page in pages.itertuples(index=False):
        js = np.frombuffer(page.js, dtype=np.int64)
        v = np.frombuffer(page.vs, dtype=float).reshape(len(js), -1)
        wide = (v * v).sum(axis=1)
        # Products pick the candidates, with room for their rounding; distances are taken from differences.
        square = norms[:, None] + wide[None, :] - 2 * q @ v.T
        room = 1e-12 * (norms.max(initial=0.0) + wide.max(initial=0.0)) * q.shape[1]
        r, c = np.nonzero((square <= (slack(limits) ** 2)[:, None] + room) & (ids[:, None] != js[None, :]))
        far = np.concatenate([np.zeros(0), *[np.sqrt(((v[c[at : at + 65536]] - q[r[at : at + 65536]]) ** 2).sum(axis=1)) for at in range(0, len(r), 65536)]])
        good = far <= slack(limits[r])
        rs, jj, dd = np.concatenate([best_r, r[good]]), np.concatenate([best_j, js[c[good]]]), np.concatenate([best_d, far[good]])
        order = np.lexsort((jj, dd, rs))
        rs, jj, dd = rs[order], jj[order], dd[order]
        rank = np.arange(len(rs)) - np.searchsorted(rs, rs)
        kth = rank == k - 1
        limits[rs[kth]] = np.minimum(limits[rs[kth]], dd[kth])
        best_r, best_j, best_d = rs[rank < k], jj[rank < k], dd[rank < k]
    return pd.DataFrame({"i": ids[best_r], "j": best_j, "dist": best_d})


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_prototypes(queries: DataFrame, prototypes: DataFrame, bucket: str, id: str, other: str, vector: str, k: int) -> DataFrame:
    """The k prototypes of the query's own bucket that are nearest by Euclidean distance: id, other, dist, rank.

    A prototype is never its own neighbour; ties go to the smaller prototype.
    """
    kind = dict(prototypes.dtypes)[bucket]
    named = lambda df, key, out: df.select(F.col(bucket).alias("b"), F.col(key).cast("long").alias(out), F.col(vector).cast("array<double>").alias("v")).where(f"b is not null and {out} is not null and v is not null")
    few = F.row_number().over(Window.partitionBy("b", "v").orderBy("j"))
    protos = stored(named(prototypes, other, "j").withColumn("few", few).where(F.col("few") <= k + 1).drop("few").withColumn("h", F.pmod(F.xxhash64("j"), F.lit(HASH))))
    sizes = protos.groupBy("b").agg(F.count("*").alias("n"), F.min("h").alias("low"))
    share = F.least(F.ceil(F.sqrt("n")), F.lit(MAX_PIVOTS)) / F.col("n") * HASH
    chosen = protos.join(sizes, "b").where((F.col("h") < share) | (F.col("h") == F.col("low")))
    packs = stored(chosen.select("b", "v").distinct().groupBy("b").applyInPandas(lambda pdf: pd.DataFrame({"b": pdf["b"].iloc[:1], "pivots": [[np.array(x, dtype=float).tobytes() for x in pdf["v"]]]}), f"b {kind}, pivots array<binary>"))
    routed = salted(protos.drop("h"), sizes, ["b"], ROUTE_ROWS, "j", "part")
    cells = routed.groupBy("b", "part").cogroup(packs_of(packs, sizes).groupBy("b", "part"))
    cells = stored(cells.applyInPandas(lambda key, x, y: place(x, y), f"b {kind}, j long, cell int, dist double, v binary"))
    stats = cells.groupBy("b", "cell").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("wide"))
    paged = salted(cells, stats, ["b", "cell"], PAGE_ROWS, "j", "page")
    pages = stored(paged.groupBy("b", "cell", "page").applyInPandas(pack_page, f"b {kind}, cell int, js binary, dists binary, vs binary"))
    held = stats.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("near", "wide")))).alias("of"))  # MAX_PIVOTS or so each
    every = F.sequence(F.lit(0), F.size("pivots") - 1)
    edge = lambda name, none: F.transform(every, lambda c: F.coalesce(F.try_element_at(F.col("of"), c)[name], F.lit(none)))
    known = packs.join(held, "b").select("b", "pivots", edge("near", 0.0).alias("near"), edge("wide", float("inf")).alias("wide"))

    asked = named(queries, id, "i")
    counts = asked.groupBy("b").agg(F.count("*").alias("n"))
    asked = salted(asked, counts, ["b"], ROUTE_ROWS, "i", "part")
    spread = packs_of(known, counts)

    homes = stored(nearest_cells(asked, spread, kind, k))
    dealt = salted(homes, homes.groupBy("b", "cell").agg(F.count("*").alias("n")), ["b", "cell"], BLOCK_ROWS, "i", "block")
    blocks = dealt.groupBy("b", "cell", "block").applyInPandas(pack_block, f"b {kind}, cell int, ids binary, tos binary, limits binary, qs binary")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                js, ids = (np.frombuffer(x, dtype=np.int64) for x in (r.js, r.ids))
                dists, to, within = (np.frombuffer(x, dtype=float) for x in (r.dists, r.tos, r.limits))
                v, q = np.frombuffer(r.vs, dtype=float).reshape(len(js), -1), np.frombuffer(r.qs, dtype=float).reshape(len(ids), -1)
                out, _ = search_page(js, dists, v, ids, to, within, q, k)
                if out:
                    yield pd.DataFrame(dict(zip(("i", "j", "dist"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    near = best_of(pages.join(blocks, ["b", "cell"]).drop("b", "cell").mapInPandas(search, "i long, j long, dist double"), k)
    kth = near.where(F.col("rank") == k).select("i", F.col("dist").alias("kth"))
    narrowed = homes.join(kth, "i", "left").withColumn("within", F.least("within", F.coalesce("kth", F.lit(float("inf")))))

    # Chunks of about ROUTE_ROWS queries from as few cells as may be; large cells are dealt over several.
    homed = homes.groupBy("b", "cell").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy("b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(homed.select("b", "cell", "n", F.floor(F.coalesce(run, F.lit(0)) / ROUTE_ROWS).cast("int").alias("chunk")))
    chunked = salted(narrowed.join(starts.select("b", "cell", "chunk"), ["b", "cell"]), starts, ["b", "cell"], ROUTE_ROWS, "i", "part").select("b", "chunk", "part", "i", "q", "within")
    keys = ["b", "chunk", "part"]
    every_part = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / ROUTE_ROWS).cast("int") - 1)).alias("part")
    copies = known.join(starts.select("b", F.col("chunk").alias("chunk"), every_part).distinct(), "b").select(*[F.col(c).alias(c) for c in (*keys, "pivots", "near", "wide")])
    schema = f"b {kind}, chunk int, part int, ids binary, limits binary, qs binary, cells array<int>"
    chunks = stored(chunked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(lambda x, y: pack_chunk(x, y, k), schema))
    meets = F.greatest(F.lit(1), F.ceil(F.col("n") / MEET_ROWS)).cast("int")
    parts = protos.groupBy("b").agg(F.count("*").alias("n")).select("b", meets.alias("meets"))
    met = chunks.select(*keys, F.explode("cells").alias("cell")).join(pages.select("b", "cell", "js", "vs", F.xxhash64("js").alias("h")), ["b", "cell"])
    met = met.join(parts, "b").select(*keys, F.pmod("h", "meets").cast("int").alias("meet"), "js", "vs")
    asking = chunks.join(parts, "b").withColumn("meet", F.explode(F.sequence(F.lit(0), F.col("meets") - 1))).select(*[F.col(c).alias(c) for c in (*keys, "meet", "ids", "limits", "qs")])
    found = met.groupBy(*keys, "meet").cogroup(asking.groupBy(*keys, "meet")).applyInPandas(lambda x, y: search_chunk(y.iloc[0], x, k), "i long, j long, dist double")
    found = best_of(found, k)
    return found.select(F.col("i").alias(id), F.col("j").alias(other), "dist", "rank")


def robust_scales(rows: DataFrame, vector: str, floor: float = 1e-3) -> DataFrame:
    """One row: centre (medians) and scale of each component: IQR / 1.349, or else the deviation, or else 1."""
    parts = rows.select(F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    quartiles = exact_quantiles(parts, ["at"], "x", (0.25, 0.5, 0.75))
    spread = parts.groupBy("at").agg(F.stddev_pop("x").alias("dev"))
    q = F.col("quantiles")
    iqr = (q[2] - q[0]) / 1.349
    scale = F.when(iqr > floor, iqr).when(F.col("dev") > floor, F.col("dev")).otherwise(1.0)
    each = quartiles.join(spread, "at").select(F.struct("at", q[1].alias("centre"), scale.alias("scale")).alias("s"))
    return each.agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.col("s.centre").alias("centre"), F.col("s.scale").alias("scale"))


def scaled(rows: DataFrame, scales: DataFrame, vector: str, clip: float = 6.0) -> DataFrame:
    """rows with the vector's components centred, scaled and clipped. scales: one row of robust_scales."""
    z = F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), "centre", lambda x, c: x - c), "scale", lambda x, s: F.greatest(F.least(x / s, F.lit(clip)), F.lit(-clip)))
    return rows.crossJoin(F.broadcast(scales)).withColumn(vector, z).drop("centre", "scale")


def neighbour_means(near: DataFrame, prototypes: DataFrame, id: str, other: str, rows: str, values: Sequence[str], most: int = 256) -> DataFrame:
    """id and the weighted means of the neighbours' values, with weights sqrt(min(rows, most)) / (1 + dist)."""
    weight: Column = F.sqrt(F.least(F.col(rows), F.lit(most))) / (1 + F.col("dist"))
    joined = near.join(prototypes.select(other, rows, *values), other).withColumn("_w", weight)
    return joined.groupBy(id).agg(*[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values], F.count("*").alias("neighbours"))
