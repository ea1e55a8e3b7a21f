"""Exact top-k search by inner product over an M-tree whose leaves are pages of a DataFrame.

Vectors are floor(1024 * component). A further coordinate sqrt(M^2 - |v|^2) gives all of them the largest norm M, so that
the largest inner products with a query are the smallest Euclidean distances, a metric. The routing nodes, a bounded
sample of vectors, hold covering radii and the distance to their parent; every vector of a leaf's pages holds the distance
to its leaf. The search is best-first in waves: each query visits its unvisited leaves with the least lower bounds, 1 in
the first wave and four times as many in each further one. The k-th best score so far discards nodes, leaves and vectors by
the triangle inequality, without computing their distances; a query ends when no leaf is left within it. Leaves that a
query has visited are kept with it, so that rounding can't make it skip or repeat one.

Defined cases: null vectors or ids, and vectors with null or non-finite components, take no part; shorter vectors, empty
ones too, count as followed by zeros; each row that asks is a query of its own, and only itself is not its candidate, so
that an id that asks in several rows has each rank several times, and other rows with the query's id are candidates; ties go
to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded_batches, checkpointed

SCALE = 1024.0
#: Bounds of the routing tree and sizes of a page and of a block of queries.
MAX_LEAVES, LEAF_ROWS, PAGE_ROWS, QUERY_ROWS = 16384, 256, 512, 256
#: Factor by which a wave visits more leaves of a query than the wave before.
WIDER = 4
#: Below this product of dimension and squared component, sums are exact in doubles.
EXACT = 2.0**52
FOUND = "u long, query_id long, vec_id long, score long"


@dataclass
class Tree:
    """Leaves in order of their parent node. Centres are lengthened vectors."""

    dim: int
    top: float  # M squared
    exact: bool
    node: np.ndarray  # centres of the inner nodes
    node_radius: np.ndarray
    leaf: np.ndarray  # centres of the leaves
    leaf_radius: np.ndarray
    parent: np.ndarray
    to_parent: np.ndarray
    pages: np.ndarray
    ids: np.ndarray

    def lengthen(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(0.0, self.top - (v * v).sum(axis=1)))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def integers(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def build_tree(sample: list[tuple[int, list[int]]], dim: int, top: float, widest: float) -> Tree:
    ids = np.array([i for i, _ in sample], dtype=np.int64)
    tree = Tree(dim, top, dim * widest * widest < EXACT, *[np.zeros(0)] * 6, np.ones(len(ids), dtype=np.int64), ids)
    centres = tree.lengthen(integers([v for _, v in sample], dim))
    nodes = centres[:: max(1, int(np.sqrt(len(centres))))]
    apart = distances(centres, nodes)
    held, parent = np.unique(apart.argmin(axis=1), return_inverse=True)  # of equal nodes only one has leaves
    nodes, apart = nodes[held], apart[:, held]
    tree.node, tree.leaf, tree.parent, tree.to_parent = nodes, centres, parent, apart[np.arange(len(centres)), parent]
    tree.leaf_radius = np.zeros(len(centres))
    return tree


def place_rows(tree: Tree, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest leaf of the nearest node for each vector, and the distance to it."""
    long = tree.lengthen(v)
    node = distances(long, tree.node).argmin(axis=1)
    leaf, dist = np.zeros(len(v), dtype=np.int32), np.zeros(len(v))
    for at in np.unique(node):
        rows, leaves = np.flatnonzero(node == at), np.flatnonzero(tree.parent == at)
        apart = distances(long[rows], tree.leaf[leaves])
        near = apart.argmin(axis=1)
        leaf[rows], dist[rows] = leaves[near], apart[np.arange(len(rows)), near]
    return leaf, dist


def cover(tree: Tree, rows: list) -> None:
    """Set the leaves' radii and pages from rows (leaf, radius, n), and from these the nodes' radii."""
    for r in rows:
        tree.leaf_radius[r["leaf"]] = r["radius"]
        tree.pages[r["leaf"]] = max(1, -(-r["n"] // PAGE_ROWS))
    tree.node_radius = np.zeros(len(tree.node))
    np.maximum.at(tree.node_radius, tree.parent, tree.to_parent + tree.leaf_radius)


def reach(tree: Tree, q: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The distance within which a score of at least `least` lies, with slack for rounding."""
    far = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + tree.top - 2 * least))
    return far * (1 + 1e-9) + 1e-6


def open_leaves(tree: Tree, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which leaves each query can't discard, and the lower bound of the distance to each of them."""
    long = np.hstack([q, np.zeros((len(q), 1))])
    to_node = distances(long, tree.node)
    slack = 1e-6 + 1e-9 * np.sqrt(tree.top)
    alive = (to_node - tree.node_radius <= limit[:, None] + slack)[:, tree.parent]
    alive &= np.abs(to_node[:, tree.parent] - tree.to_parent) - tree.leaf_radius <= limit[:, None] + slack
    bound = np.full(alive.shape, np.inf)
    some = np.flatnonzero(alive.any(axis=0))
    bound[:, some] = np.maximum(0.0, distances(long, tree.leaf[some]) - tree.leaf_radius[some])
    bound[~alive] = np.inf
    return bound <= limit[:, None] + slack, bound


def best_leaves(tree: Tree, q: np.ndarray, least: np.ndarray, seen: np.ndarray, step: int) -> np.ndarray:
    """Which leaves each query visits next: up to `step` unseen ones with the least bounds among those it can't discard."""
    known = np.isfinite(least)
    limit = np.where(known, reach(tree, q, np.where(known, least, 0.0)), np.inf)
    wanted, bound = open_leaves(tree, q, limit)
    bound[seen | ~wanted] = np.inf
    order = np.argsort(bound, axis=1, kind="stable")[:, :step]
    chosen = np.zeros_like(wanted)
    np.put_along_axis(chosen, order, True, axis=1)
    return chosen & np.isfinite(bound)


def search_page(tree: Tree, leaf: int, page: tuple[np.ndarray, ...], queries: tuple[np.ndarray, ...], q: np.ndarray, least: np.ndarray, k: int):
    """(query's row and id, vec, score) of the page's k best for each query.

    A page has rows, ids, distances to its leaf, in whose order it is, and vectors; queries have rows and ids.
    """
    rows, ids, dist, vectors = page
    slack = 1e-6 + 1e-9 * np.sqrt(tree.top)
    centre = distances(np.hstack([q, np.zeros((len(q), 1))]), tree.leaf[leaf : leaf + 1])[:, 0]
    limit = reach(tree, q, least) + slack
    low, high = np.searchsorted(dist, centre - limit), np.searchsorted(dist, centre + limit, side="right")
    out = []
    for i in range(len(q)):
        part = slice(low[i], high[i])
        if part.start >= part.stop:
            continue
        score = vectors[part] @ q[i] if tree.exact else vectors[part].astype(np.int64) @ q[i].astype(np.int64)
        good = np.flatnonzero((score >= least[i]) & (rows[part] != queries[0][i]))
        order = good[np.lexsort((ids[part][good], -score[good]))[:k]]
        out.append((*[np.full(len(order), x[i]) for x in queries], ids[part][order], score[order].astype(np.int64)))
    return out


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("u").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner products for each row that satisfies `queries`."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.where(F.col(id).isNotNull() & usable(F.col(vector))).select(F.col(id).cast("long").alias("i"), whole.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    widest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    facts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top"), F.max(widest).alias("widest")).first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"] or not facts["asks"]:
        return nothing
    leaves = int(min(MAX_LEAVES, max(1, facts["n"] // LEAF_ROWS)))
    sample = [(r["i"], r["v"]) for r in rows.orderBy(F.xxhash64("i"), "i").limit(leaves).select("i", "v").collect()]
    tree = build_tree(sample, max(1, facts["dim"]), float(facts["top"]), float(facts["widest"] or 0))
    routing = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = routing.value
        for pdf in batches:
            v = integers(pdf["v"], t.dim)
            leaf, dist = place_rows(t, v)
            yield pd.DataFrame({"i": pdf["i"], "asks": pdf["asks"], "leaf": leaf, "dist": dist, "v": [x.tobytes() for x in v]})

    placed = rows.mapInPandas(place, "i long, asks boolean, leaf int, dist double, v binary")
    placed = checkpointed(placed.withColumn("u", F.monotonically_increasing_id()))
    sizes = placed.groupBy("leaf").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect()
    cover(tree, sizes)
    covered = spark.sparkContext.broadcast(tree)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dist")
        packed = {c: [pdf[x].to_numpy().tobytes()] for c, x in (("us", "u"), ("ids", "i"), ("dists", "dist"))}
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "page": pdf["page"].iloc[:1], **packed, "vs": [b"".join(pdf["v"])]})

    # A row for each leaf, MAX_LEAVES at most.
    counts = spark.createDataFrame([(r["leaf"], int(tree.pages[r["leaf"]])) for r in sizes], "leaf int, pages int")
    page = F.pmod(F.xxhash64("u", F.lit(3)), F.col("pages")).cast("int")
    paged = placed.join(F.broadcast(counts), "leaf").select("u", "i", "leaf", "dist", "v", page.alias("page"))
    pages = checkpointed(paged.groupBy("leaf", "page").applyInPandas(pack, "leaf int, page int, us binary, ids binary, dists binary, vs binary"))

    def choose(step: int):
        """Queries with a leaf left, their threshold, the leaves of this wave and all that they have seen."""

        def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = covered.value
            for pdf in batches:
                for at in range(0, len(pdf), QUERY_ROWS):
                    part = pdf.iloc[at : at + QUERY_ROWS]
                    q = np.frombuffer(b"".join(part["v"]), dtype=float).reshape(-1, t.dim)
                    bits = np.frombuffer(b"".join(part["seen"]), dtype=np.uint8).reshape(len(part), -1)
                    seen = np.unpackbits(bits, axis=1)[:, : len(t.leaf)].astype(bool)
                    seeds = q @ t.leaf[:, :-1].T  # scores of the sampled rows, which are candidates themselves
                    seeds[part["i"].to_numpy()[:, None] == t.ids[None, :]] = -np.inf
                    least = part["least"].to_numpy(dtype=float)
                    if seeds.shape[1] >= k:
                        least = np.maximum(least, np.partition(seeds, -k, axis=1)[:, -k])
                    chosen = best_leaves(t, q, least, seen, step)
                    more = np.flatnonzero(chosen.any(axis=1))
                    after = np.packbits(seen | chosen, axis=1)
                    yield part[["u", "i", "v"]].iloc[more].assign(
                        least=least[more], seen=[after[x].tobytes() for x in more], now=[np.flatnonzero(chosen[x]).astype(np.int32).tobytes() for x in more]
                    )

        return plan

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The queries that visit a leaf, in blocks."""
        t = covered.value
        for pdf in batches:
            for at in range(0, len(pdf), QUERY_ROWS):
                part = pdf.iloc[at : at + QUERY_ROWS]
                q, least = np.frombuffer(b"".join(part["v"]), dtype=float).reshape(-1, t.dim), part["least"].to_numpy(dtype=float)
                u, qid = part["u"].to_numpy(), part["i"].to_numpy()
                now = [np.frombuffer(x, dtype=np.int32) for x in part["now"]]
                leaf, row = np.concatenate(now), np.repeat(np.arange(len(part)), [len(x) for x in now])
                order = np.argsort(leaf, kind="stable")
                starts = np.unique(leaf[order], return_index=True)[1]
                groups = np.split(row[order], starts[1:])
                visited = leaf[order][starts]
                yield pd.DataFrame(
                    {"leaf": visited, "pages": t.pages[visited].astype(np.int32), "qus": [u[r].tobytes() for r in groups], "qids": [qid[r].tobytes() for r in groups], "qs": [q[r].tobytes() for r in groups], "leasts": [least[r].tobytes() for r in groups]}
                )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = covered.value
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                us, ids, qus, qids = (np.frombuffer(x, dtype=np.int64) for x in (r.us, r.ids, r.qus, r.qids))
                vs, q = (np.frombuffer(x, dtype=float).reshape(-1, t.dim) for x in (r.vs, r.qs))
                out += search_page(t, r.leaf, (us, ids, np.frombuffer(r.dists, dtype=float), vs), (qus, qids), q, np.frombuffer(r.leasts, dtype=float), k)
            if out:
                yield pd.DataFrame(dict(zip(("u", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    unseen = F.lit(bytearray(-(-len(tree.leaf) // 8)))
    asked = placed.where("asks").select("u", "i", "v", F.lit(float("-inf")).alias("least"), unseen.alias("seen"))
    asked, found, step = asked.repartition(-(-facts["asks"] // QUERY_ROWS), "u"), None, 1
    while True:
        plan = checkpointed(asked.mapInPandas(choose(step), "u long, i long, v binary, least double, seen binary, now binary"))
        if plan.isEmpty():
            break
        routed = plan.mapInPandas(blocks, "leaf int, pages int, qus binary, qids binary, qs binary, leasts binary")
        routed = routed.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).drop("pages")
        hits = pages.join(routed, ["leaf", "page"]).select("leaf", "us", "ids", "dists", "vs", "qus", "qids", "qs", "leasts").mapInPandas(search, FOUND)
        found = checkpointed(best(hits if found is None else hits.unionByName(found.drop("rank")), k))
        kth = found.where(F.col("rank") == k).select("u", F.col("score").cast("double").alias("kth"))
        asked = plan.join(kth, "u", "left").select("u", "i", "v", F.greatest("least", "kth").alias("least"), "seen")
        step *= WIDER
    return nothing if found is None else found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.r <> c.r),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
