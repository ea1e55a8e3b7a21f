"""Nearest prototypes against all pairs, ties and copies, how many distances pruning leaves; means by hand."""

import math
import random

import numpy as np
import pytest

from tallyframe.operators import neighbours as N


def brute(queries, protos, k):
    out = []
    for i, b, q in queries:
        near = sorted((math.dist(q, v), j) for j, c, v in protos if c == b and j != i and None not in (b, q, v, j))
        out += [(i, j, r + 1, round(d, 9)) for r, (d, j) in enumerate(near[:k])]
    return sorted(out)


def found(spark, queries, protos, k):
    x = spark.createDataFrame(queries, "i long, b string, v array<double>")
    y = spark.createDataFrame(protos, "j long, b string, v array<double>")
    got = N.nearest_prototypes(x, y, "b", "i", "j", "v", k).collect()
    return sorted((r["i"], r["j"], r["rank"], round(r["dist"], 9)) for r in got)


def points(seed, n, dim=3, grid=None):
    rnd = random.Random(seed)
    value = (lambda: float(rnd.randrange(grid))) if grid else rnd.random
    return [(i, rnd.choice(["hot", "hot", "cold"]), [value() for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize(("grid", "k"), [(None, 3), (3, 4), (1, 5)])
def test_equals_all_pairs(spark, grid, k):
    rows = points(1, 250, grid=grid)  # a grid of one point: all are copies
    assert found(spark, rows, rows, k) == brute(rows, rows, k)


def test_small_parts_and_pages(spark, monkeypatch):
    for name, size in (("ROUTE_ROWS", 20), ("PAGE_ROWS", 7), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(N, name, size)
    protos, queries = points(2, 200), [(1000 + i, b, v) for i, b, v in points(3, 60)]
    queries += [(2000, "none here", [0.0, 0.0, 0.0]), (2001, None, [0.0, 0.0, 0.0]), (2002, "hot", None)]
    protos += [(3000, "lonely", [0.5, 0.5, 0.5]), (3001, "hot", None), (3002, None, [0.0, 0.0, 0.0])]
    assert found(spark, queries, protos, 6) == brute([q for q in queries if q[1] and q[2]], protos, 6)
    assert found(spark, [(3000, "lonely", [0.5, 0.5, 0.5]), (3003, "lonely", [0.5, 0.5, 0.0])], protos, 2) == [(3003, 3000, 1, 0.5)]


def test_rows_behind_the_bound_are_not_compared():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 8)) * 20
    v = np.concatenate([c + rnd.normal(size=(100, 8)) for c in centres])
    to = N.apart(v, centres)
    cell = to.argmin(axis=1)
    computed = 0
    for i in range(0, 3000, 50):
        limit = np.sort(np.sqrt(((v - v[i]) ** 2).sum(axis=1)))[5]
        for c in range(30):
            rows = np.flatnonzero(cell == c)
            rows = rows[np.argsort(to[rows, c])]
            hits, n = N.search_page(rows, to[rows, c], v[rows], np.array([i]), to[i : i + 1, c], np.array([limit]), v[i : i + 1], 5)
            computed += n
    assert computed < 0.1 * 60 * 3000


def test_scales_and_means(spark):
    df = spark.createDataFrame([(i, [float(i), 5.0, 0.0 if i else 100.0]) for i in range(9)], "i long, v array<double>")
    s = N.robust_scales(df, "v").first()
    assert s["centre"] == [4.0, 5.0, 0.0]
    assert np.allclose(s["scale"], [4 / 1.349, 1.0, np.std([100.0] + [0.0] * 8)])
    z = {r["i"]: r["v"] for r in N.scaled(df, N.robust_scales(df, "v"), "v", 2.0).collect()}
    assert np.allclose(z[0], [-4 * 1.349 / 4, 0.0, 2.0])
    near = spark.createDataFrame([(1, 10, 0.0, 1), (1, 11, 1.0, 2)], "i long, j long, dist double, rank int")
    protos = spark.createDataFrame([(10, 1000, 1.0), (11, 4, 0.0)], "j long, n long, y double")
    assert N.neighbour_means(near, protos, "i", "j", "n", ["y"]).first()["y"] == pytest.approx(16 / 17)


def test_a_chunk_is_no_larger_for_more_cells():
    """Where no cell can be left out, a query's vector is still held once, and the pages give all neighbours."""
    rnd = np.random.default_rng(6)
    v, pivots = rnd.normal(size=(600, 64)), rnd.normal(size=(300, 64))
    pack = N.pd.DataFrame({"pivots": [[x.tobytes() for x in pivots]], "near": [[0.0] * 300], "wide": [[100.0] * 300]})
    rows = N.pd.DataFrame({"b": "x", "chunk": 0, "part": 0, "i": np.arange(600), "q": [x.tobytes() for x in v], "within": np.inf})
    chunk = N.pack_chunk(rows, pack, 3).iloc[0]
    assert len(chunk["cells"]) == 300 and len(chunk["qs"]) == 600 * 64 * 8
    chunk["limits"] = np.full(600, np.inf).tobytes()
    pages = N.pd.DataFrame({"js": [np.arange(a, a + 50).tobytes() for a in range(0, 600, 50)], "vs": [v[a : a + 50].tobytes() for a in range(0, 600, 50)]})
    got = N.search_chunk(chunk, pages, 3)
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)) + np.diag([np.inf] * 600)
    assert np.array_equal(got["j"].to_numpy().reshape(600, 3), np.argsort(far, axis=1, kind="stable")[:, :3])
