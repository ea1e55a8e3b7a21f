import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import queries, topk_search
from tallyframe.llm.common import table

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    from support import differences, duck

    assert differences(queries.QUERIES[name](spark, FOLDER), duck(FOLDER), queries.ORACLES[name]) == ([], [])


def brute_top(rows, k):
    whole = {i: np.floor(1024 * np.array(v, dtype=float)).astype(int) for i, v in rows}
    out = []
    for q in whole:
        if q % 5 == 0:
            best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_ties_copies_and_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "LEAF_ROWS", 20)
    monkeypatch.setattr(topk_search, "PAGE_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 5 == 0, 4).collect()))
    assert got == brute_top(rows, 4)


def test_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]), (7, [-3.0, 0.5]), (8, []), (10, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 10 == 0, 10).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 1), (0, 7), (0, 8), (0, 10), (10, 0), (10, 1), (10, 7), (10, 8)]
    assert topk_search.top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert topk_search.top_k(df, F.lit(False)).count() == 0


def test_rows_that_repeat_an_id_are_candidates_of_each_other(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"u": F.lit("x"), "page": F.lit("y")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score >> 20) for r in topk_search.top_k(df, F.col("vec_id") == 0, 3).collect())
    brute = []
    for a, (i, v) in enumerate(rows):
        if i == 0:
            order = sorted((-int(v[0] * w[0] + v[1] * w[1]), j) for b, (j, w) in enumerate(rows) if a != b)[:3]
            brute += [(i, n + 1, j, -s) for n, (s, j) in enumerate(order)]
    assert got == sorted(brute)
    empty = spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.top_k(empty, F.col("vec_id") == 0, 3).collect()] == [(0, 1, 1, 0)]


def test_clustered_vectors_leave_most_leaves_unvisited():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4000
    v = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 40)
    top = float((v * v).sum(axis=1).max())
    tree = topk_search.build_tree([(i, x.tolist()) for i, x in enumerate(v[:200])], 16, top, float(np.abs(v).max()))
    leaf, dist = topk_search.place_rows(tree, v)
    topk_search.cover(tree, [{"leaf": at, "radius": dist[leaf == at].max(), "n": int((leaf == at).sum())} for at in np.unique(leaf)])
    q = v[-50:]
    scores = q @ v.T
    least, seen, visited = np.full(50, -np.inf), np.zeros((50, 200), dtype=bool), 0
    for step in (1, 4, 16, 64, 256):
        chosen = topk_search.best_leaves(tree, q, least, seen, step)
        visited, seen = visited + chosen.sum(), seen | chosen
        held = np.where(seen[:, leaf], scores, -np.inf)
        least = np.sort(held, axis=1)[:, -10]
    assert (least == np.sort(scores, axis=1)[:, -10]).all() and visited < 0.35 * seen.size


def test_stages_take_effect_and_keep_clean_documents(spark):
    docs = table(spark, FOLDER, "documents")
    bench = table(spark, FOLDER, "benchmark").first().text
    extra = [
        (90001, "12 34 !!", None, "s", 8), (90002, f"Intro words here. {bench} Outro words.", "en", "s", 9), (90003, "Clean words of and the thing that was here. password=abcdef1234567890 end", "en", "s", 9),
        (None, "no id but clean words of the thing", "en", None, 3), (90004, None, "en", "s", 0),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(90005).cast("long"))).cache()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "mixing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        seen.append((name, {r.doc_id: r for r in docs.collect()}))
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.DOCUMENT_COLUMNS)
    by = dict(seen)
    assert {90001, 90004} & by["language_id"].keys() == set() and {90002, 90003, None} <= by["language_id"].keys()
    assert 90005 not in by["simhash_dedup"] and {90002, 90003, None} <= by["simhash_dedup"].keys()
    assert 90002 not in by["decontamination"] and 90003 in by["decontamination"]
    r = by["secret_scan"][90003]
    assert "[secret]" in r.text and "1234567890" not in r.text and r.n_chars == len(r.text)
    mixed = by["mixing"]
    assert mixed and all(0 < r.taken <= 3 * r.size for r in mixed.values())
    assert len(by["language_id"]) > 990


def test_run_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 500
    table(spark, FOLDER, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, FOLDER, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_named_by_number():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
