"""Set-similarity join against all pairs and its candidates on a hot part; alignment against dynamic programming."""

import random
import time
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import similarity as M


def dice(p, q):
    p, q = Counter(p), Counter(q)
    return 2 * sum((p & q).values()) / (p.total() + q.total())


def logs(spark, a, b):
    flat = lambda groups: [(g, s) for g, states in groups.items() for s in states]
    return spark.createDataFrame(flat(a), "x long, s string"), spark.createDataFrame(flat(b), "y long, s string")


def drawn(seed, n=60):
    rnd = random.Random(seed)
    a = {i: rnd.choices("abcdefghij", k=rnd.randrange(1, 12)) for i in range(n)}
    b = {1000 + i: [s for s in states if rnd.random() < 0.8] or ["z"] for i, states in a.items()}
    return a, b


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_all_pairs_from_the_threshold_on(spark, least):
    a, b = drawn(int(least * 10))
    x, y = logs(spark, a, b)
    want = {(i, j): dice(p, q) for i, p in a.items() for j, q in b.items() if dice(p, q) >= least - 1e-9}
    got = {(r["x"], r["y"]): r["dice"] for r in M.similar_pairs(x, y, "x", "y", "s", least).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_best_links_know_runners_up_below_the_threshold(spark):
    a = {1: "abcdefghij", 2: "klmnopqrst", 3: "uvwxyz"}
    b = {11: "abcdefghi!", 12: "abcdefgh!?", 13: "klmno", 14: "klm", 15: "uvwxyz", 16: "uvwxyz"}
    x, y = logs(spark, a, b)
    links = lambda least, margin: sorted((r["x"], r["y"]) for r in M.best_links(x, y, "x", "y", "s", least, margin).collect())
    assert links(0.6, 0.05) == [(1, 11), (2, 13)]
    assert links(0.6, 0.15) == [(2, 13)]
    assert links(0.6, 0.25) == []  # 14 is no candidate from 0.6 on, but nearer than the margin


def test_candidates_grow_in_proportion_on_a_hot_part(spark):
    def counts(n):
        rnd = random.Random(n)
        a = {i: ["hot1", "hot2", "hot3"] + [f"s{rnd.randrange(50 * n)}" for _ in range(7)] for i in range(n)}
        b = {10**6 + i: states[:-1] + ["other"] for i, states in a.items()}
        x, y = logs(spark, a, b)
        assert M.similar_pairs(x, y, "x", "y", "s", 0.7).count() == n
        return M.similar_candidates(x, y, "x", "y", "s", 0.7).count()

    small, large = counts(300), counts(1200)
    assert small < 3 * 300 and large < 3 * 1200


def test_nulls_and_blocks(spark):
    x = spark.createDataFrame([(1, "a", 1), (1, None, 1), (None, "a", 1), (2, "b", 1), (3, None, 1)], "x long, s string, k int")
    y = spark.createDataFrame([(7, "a", 1), (8, "b", 2), (9, None, 1)], "y long, s string, k int")
    assert sorted((r["x"], r["y"]) for r in M.similar_pairs(x, y, "x", "y", "s", 0.5).collect()) == [(1, 7), (2, 8)]
    assert [(r["x"], r["y"]) for r in M.similar_pairs(x, y, "x", "y", "s", 0.5, ["k"]).collect()] == [(1, 7)]
    assert M.similar_pairs(x.where("false"), y, "x", "y", "s", 0.5).count() == 0


def longest_first(a, b):
    """The first longest common subsequence, by trying all choices of places."""
    for k in range(min(len(a), len(b)), 0, -1):
        places = [list(zip(i, j, strict=True)) for i in combinations(range(len(a)), k) for j in combinations(range(len(b)), k)]
        if found := [p for p in places if all(a[i] == b[j] for i, j in p)]:
            return min(found)
    return []


def test_common_subsequence_equals_brute_force():
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(6))] for _ in range(2))
        assert M.common_subsequence(a, b, 10) == longest_first(a, b), (a, b)


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for s in a:
        prior, row = row, [0]
        for j, t in enumerate(b):
            row.append(prior[j] + 1 if s == t else max(prior[j + 1], row[-1]))
    return row[-1]


def test_the_band_loses_no_pair_that_passes():
    rnd = random.Random(9)
    for _ in range(60):
        a = [rnd.choice("abcde") for _ in range(80)]
        b = [s for s in a if rnd.random() < 0.9] + [rnd.choice("abcde") for _ in range(rnd.randrange(8))]
        n, least = table_length(a, b), 0.85
        got = len(M.common_subsequence(a, b, int((1 - least) * (len(a) + len(b)))))
        assert got == n or 2 * n < least * (len(a) + len(b))


def test_a_long_group_takes_seconds(spark):
    rnd = random.Random(10)
    a = [rnd.randrange(5000) for _ in range(100_000)]
    b = [s for s in a if rnd.random() < 0.99]
    began = time.perf_counter()
    found = M.common_subsequence(a, b, int(0.02 * (len(a) + len(b))))
    assert time.perf_counter() - began < 30
    assert len(found) >= len(b) and all(a[i] == b[j] for i, j in found)


def test_alignment_with_nulls_and_ties(spark):
    x = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, "b"), (2, 1, "q")], "x long, o long, s string")
    y = spark.createDataFrame([(9, 5, "a"), (9, 6, None), (9, 7, "b"), (8, 1, "r")], "y long, o long, s string")
    pairs = spark.createDataFrame([(1, 9), (2, 8), (3, 9)], "x long, y long")
    out = M.align_sequences(x, y, pairs, "x", "y", "o", "s", 0.5).orderBy("order_a").collect()
    assert [tuple(r) for r in out] == [(1, 9, 1, 5), (1, 9, 3, 7)]
    assert M.align_sequences(x, y, pairs, "x", "y", "o", "s", 0.6).where(F.col("x") == 1).count() == 0


@pytest.mark.parametrize("most", [64, 5])
def test_pairs_of_small_and_large_groups(spark, monkeypatch, most):
    monkeypatch.setattr(M, "CARRIED", most)
    a, b = drawn(77)
    a[500] = [f"l{k // 2}" for k in range(120)]
    b[1500], b[1501] = a[500][:90], a[500][30:] + ["a"]
    x, y = logs(spark, a, b)
    want = {(i, j): dice(p, q) for i, p in a.items() for j, q in b.items() if dice(p, q) >= 0.5 - 1e-9}
    rows = M.similar_pairs(x, y, "x", "y", "s", 0.5).collect()
    got = {(r["x"], r["y"]): r["dice"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and (500, 1500) in got
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    jaccard = {k: len(set(a[k[0]]) & set(b[k[1]])) / len(set(a[k[0]]) | set(b[k[1]])) for k in want}
    assert all(abs(r["jaccard"] - jaccard[r["x"], r["y"]]) < 1e-12 for r in rows)


def test_pairs_are_verified_where_they_meet(spark):
    """One join of prefixes, and none of pairs with counts."""
    x, y = logs(spark, *drawn(5, 20))
    plan = M.similar_pairs(x, y, "x", "y", "s", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3, plan  # two with the elements' frequency


def test_rows_are_shuffled_once_a_side(spark):
    """Before the prefixes meet, each log's rows go once to their groups; no table of all states is joined to them by a shuffle."""
    x, y = logs(spark, *drawn(6, 20))
    plan = M.similar_pairs(x, y, "x", "y", "s", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4, plan


def test_null_blocks_agree_with_none(spark):
    x, y = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "x long, s string, k int"), spark.createDataFrame([(7, "a", None), (8, "b", 1)], "y long, s string, k int")
    for most in (64, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(M, "CARRIED", most)
            assert [(r["x"], r["y"]) for r in M.similar_pairs(x, y, "x", "y", "s", 0.5, ["k"]).collect()] == [(2, 8)]
