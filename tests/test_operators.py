"""Hand-made frames and properties: ties, nulls, leakage, invariance, empty history."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.operators import aggregates as A
from tallyframe.operators import evaluation as V
from tallyframe.operators import joins as J
from tallyframe.operators import profiles as P
from tallyframe.operators import rows as R
from tallyframe.operators import similarity as M
from tallyframe.operators import states as E
from tallyframe.operators import windows as W
from tallyframe.sources import tables as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def seasons(spark):
    """Entity 3 is idle in season 2."""
    rows = [(e, s, i, (e + s + i) % 2) for e in (1, 2, 3) for s in (1, 2, 3) for i in range(4) if not (e == 3 and s == 2)]
    return frame(spark, rows, "e int, s int, i int, y int")


def test_idle_season_keeps_older_history(seasons):
    table = E.before_season(E.season_sums(seasons, ["e"], "s", {"n": F.lit(1), "h": F.col("y")}), seasons, ["e"], "s", ["n", "h"])
    got = {(r.e, r.s): r.n for r in table.collect()}
    assert got == {(1, 1): 0, (1, 2): 4, (1, 3): 8, (2, 1): 0, (2, 2): 4, (2, 3): 8, (3, 1): 0, (3, 3): 4}
    state = E.season_end_state(E.asof_counters(seasons, ["e"], ["s", "i"], "y"), "e", "s", ["s", "i"], "n", {"h": "rate"}, "y")
    assert {(r.e, r.s): r.n_end for r in state.collect()}[3, 3] == 4


def test_asked_key_without_rows_in_its_season(seasons, spark):
    asked = frame(spark, [(3, 2)], "e int, s int")
    table = E.before_season(E.season_sums(seasons, ["e"], "s", {"n": F.lit(1)}), asked, ["e"], "s", ["n"])
    assert [(r.e, r.s, r.n) for r in table.collect()] == [(3, 2, 4)]


def test_later_rows_change_nothing_earlier(seasons):
    features = lambda df: {(r.e, r.s, r.i): (r.h_rate, r.h_delta) for r in E.history_rates(df, ["e"], "s", "y", 10.0).where("s <= 2").collect()}
    flipped = seasons.withColumn("y", F.when(F.col("s") == 3, 1 - F.col("y")).otherwise(F.col("y")))
    own = seasons.withColumn("y", F.when(F.col("s") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    assert features(seasons) == features(flipped) == features(own)


def test_first_season_has_the_empty_prior(seasons):
    first = E.prior_before_season(seasons, "s", "y").where("s = 1").first()
    assert first.prior == 0.5


def test_round_trip_of_counters(seasons):
    rows = E.asof_counters(seasons, ["e"], ["s", "i"], "y")
    state = E.season_end_state(rows, "e", "s", ["s", "i"], "n", {"h": "rate"}, "y")
    out = E.season_to_date(rows, state, "e", "s", "n", "rate", "h", F.lit(0.5), 120.0)
    for r in out.collect():
        assert r.n_season == r.i and r.invalid == 0


def test_counter_break_is_invalid(spark):
    rows = frame(spark, [(1, 2, 3, 0.5)], "e int, s int, n long, rate double")
    state = frame(spark, [(1, 2, 10, 4)], "e int, s int, n_end long, h long")
    r = E.season_to_date(rows, state, "e", "s", "n", "rate", "h", F.lit(0.5), 120.0).first()
    assert (r.invalid, r.n_season, r.s_season, r.rate_season) == (1, 0, 0, 0.5)


def test_end_state_with_and_without_final_row(seasons):
    rows = E.asof_counters(seasons, ["e"], ["s", "i"], "y")
    with_ = {(r.e, r.s): r.n_end for r in E.season_end_state(rows, "e", "s", ["s", "i"], "n", {"h": "rate"}, "y").collect()}
    without = {(r.e, r.s): r.n_end for r in E.season_end_state(rows, "e", "s", ["s", "i"], "n", {"h": "rate"}, None).collect()}
    assert with_[1, 2] == 4 and without[1, 2] == 3


def test_leave_one_out_of_small_groups(spark):
    df = frame(spark, [("a", 1), ("b", 1), ("b", 0), (None, 1), (None, 1)], "g string, y int")
    got = sorted((r.g or "", r.y, round(r.p, 6)) for r in E.leave_one_out(df, "y", ["g"], 10.0, F.lit(0.5), "p").collect())
    assert got == [("", 1, round(6 / 11, 6)), ("", 1, round(6 / 11, 6)), ("a", 1, 0.5), ("b", 0, round(6 / 11, 6)), ("b", 1, round(5 / 11, 6))]


def test_platoon_residual_follows_the_changing_base(seasons):
    got = {(r.e, r.i, r.s): r.residual for r in E.platoon(seasons, "e", "i", "s", "y", 5.0, 7.0).collect()}
    rows = seasons.toPandas()
    for (e, i, s), value in got.items():
        past = rows[rows.s < s]
        prior = past.y.mean() if len(past) else 0.5
        mine = past[past.e == e]
        base = (mine.y.sum() + 5 * prior) / (len(mine) + 5)
        cell = mine[mine.i == i]
        assert math.isclose(value, ((cell.y - base).sum()) / (len(cell) + 7), abs_tol=1e-12)


def test_sessions_start_on_change_and_fall(spark):
    df = frame(spark, [(1, 1, "a", 1), (1, 2, "a", 2), (1, 3, "a", 1), (1, 4, "b", 5), (2, 5, "b", 6), (2, 6, None, 7), (2, 7, None, 8)], "s int, o int, k string, v int")
    out = W.sessionise(df, "s", ["o"], ["k"], ["v"]).orderBy("o").collect()
    assert [r.session for r in out] == [0, 0, 1, 2, 3, 4, 4]


def test_sessions_over_many_ranges_equal_one_pass(spark):
    rnd = random.Random(3)
    rows = [(i // 70, i, rnd.choice("aab"), rnd.randrange(4)) for i in range(400)]
    want, prior, n = [], None, -1
    for s, _, k, v in rows:
        n += prior is None or (s, k) != prior[:2] or v < prior[2]
        prior = (s, k, v)
        want.append(n)
    df = frame(spark, rows, "s int, o int, k string, v int").repartition(5)
    got = W.sessionise(df, "s", ["o"], ["k"], ["v"]).orderBy("o").collect()
    assert [r.session for r in got] == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = W.sessionise(df, "s", ["o"], ["k"], ["v"]).orderBy("o").collect()
        assert [r.session for r in got] == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rolling_needs_a_full_window(spark):
    df = frame(spark, [(1, i, i) for i in range(1, 5)], "g int, o int, v int")
    out = df.select("o", W.rolling_sum(F.col("v"), ["g"], ["o"], 2).alias("s")).orderBy("o").collect()
    assert [r.s for r in out] == [None, None, 3, 5]


def test_mode_ties_go_to_the_smallest(spark):
    df = frame(spark, [(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a"), (None, "z")], "g int, v string")
    assert sorted((r.g, r["mode"]) for r in A.mode(df, ["g"], "v").collect()) == [(1, "a"), (2, "c")]


def test_identity_map_ties_and_injectivity(spark):
    df = frame(spark, [(1, 10), (1, 10), (2, 10), (3, 30), (3, 31)], "a int, b int")
    assert sorted((r.a, r.b) for r in J.identity_map(df, "a", "b", 0.5).collect()) == [(1, 10), (3, 30)]


def test_linkage_drops_ambiguous_groups(spark):
    a = frame(spark, [(1, 5), (1, 6), (2, 7), (3, 7), (4, 9)], "x long, state int")
    b = frame(spark, [(11, 6), (11, 5), (12, 7), (13, 8)], "z long, state int")
    pairs = J.fingerprints(a, ["x"], "state").drop("size").join(J.fingerprints(b, ["z"], "state").drop("size"), "print")
    assert [(r.x, r.z) for r in J.one_to_one(pairs, "x", "z").collect()] == [(1, 11)]


def test_contract_violations_raise(spark):
    a, b = frame(spark, [(1, "a")], "k int, v string"), frame(spark, [(1, "b"), (1, "c")], "k int, w string")
    with pytest.raises(ValueError, match="not unique"):
        J.contracted_join(a, b, ["k"], "many_to_one")
    assert J.contracted_join(a, b, ["k"], "one_to_many").count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        R.require_columns(a, ["nope"])
    with pytest.raises(ValueError, match="no such columns"):
        R.drop_columns(a, "nope")
    with pytest.raises(ValueError, match="empty side"):
        R.temporal_split(a.withColumn("s", F.lit(1)), "s", 1)


def test_mutual_best_counts_a_missing_runner_up_as_zero(spark):
    df = frame(spark, [("a", "x", 0.9), ("a", "y", 0.88), ("b", "y", 0.5)], "l string, r string, v double")
    assert [(r.l, r.r) for r in J.mutual_best(df, "l", "r", "v", 0.05).collect()] == []
    assert [(r.l, r.r) for r in J.mutual_best(df, "l", "r", "v", 0.01).collect()] == [("a", "x")]


def test_auc_with_ties_and_one_class(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.7)]
    want = np.mean([(p > q) + 0.5 * (p == q) for a, p in rows if a for b, q in rows if not b])
    assert math.isclose(V.auc(frame(spark, rows, "y int, p double"), "y", "p").first().auc, want)
    assert V.auc(frame(spark, [(1, 0.5), (1, 0.6)], "y int, p double"), "y", "p").first().auc is None


def test_grid_equals_scoring_every_blend(spark):
    rng = np.random.default_rng(1)
    data = rng.random((50, 2)).round(3)
    df = frame(spark, [(float(a), float(b), int(a + b > 1)) for a, b in data], "a double, b double, y int")
    for r in V.grid_search(A.gram(df, ["a", "b", "y"]), ["a", "b"], "y", 4).collect():
        y = (data.sum(axis=1) > 1).astype(int)
        assert math.isclose(r.mse, float(np.mean((r.w_a * data[:, 0] + r.w_b * data[:, 1] - y) ** 2)), abs_tol=1e-12)


def test_bootstrap_interval_holds_the_estimate(spark):
    df = frame(spark, [(i % 20, i % 2, 0.5, 0.5 + 0.3 * (i % 2 - 0.5)) for i in range(400)], "c int, y int, b double, p double")
    ci = V.cluster_bootstrap(df, "c", "y", "b", "p", 300)
    assert ci["low"] <= ci["delta"] <= ci["high"] and ci["significant"] and ci == V.cluster_bootstrap(df, "c", "y", "b", "p", 300)


def test_calibrators(spark):
    df = frame(spark, [(int(i % 10 < 3), 0.1 + 0.08 * (i % 10)) for i in range(200)], "y int, p double")
    shift = V.intercept_calibrator(df, "y", "p")
    mean = df.agg(F.avg(S.expit(S.logit(F.col("p")) + shift))).first()[0]
    assert abs(mean - 0.3) < 1e-9


def test_convex_weights_find_the_better_model(spark):
    df = frame(spark, [(i % 2, 0.1 + 0.8 * (i % 2), 0.5) for i in range(20)], "y int, a double, b double")
    w = V.convex_weights(A.gram(df, ["a", "b", "y"]).first().asDict(), ["a", "b"], "y")
    assert w == {"a": 1.0, "b": 0.0}


def test_convex_weights_meet_the_conditions_of_the_optimum():
    rng = np.random.default_rng(6)
    for k in range(1, 9):
        for _ in range(40):
            x, y = rng.normal(size=(30, k)), rng.normal(size=30)
            if k > 3:
                x[:, 1] = x[:, 0]  # a repeated model
            names = [f"m{i}" for i in range(k)]
            row = {f"g_{a}_{b}": float(x[:, i] @ x[:, j] / 30) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j} | {f"g_{a}_y": float(x[:, i] @ y / 30) for i, a in enumerate(names)}
            w = np.array([V.convex_weights(row, names, "y")[n] for n in names])
            slope = x.T @ (x @ w - y) / 30
            assert math.isclose(w.sum(), 1) and (w >= 0).all()
            assert (slope >= slope @ w - 1e-9).all() and np.allclose(slope[w > 0], slope @ w, atol=1e-9)


def test_gate_needs_a_gain_and_no_loss():
    gain, none, loss = {"significant": True, "low": -2.0}, {"significant": False, "low": -1.0}, {"significant": False, "low": 0.1}
    assert V.gate(gain, none) and V.gate(gain, gain)
    assert not V.gate(gain, loss) and not V.gate(none, gain) and not V.gate(loss, none)

def test_bins_of_missing_and_edges(spark):
    df = frame(spark, [(None,), (0.0,), (10.0,), (10.5,), (99.0,)], "x double")
    got = df.select(S.right_closed_bin(F.col("x"), (0, 10, 20)).alias("a"), S.digitize(F.col("x"), (0, 10)).alias("b"), S.fixed_bin(F.col("x"), 0, 20, 5).alias("c"), S.log_count_bin(F.col("x")).alias("d")).collect()
    assert [r.a for r in got] == [-1, -1, 0, 1, -1] and [r.b for r in got][1:] == [1, 2, 2, 2] and [r.c for r in got] == [-1, 0, 2, 2, 4] and got[0].d == -1


def test_fractions_and_divisors(spark):
    df = frame(spark, [(0.333333, 12, 18), (0.0, 0, 5), (None, 7, None)], "x double, a long, b long")
    got = df.select(S.best_fraction(F.col("x"), 50).alias("f"), S.gcd(F.col("a"), F.col("b")).alias("g"), S.lcm(F.col("a"), F.col("b")).alias("l")).collect()
    assert (got[0].f.num, got[0].f.den, got[0].g, got[0].l) == (1, 3, 6, 36)
    assert (got[1].f.num, got[1].f.den, got[1].g, got[1].l) == (0, 1, 5, 0)
    assert got[2].f is None


def test_dates_keys_and_interpolation(spark):
    df = frame(spark, [("03/04/2020", 1.0), ("2020-03-04", 2.0), ("x", None)], "d string, x double")
    got = df.select(S.parse_date(F.col("d")).alias("d"), S.composite_key(F.col("d"), F.col("x")).alias("k"), S.interpolate(F.col("x"), (0, 2), (0.0, 4.0)).alias("v")).collect()
    assert got[0].d == got[1].d and got[2].d is None and got[2].k == "x|__missing__" and [r.v for r in got] == [2.0, 4.0, None]


def test_season_boundary_prefers_the_possible(spark):
    rows = [((20, 6), (100, 30)), ((500, 10), (0, 0)), (None, (100, 30)), ((45, 13), (105, 31))]
    df = frame(spark, rows, "seen struct<n:int,s:int>, recent struct<n:int,s:int>")
    tails = F.array(*[F.struct(F.lit(20 * k).alias("n"), F.lit(6 * k).alias("s")) for k in range(1, 6)])
    games = F.struct(F.lit(20.0).alias("mean"), F.lit(5.0).alias("sd"), F.lit(0.3).alias("rate"))
    a, b, null, d = [r.p for r in df.select(E.season_boundary(F.col("seen"), F.col("recent"), tails, games).alias("p")).collect()]
    assert a.mode == 0 and a.expected_n <= 20 and 0 < a.confidence <= 1 and b.mode == -1 and b.expected_n == 0
    assert null == b and tuple(b) == (0.0, 0.0, -1, 0.0)

    def density(x, mean, sd):
        return math.exp(-((x - mean) ** 2) / (2 * sd * sd)) / sd

    weights = {}
    for h in range(5):
        n, s = 105 - 20 * (5 - h), 31 - 6 * (5 - h)
        if (h or not n) and 0 <= s <= n and 0 <= 13 - s <= 45 - n:
            spread, deviation = max(8 * h**0.5, 8), max(n * 0.21, 4) ** 0.5
            weights[h] = (density(n, 20 * h, spread) * density(s, 0.3 * n, deviation) if h else 1) * math.exp(-(max((45 - n - 20) / 8, 0) ** 2) / 2), 45 - n
    total = sum(w for w, _ in weights.values())
    assert weights and d.mode == max(weights, key=lambda h: weights[h][0]) and d.expected_n == pytest.approx(sum(w * n for w, n in weights.values()) / total)


def test_profile_counts_missing_values(spark):
    df = frame(spark, [(1.0, 1), (None, 0), (3.0, 0)], "x double, y int")
    r = A.profile(df, ["x"], "y", (0.5,)).first()
    assert (r.n, r.missing, r.mean, r.quantiles[0]) == (2, 1, 2.0, 2.0)


def test_sources_round_trip(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, None)], "k int, v string")
    T.write_csv(df, f"{tmp_path}/c")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        T.write_csv(df, f"{tmp_path}/c")
    assert T.scan_csv(spark, f"{tmp_path}/c", "k int, v string").count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        T.scan_csv(spark, f"{tmp_path}/c", "nope int")
    (tmp_path / "m.md").write_text("| a | b |\n|---|---|\n| 1 | x |\ntext\n| 2 | y |\n")
    assert [(r.a, r.b) for r in T.scan_markdown(spark, f"{tmp_path}/m.md", ["a", "b"]).collect()] == [("1", "x"), ("2", "y")]
    assert T.json_report(frame(spark, [(float("inf"), 1)], "x double, n int")).first().json == '{"x":null,"n":1}'


def test_sequence_alignment(spark):
    a = frame(spark, [(1, i, s) for i, s in enumerate("abcdef")], "x long, o long, s string")
    b = frame(spark, [(9, i, s) for i, s in enumerate("abdef")], "z long, o long, s string")
    out = M.align_sequences(a, b, frame(spark, [(1, 9)], "x long, z long"), "x", "z", "o", "s", 0.8).collect()
    assert sorted((r.order_a, r.order_b) for r in out) == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4)]
    assert M.align_sequences(a, b, frame(spark, [(1, 9)], "x long, z long"), "x", "z", "o", "s", 0.99).count() == 0


def test_quantiles_of_large_groups(spark):
    from tallyframe.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(8)
    data = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0], [2900, 30]), "c": np.array([5.0]), "d": np.append(rng.random(40), np.full(2000, 0.5)), "e": np.append(np.full(3, 1.0), np.full(2500, 9.0))}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("f", None), ("g", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = (0.0, 0.1, 0.5, 0.977, 1.0)
    for leaf in (10, 10_000):
        got = {r.k: r.quantiles for r in exact_quantiles(df, ["k"], "v", qs, leaf).collect()}
        assert got.keys() == data.keys()
        for k, v in data.items():
            assert np.allclose(got[k], np.quantile(v, qs), rtol=0, atol=1e-12), (k, leaf)
    assert np.allclose(exact_quantiles(df, [], "v", qs, 100).first().quantiles, np.quantile(np.concatenate(list(data.values())), qs))
    assert exact_quantiles(df.where("false"), ["k"], "v", qs).count() == 0


def test_global_numbers_have_no_gaps(spark):
    df = spark.range(500).selectExpr("cast(id % 37 as double) as k", "id")
    for parts in (2, 16):
        got = W.global_number(df.repartition(parts), ["k", "id"], "n").orderBy("k", "id").collect()
        assert [r.n for r in got] == list(range(500))
    assert W.global_number(df.where("false"), ["k", "id"], "n").count() == 0


def test_standardise_and_codes_with_nulls(spark):
    df = frame(spark, [(1, 1.0), (2, None), (3, 3.0), (4, 8.0)], "i int, x double")
    got = {r.i: r.z for r in R.standardise(df, df, "x", "z").collect()}
    mean, sd = 4.0, float(np.std([1.0, 3.0, 8.0]))
    assert got[2] == pytest.approx((3.0 - mean) / sd) and got[4] == pytest.approx((8.0 - mean) / sd)
    codes = R.ordinal_encode(frame(spark, [("b",), (None,), ("z",)], "c string"), frame(spark, [("b",), ("a",), ("b",), (None,)], "c string"), "c", "code")
    assert {r.c: r.code for r in codes.collect()} == {"b": 2, None: 0, "z": 0}


def test_ridge_and_coordinate_search_reach_their_optimum():
    x = np.array([[1.0, 0.0], [1.0, 1.0], [1.0, 2.0], [1.0, 3.0]])
    y = np.array([1.0, 3.0, 5.0, 7.0])
    q, c = x.T @ x, x.T @ y
    gram = {"g_a_a": q[0, 0], "g_a_b": q[0, 1], "g_b_b": q[1, 1], "g_a_y": c[0], "g_b_y": c[1]}
    fit = V.ridge(gram, ["a", "b"], "y", 0.0)
    assert (fit["a"], fit["b"]) == (pytest.approx(1.0), pytest.approx(2.0))
    w, least = V.coordinate_search(np.array([[2.0, 0.0], [1.6, 0.0]]), np.array([np.eye(2), np.eye(2)]), [i / 10 for i in range(11)])
    assert w.tolist() == [pytest.approx(0.8), 0.0] and least == pytest.approx(1.6 * 0.8 - 0.64)


def test_archetypes_part_two_clouds(spark):
    rows = [(i, float(i % 2 * 50 + i % 5), float(i % 2 * 50 + i % 3) if i else None) for i in range(40)]
    out = {r.id: r for r in P.archetypes(frame(spark, rows, "id int, a double, b double"), "id", ["a", "b"], 1, 2).collect()}
    assert len(out) == 40 and all(r.margin >= 0 for r in out.values())
    assert len({out[i].archetype for i in range(2, 40, 2)}) == 1 and out[2].archetype != out[3].archetype


def test_leave_one_out_hierarchy_by_hand_with_null_keys(spark):
    rows = [(1, 1, "a", 1.0), (2, 1, "a", 0.0), (3, 1, "b", 1.0), (4, 1, None, 1.0), (5, 2, "a", 0.0)]
    df = frame(spark, rows, "id int, season int, k string, y double")
    levels = [("all", [], 10.0), ("k", ["k"], 2.0)]
    own = {r.id: r for r in E.leave_one_out_hierarchy(df, "season", "y", levels).collect()}
    assert len(own) == len(rows)
    # Row 1: the others of season 1 are 0, 1, 1; the other row of "a" is 0.
    assert own[1].all_rate == pytest.approx(2 / 3) and own[1].k_rate == pytest.approx((0 + 2.0 * own[1].all_rate) / 3)
    # A null key is no group, but its row keeps the level above; row 5 is alone in its season.
    assert own[4].all_rate == pytest.approx(2 / 3) and own[4].k_rate == pytest.approx(own[4].all_rate)
    assert own[5].all_rate == 0.5 and own[5].k_rate == 0.5
    past = {r.id: r for r in E.leave_one_out_hierarchy(df, "season", "y", levels, scoring=True).collect()}
    assert past[5].all_rate == pytest.approx(3 / 4) and past[5].k_rate == pytest.approx((1 + 2.0 * past[5].all_rate) / 4)
    assert past[1].all_rate == past[1].k_rate == 0.5
