"""Blocked pairs against all pairs, with nulls, repeats and groups too large to be carried; their plan moves no pairs."""

import random
from collections import Counter

import pytest

from tallyframe.operators import joins as J


def drawn(seed, n, hot=0):
    rnd = random.Random(seed)
    maybe = lambda x: x if rnd.random() < 0.95 else None
    rows = [(maybe(rnd.randrange(n)), maybe(rnd.randrange(12)), maybe(rnd.randrange(3)), maybe(rnd.randrange(9))) for _ in range(5 * n)]
    return rows + [(n + 1, rnd.randrange(40), 0, rnd.randrange(9)) for _ in range(hot)]


def brute(a, b):
    of = lambda rows: {g: [r[1:] for r in rows if r[0] == g] for g in {r[0] for r in rows}}
    out = {}
    for i, p in of(a).items():
        for j, q in of(b).items():
            if not {x[:2] for x in p if None not in x[:2]} & {x[:2] for x in q if None not in x[:2]}:
                continue
            c, d = Counter(x[2] for x in p), Counter(x[2] for x in q)
            both = [v for v in c if v in d and v is not None]
            measures = (2 * sum(min(c[v], d[v]) for v in both) / (len(p) + len(q)), len(both) / (len(c) + len(d) - len(both)))
            out[i, j] = measures if None not in (i, j) else (None, None)
    return out


@pytest.mark.parametrize("hot", [0, 100])
@pytest.mark.parametrize("most", [64, 4])
def test_equal_all_pairs(spark, monkeypatch, hot, most):
    monkeypatch.setattr(J, "CARRIED", most)
    a, b = drawn(hot + most, 30, hot), drawn(hot + most + 1, 25, hot)
    x, y = spark.createDataFrame(a, "x long, k long, l long, s long"), spark.createDataFrame(b, "y long, k long, l long, s long")
    got = J.blocked_pairs(x, y, "x", "y", ["k", "l"], "s").collect()
    assert len(got) == len({(r["x"], r["y"]) for r in got})
    assert {(r["x"], r["y"]): (r["dice"], r["jaccard"]) for r in got} == brute(a, b)


def test_queries_move_rows_and_not_pairs(spark):
    """One exchange by group and one by block on each side; an aggregate or a join over pairs would need more."""
    import __spark_entry__ as entry

    for name in ("jn12_blocked_pairs", "jn13_dice_jaccard"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 4, plan
