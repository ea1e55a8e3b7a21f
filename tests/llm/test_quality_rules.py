"""Counts by brute force, sketches against exact quantiles, fences that follow their group."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(text):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += ch
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text or ""), len(lines), dups, len(inside)


def test_counts_equal_brute_force():
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c d e", "a a a a a a a", "é x y z #$\n\n#$", "x\x0by\x0cz\r\nq\n q\nq"]
    texts += ["".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "#", "𝒳", "\x1c"]) for _ in range(rnd.randrange(200))) for _ in range(300)]
    for t in texts:
        assert Q.count_text(t) == brute(t), t


def test_windows_of_many_distinct_words():
    # So many kinds that five of them don't fit into 63 bits.
    words = [str(i) for i in range(9000)]
    assert Q.repeated_words([w.encode() for w in words]) == 0
    assert Q.repeated_words([w.encode() for w in words + words[100:107]]) == 14


def test_sketches_are_near_exact_quantiles_and_merge(spark):
    rnd = random.Random(2)
    values = [int(rnd.lognormvariate(6, 2)) for _ in range(3000)]
    bins = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v long, part int").withColumn("bin", Q.bin_of(F.col("v")))
    parts = bins.groupBy("part", "bin").agg(F.count("*").alias("n"))
    merged = parts.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    qs = (0.01, 0.25, 0.5, 0.75, 0.99)
    found = Q.sketch_quantiles(merged, ["one"], qs).first()
    exact = sorted(values)
    assert found["docs"] == 3000
    for i, q in enumerate(qs):
        at = exact[int(q * 2999)]
        assert 0 <= at - found[f"q{i}"] <= at / 2 ** (Q.SUB_BITS - 1)


def corpus():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(400):
        size = 4 if i % 2 else 9
        rows.append((i, " ".join(word(size + rnd.randrange(2)) for _ in range(40)), "short" if i % 2 else "long", "s"))
    return rows


def test_fences_follow_the_language(spark):
    rows = corpus()
    planted = [(1000, "abcdefghi " * 0 + " ".join(x for x in rows[0][1].split()), "short", "s"), (1001, rows[2][1], "long", "s"), (1002, "# ".join(rows[3][1].split()), "short", "s")]
    judged = {r["doc_id"]: r for r in Q.judge_quality(spark.createDataFrame(rows + planted, SCHEMA)).collect()}
    assert not judged[1000]["kept"]  # words of the other language's length
    assert judged[1001]["kept"]
    assert not judged[1002]["kept"]
    assert all(judged[i]["kept"] for i in range(400))


def test_small_groups_take_the_limits_of_their_language(spark):
    rows = corpus()
    tiny = [(2000, rows[1][1], "short", "rare"), (2001, rows[0][1], "short", "rare"), (2002, rows[0][1], None, None)]
    judged = {r["doc_id"]: r for r in Q.judge_quality(spark.createDataFrame(rows + tiny, SCHEMA)).collect()}
    assert judged[2000]["kept"] and not judged[2001]["kept"]
    assert judged[2002]["kept"]  # too few of its kind: the whole's limits, which hold both lengths


@pytest.mark.parametrize("most", [0, 100_000])
def test_both_ways_to_join_agree(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", most)
    rows = corpus() + [(3000, "# " * 50 + "x y z", "long", None), (None, None, None, None), (5, rows_text := corpus()[5][1], "short", "s"), (5, rows_text, "short", "s")]
    out = sorted(map(str, Q.judge_quality(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "base_failed", "kept").collect()))
    assert len(out) == len(rows)
    assert sum("kept=False" in x for x in out) == 2


def test_empty_table_and_extra_columns(spark):
    assert Q.judge_quality(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "a " * 30, "x", "y", 1, 2)], SCHEMA + ", n_words int, limits int")
    assert Q.judge_quality(rows).first()["base_failed"]
