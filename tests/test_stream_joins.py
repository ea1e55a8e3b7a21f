"""Streams in several batches with late and repeated rows against what they have to give."""

from datetime import datetime, timedelta

import pytest

from tallyframe.streaming import counters as C
from tallyframe.streaming import joins as S

START = datetime(2024, 5, 1)
LEFT, RIGHT = "k long, a long, ts timestamp", "k long, b long, at timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A folder that gets a file for each batch, and the stream that reads it, one file at a time."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def run(df, path):
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def rows_of(spark, df, path):
    return sorted((tuple(r) for r in spark.read.schema(df.schema).parquet(f"{path}/out").collect()), key=str)


def test_join_with_late_and_unmatched_rows(spark, tmp_path):
    left, right = Feed(spark, tmp_path / "l", LEFT), Feed(spark, tmp_path / "r", RIGHT)
    left.add([(1, 10, at(0)), (1, 11, at(5)), (2, 12, at(5)), (None, 13, at(5))])
    right.add([(1, 20, at(3)), (1, 21, at(14)), (2, 22, at(4))])
    joined = S.followed_by(left.stream(), right.stream(), "k", "ts", "at", "10 minutes", "30 minutes").select("a", "b")
    run(joined, tmp_path / "q")
    assert rows_of(spark, joined, tmp_path / "q") == [(10, 20), (11, 21)]  # nothing is given up yet
    right.add([(2, 23, at(9))])  # behind the newest, but within the bound
    left.add([(1, 14, at(200))])
    right.add([(9, 24, at(200))])
    run(joined, tmp_path / "q")
    assert (12, 23) in rows_of(spark, joined, tmp_path / "q")
    left.add([(1, 15, at(1)), (3, 16, at(400))])  # 15 is too late
    right.add([(1, 25, at(2)), (9, 26, at(400))])
    run(joined, tmp_path / "q")
    got = rows_of(spark, joined, tmp_path / "q")
    assert not any(r[0] == 15 for r in got)
    assert (13, None) in got and (14, None) in got and (16, None) not in got
    assert sorted(r for r in got if r[1]) == [(10, 20), (11, 21), (12, 23)]


def test_repeats_in_later_batches_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path / "f", LEFT)
    feed.add([(1, 10, at(0)), (1, 10, at(0)), (2, 11, at(1))])
    found = S.without_repeats(feed.stream(), ["k", "a"], "ts", "30 minutes").select("k", "a")
    run(found, tmp_path / "q")
    feed.add([(1, 10, at(7)), (2, 11, at(1)), (2, 12, at(20))])
    run(found, tmp_path / "q")
    feed.add([(2, 12, at(25)), (3, 13, at(60))])
    run(found, tmp_path / "q")
    assert rows_of(spark, found, tmp_path / "q") == [(1, 10), (2, 11), (2, 12), (3, 13)]


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_one_batch_equals_the_batch_join(spark, tmp_path, how):
    left, right = Feed(spark, tmp_path / "l", LEFT), Feed(spark, tmp_path / "r", RIGHT)
    a = [(i % 3, i, at(i * 7 % 90)) for i in range(40)] + [(99, 1000, at(10_000))]
    b = [(i % 4, i, at(i * 11 % 90)) for i in range(40)] + [(98, 1001, at(10_000))]
    left.add(a)
    right.add(b)
    got = C.drain(S.followed_by(left.stream(), right.stream(), "k", "ts", "at", "5 minutes", "1 hour", how).select("a", "b"), spark, "append").collect()
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[2] <= x[2] + timedelta(minutes=5)]
    alone = [(x[1], None) for x in a[:-1] if how == "leftOuter" and x[1] not in {w[0] for w in want}]
    assert sorted(map(tuple, got), key=str) == sorted(want + alone, key=str)
