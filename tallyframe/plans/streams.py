"""Queries of streams; each must equal its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import counters as C
from ..streaming import joins as S


def events(t):
    """Event times as Spark's streams need them; the tables hold local times."""
    rows = C.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def local(df, *names):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL")
def tumbling(t):
    out = C.windowed_sums(events(t), "ts", ["event_type"], "value", "6 hours", "40 days")
    return local(C.drain(out, t.spark, "complete"), "start").withColumn("s", F.round("s", 4))


@query("stream_sliding", "WITH e AS (SELECT unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours']) AS start FROM events) SELECT start, count(*) AS n FROM e GROUP BY start")
def sliding(t):
    return local(C.drain(C.sliding_counts(events(t), "ts", "12 hours", "6 hours", "40 days"), t.spark, "complete"), "start")


@query("stream_sessions", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def sessions(t):
    return local(C.drain(C.sessions(events(t), "ts", "user_id", "2 hours", "40 days"), t.spark, "complete"), "start", "end")


@query("stream_running_counters", "SELECT user_id, event_id, row_number() OVER w - 1 AS n, CAST(coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def running(t):
    rows = events(t).withColumn("y", (F.col("event_type") == "purchase").cast("int")).select("user_id", "event_id", "y")
    return C.drain(C.running_counters(rows, "user_id", "event_id", "y"), t.spark, "append")


@query("stream_followed_by", """WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id AS bought, ts AS tb FROM events WHERE event_type = 'purchase'),
w AS (SELECT date_trunc('milliseconds', least((SELECT max(ts) FROM c), (SELECT max(tb) FROM p))) - INTERVAL '2 hours' AS mark)
SELECT c.user_id, event_id, bought FROM c LEFT JOIN p ON c.user_id = p.user_id AND tb BETWEEN ts AND ts + INTERVAL '1 hour', w WHERE bought IS NOT NULL OR ts + INTERVAL '1 hour' < mark""")
def followed(t):
    """Clicks and the purchases of the hour after; clicks without any are emitted once the watermark has passed that hour."""
    rows = events(t).select("user_id", "event_id", "event_type", "ts")
    clicks = rows.where("event_type = 'click'").drop("event_type")
    bought = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("at"))
    return C.drain(S.followed_by(clicks, bought, "user_id", "ts", "at", "1 hour", "2 hours").select("user_id", "event_id", "bought"), t.spark, "append")


@query("stream_without_repeats", "SELECT user_id, date_trunc('day', ts) AS day, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL")
def repeats(t):
    """Each user's kinds of event by day, of a stream in which they repeat."""
    rows = events(t).withColumn("day", F.date_trunc("day", "ts"))
    found = S.without_repeats(rows, ["user_id", "day", "event_type"], "ts", "40 days")
    return local(C.drain(found.select("user_id", "day", "event_type", F.lit(True).alias("seen")), t.spark, "append"), "day")
