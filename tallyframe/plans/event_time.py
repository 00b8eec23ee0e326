"""Event-time windows; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans.registry import query, table
from tallyframe.streaming import events


def batch(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def plain_times(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("""
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3
""")
def window_tumbling(spark, sf_dir):
    """Daily counts by type."""
    return plain_times(events.windowed(batch(spark, sf_dir), "1 day"))


@query("""
WITH w AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) - INTERVAL (6 * i) HOUR AS start FROM events, range(0, 4) r(i))
SELECT start AS window_start, start + INTERVAL '24 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2, 3
""")
def window_sliding(spark, sf_dir):
    """Counts over 24 hours, every 6 hours."""
    return plain_times(events.windowed(batch(spark, sf_dir), "24 hours", "6 hours"))


@query("""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '12 hours' AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k
""")
def window_session(spark, sf_dir):
    """Sessions of a user that end after 12 quiet hours."""
    return plain_times(events.sessions(batch(spark, sf_dir), "12 hours"))


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def event_sequence(spark, sf_dir):
    """Number of each event in its user's log."""
    from pyspark.sql.window import Window

    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("sequence"))
