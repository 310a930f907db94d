"""Queries over events, by the plans that also run as streams."""

from __future__ import annotations

from skein.plans.state import STATE
from skein.session import table
from skein.streaming import ingest


def event_windows(spark, d):
    return ingest.event_windows(table(spark, d, "events"))


def user_sessions(spark, d):
    return ingest.user_sessions(table(spark, d, "events"))


def refresh_delta(spark, d):
    return ingest.delta(table(spark, d, "file_records"), table(spark, d, "file_metadata"), table(spark, d, "index_runs"))


QUERIES = {f.__name__: f for f in (event_windows, user_sessions, refresh_delta)}
SQL = {
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "user_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, k",
    "refresh_delta": STATE + "SELECT coalesce(s.collection, k.collection) AS collection, coalesce(s.path, k.path) AS path, CASE WHEN s.path IS NULL THEN 'stale' WHEN k.path IS NULL THEN 'new' WHEN s.hash = k.hash THEN 'unchanged' ELSE 'modified' END AS change FROM scan s FULL JOIN kept k ON s.collection = k.collection AND s.path = k.path",
}
