"""Queries on the event stream's table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import read
from ..streaming import monitor
from .detection import _r


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return _r(monitor.windowed(read(s, d, "events"), "1 hour"), "total")


WINDOWS_SQL = "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2"


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return monitor.sessions(read(s, d, "events"))


SESSIONS_SQL = """
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from (
  select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events)) group by user_id, k
"""

QUERIES = {"event_windows": (event_windows, WINDOWS_SQL), "event_sessions": (event_sessions, SESSIONS_SQL)}
