"""Event-time queries, as batch runs of the streaming operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.sources import read_table
from codelode.streaming import feeds


def stream_activity(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.activity(read_table(spark, sf, "events")).drop("users")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sessions(read_table(spark, sf, "events"))


QUERIES = {"stream_activity": stream_activity, "stream_sessions": stream_sessions}
SQL = {
    "stream_activity": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as events, round(sum(value), 4) as value from events group by 1, 2",
    "stream_sessions": """with a as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
b as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from a) select user_id, min(ts) as start, count(*) as events from b group by user_id, s""",
}
