"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import shared_path
from ..streaming import logs


@query("st_append_log", "select event_id, user_id, event_type from events")
def st_append_log(t):
    path = shared_path(t.spark, "log")
    logs.append_log(logs.source(t.spark, t.folder).select("event_id", "user_id", "event_type"), path, shared_path(t.spark, "offsets"))
    return t.spark.read.parquet(path)


@query("st_stream_last", "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by 1")
def st_stream_last(t):
    return logs.run_update(logs.last_by_key(logs.source(t.spark, t.folder), "user_id", "event_id", "event_type"), "user_id", "event_id")


@query("st_stream_rate", "select epoch(date_trunc('minute', ts))::bigint as minute, count(*) as calls from events group by 1")
def st_stream_rate(t):
    rates = logs.windowed_rate(logs.source(t.spark, t.folder)).select(F.unix_timestamp("w.start").alias("minute"), "calls")
    return logs.run_update(rates, "minute", "calls")


@query("st_stream_budget", "select event_id, row_number() over (order by event_id) <= 100 as online from events")
def st_stream_budget(t):
    path = shared_path(t.spark, "admission")
    logs.admit(logs.source(t.spark, t.folder), path, shared_path(t.spark, "offsets"), "event_id", 100)
    return t.spark.read.parquet(path).select("event_id", "online")
