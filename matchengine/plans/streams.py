"""Queries of the batch forms of stream operators over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchengine.registry import query, table
from matchengine.streaming import events as S


def events(spark, d):
    return table(spark, d, "events")


@query("k_debounce_leading", """with recursive r as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
    s as (select user_id, event_type, event_id, ts, n, ts as last, true as passed from r where n = 1
    union all select r.user_id, r.event_type, r.event_id, r.ts, r.n, case when r.ts - s.last >= interval 24 hour then r.ts else s.last end, r.ts - s.last >= interval 24 hour
    from s join r on r.user_id = s.user_id and r.event_type = s.event_type and r.n = s.n + 1) select user_id, event_type, event_id from s where passed""")
def k_debounce_leading(spark, d):
    return S.leading(events(spark, d), ["user_id", "event_type"], 86400)


@query("k_debounce_trailing", """with r as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as new from events),
    g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from r) select user_id, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts from g group by user_id, g""")
def k_debounce_trailing(spark, d):
    return S.trailing(events(spark, d), ["user_id"], "6 hours").select("user_id", "n_events", "first_ts", "last_ts")


@query("k_rate_limit", "select event_id, row_number() over (partition by user_id, epoch_us(ts) // 86400000000 order by ts, event_id) <= 1 as allowed from events")
def k_rate_limit(spark, d):
    return S.rate_limited(events(spark, d), "user_id", 1, 86400).select("event_id", "allowed")


@query("k_rate_counts", "select user_id, time_bucket(interval 1 day, ts) as start, count(*) as n from events group by 1, 2")
def k_rate_counts(spark, d):
    return S.rate_counts(events(spark, d), "user_id", "1 day").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("k_route", """select event_id, case when event_type = 'error' then 'cleanup' when event_id % 4 = 3 then 'skip' when event_type = 'signup' then 'rescore' else 'process' end as route from events""")
def k_route(spark, d):
    kind = F.expr("case event_type when 'signup' then 'rescore' when 'error' then 'deleted' else 'modified' end")
    path = F.expr("concat('cv/', event_id, element_at(array('.pdf', '.DOCX', '.txt', '.png'), cast(event_id % 4 as int) + 1))")
    return events(spark, d).select("event_id", S.route(kind, path, F.lit(True)).alias("route"))
