"""Event streams' aggregations, run on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.sources.views import view
from weftline.streaming import windows

from .registry import query


@query("select epoch_ms(time_bucket(interval '1 hour', ts)) // 1000 as begins, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from {events} group by 1, 2")
def tumbling_windows(spark, d):
    w = windows.tumbling(view(spark, d, "events"))
    return w.select(F.unix_timestamp("window_start").alias("begins"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select key, cast(min(pos) as bigint) as begins, cast(max(pos) as bigint) as last_pos, cast(count(*) as bigint) as n from (select key, pos, sum(case when p is null or pos - p >= 1800 then 1 else 0 end) over (partition by key order by pos rows unbounded preceding) as g
 from (select user_id as key, epoch_us(ts) / 1000000.0 as pos, lag(epoch_us(ts) / 1000000.0) over (partition by user_id order by ts) as p from {events}) x) y group by key, g""".replace("cast(min(pos) as bigint)", "cast(floor(min(pos)) as bigint)").replace("cast(max(pos) as bigint)", "cast(floor(max(pos)) as bigint)"))
def session_windows(spark, d):
    s = windows.sessions(view(spark, d, "events"), "30 minutes")
    return s.select(F.col("user_id").alias("key"), F.unix_timestamp("session_start").alias("begins"), (F.unix_timestamp(F.col("session_end") - F.expr("interval 30 minutes"))).alias("last_pos"), "n")
