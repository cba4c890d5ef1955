"""Streaming queries: the events table read as a stream, results written and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftloom.operators.graph import shared_folder
from driftloom.plans.roles import t
from driftloom.streaming import events as T
from driftloom.streaming import state as ST


def shared(s):
    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


def stream(s, d):
    schema = t(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def batch(s, d):
    return t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def flat(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns])


def measured(df):
    return df.withColumnRenamed("event_type", "topic").withColumn("rejected", F.col("value") > 90).withColumn("latency", F.col("value"))


def clean(s, d):
    """Sign-ups that a purchase follows within a week."""
    e = stream(s, d).select("user_id", F.col("event_type").alias("kind"), "ts")
    out = T.run_once(ST.clean_runs(e, "user_id", "signup", "purchase", "error", 7 * 86_400_000_000, "1 hour"), shared(s))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


def valued(s, d):
    return stream(s, d).select("user_id", F.col("event_id").alias("seq"), "ts", "value")


def ewma(s, d):
    out = T.run_once(ST.ewma_stream(valued(s, d), "user_id", late="1 hour"), shared(s))
    return out.select("user_id", "seq", F.round("ewma", 6).alias("ewma"))


def thresholds(s, d):
    """The events, then one row of a later time that ends the stream: the watermark passes
    every event, and the last row itself waits for good."""
    path, rows = shared(s), valued(s, d)
    ends = f"{path}-end"
    s.createDataFrame([], rows.schema).write.parquet(ends)
    last = batch(s, d).agg(F.any_value("user_id").alias("user_id"), F.lit(-1).cast("long").alias("seq"), (F.max("ts") + F.expr("interval 61 minutes")).alias("ts"), F.lit(0.0).alias("value"))
    for step in range(2):
        if step:
            last.write.mode("append").parquet(ends)
        both = rows.unionByName(s.readStream.schema(rows.schema).parquet(ends))
        out = T.run_once(ST.threshold_stream(both, "user_id", late="1 hour"), path)
    return out.select("user_id", "seq", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "z")], "drift", F.round("frozen", 6).alias("frozen"))


def late_rows(s, d):
    """The later half of the events first, then the earlier one: what of it is older than
    the watermark is dropped and counted."""
    path, e = shared(s), batch(s, d).select("event_id", "ts")
    ends = e.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    middle = F.lit(ends["low"] + (ends["high"] - ends["low"]) / 2)
    for part in (e.filter(F.col("ts") > middle), e.filter(F.col("ts") <= middle)):
        part.write.mode("append").parquet(f"{path}-in")
        rows = s.readStream.schema(e.schema).parquet(f"{path}-in")
        out = T.run_counted(T.deduplicated(rows, ["event_id"], "10 days"), path)
    return out


def measured_stream(s, d):
    """T6 over the closed windows: those that end before the watermark."""
    out = T.run_once(T.throughput(measured(stream(s, d)), "1 day"), shared(s))
    return flat(out.select("start", "topic", "n", "rejects", F.col("p95")), "start")


def spots(s, d):
    out = T.run_once(T.hot_spots(stream(s, d).withColumnRenamed("event_type", "topic"), "3 days", "1 day", "0 seconds"), shared(s))
    return flat(out, "start")


def runs(s, d):
    return flat(T.run_once(T.sessions(stream(s, d), "user_id", "2 hours"), shared(s)), "start", "end")


SESSIONS = "(select user_id, min(ts) as start, max(ts) + interval 2 hours as end, count(*) as n from (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 hours then 0 else 1 end nw from events)) group by user_id, g)"

#: What the watermark has passed at the end of the events.
MARK = "(select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)"

QUERIES = {
    "t06_stream_throughput": (measured_stream, "select start, topic, n, rejects, p95 from (select date_trunc('day', ts) as start, event_type as topic, count(*) as n, count(*) filter (where value>90) as rejects, quantile_disc(value, 0.95) as p95 from events group by 1,2) where start + interval 1 day <= (select max(ts) from events) - interval 10 minutes"),
    "t07_stream_hot_spots": (spots, "select * from (select date_trunc('day', ts) - to_days(cast(k as int)) as start, event_type as topic, count(*) as n from events, range(0,3) r(k) group by 1,2) where start + interval 3 days <= (select max(ts) from events)"),
    "t08_stream_sessions": (runs, f'select * from {SESSIONS} where "end" <= (select max(ts) from events) - interval 10 minutes'),
    "t11_late_rows": (late_rows, "with m as (select min(ts) + (max(ts)-min(ts))/2 as middle, max(ts) - interval 10 days as mark from events) select count(*) filter (where ts > middle or ts >= mark) as kept, count(*) filter (where ts <= middle and ts < mark) as late from events, m"),
    "t02_stream_dedup": (lambda s, d: T.run_once(T.deduplicated(stream(s, d).select("event_id", "ts", "event_type"), ["event_id"]), shared(s)).groupBy("event_type").agg(F.count("*").alias("n")), "select event_type, count(distinct event_id) as n from events group by 1"),
    "t05_stream_clean_runs": (clean, f"select user_id, count(*) as n from (select *, lag(event_type) over w p, lag(ts) over w as pt from events where event_type in ('signup','purchase','error') window w as (partition by user_id order by ts, case event_type when 'error' then 0 when 'signup' then 1 else 2 end)) where event_type='purchase' and p='signup' and ts - pt <= interval 7 days and ts <= {MARK[:-1]} where event_type in ('signup','purchase','error')) group by 1"),
    "t06_throughput": (lambda s, d: flat(T.throughput(measured(batch(s, d)), "1 day"), "start").drop("p95"), "select date_trunc('day', ts) as start, event_type as topic, count(*) as n, count(*) filter (where value>90) as rejects from events group by 1,2"),
    "t07_hot_spots": (lambda s, d: flat(T.hot_spots(batch(s, d).withColumnRenamed("event_type", "topic"), "3 days", "1 day"), "start"), "select date_trunc('day', ts) - to_days(cast(k as int)) as start, event_type as topic, count(*) as n from events, range(0,3) r(k) group by 1,2"),
    "t08_sessions": (lambda s, d: flat(T.sessions(batch(s, d), "user_id", "2 hours"), "start", "end"), "select user_id, min(ts) as start, max(ts) + interval 2 hours as end, count(*) as n from (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 hours then 0 else 1 end nw from events)) group by user_id, g"),
    "t09_stream_ewma": (ewma, f"select user_id, event_id as seq, round(list_reduce(list(value) over (partition by user_id order by event_id), lambda m, v: 0.15*v+0.85*m),6) as ewma from events qualify ts <= {MARK}"),
    "t09_stream_thresholds": (
        thresholds,
        """with a as (select user_id, event_id, ts, value, avg(value) over w m, quantile_cont(value,0.9) over v alpha, quantile_cont(value,0.95) over v beta, quantile_cont(value,0.99) over v z from events window w as (partition by user_id order by event_id), v as (partition by user_id order by event_id rows between 89 preceding and current row)),
 c as (select *, sum(value-m-1) over (partition by user_id order by event_id) c from a), p as (select *, c-min(c) over (partition by user_id order by event_id) > 50 as drift from c), f as (select *, bool_or(drift) over (partition by user_id order by event_id rows between 20 preceding and current row) held from p)
 select user_id, event_id as seq, round(alpha,6) as alpha, round(beta,6) as beta, round(z,6) as z, drift, round(last_value(case when not held then alpha end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding),6) as frozen from f""",
    ),
    "t10_replay": (lambda s, d: T.replay(batch(s, d), "2024-01-15").groupBy("event_type").agg(F.count("*").alias("n")), "select event_type, count(*) as n from events where ts >= timestamp '2024-01-15' group by 1"),
}
