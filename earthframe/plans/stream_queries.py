"""Registered queries over event logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from earthframe.plans.registry import query, sql_view, table
from earthframe.streaming.admission import admit_batch, admit_stream, with_bursts
from earthframe.streaming.lookups import first_seen_batch, first_seen_stream, lookup_key
from earthframe.streaming.run import drain
from earthframe.streaming.stages import stage_stream, stage_summary

LIMIT, WINDOW = 3, 14_400.0
TTL = 21_600.0


def _admissions(events):
    return events.select(F.col("user_id").alias("client"), "event_id", "ts")


def _verdicts(df):
    return df.select("client", "event_id", "admitted", F.round("retry_after", 3).alias("retry_after"))


SLIDING_SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS client, event_id, epoch_us(ts) / 1000000.0e0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
run(client, rn, event_id, hits, admitted, retry) AS (SELECT client, rn, event_id, [t], TRUE, CAST(NULL AS DOUBLE) FROM e WHERE rn = 1 UNION ALL
 SELECT client, rn, event_id, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3, CASE WHEN len(live) >= 3 THEN live[1] + 14400 - t END
 FROM (SELECT e.client, e.rn, e.event_id, e.t, list_filter(r.hits, lambda h: h > e.t - 14400) AS live FROM run r JOIN e ON e.client = r.client AND e.rn = r.rn + 1))
SELECT client, event_id, admitted, round(retry, 3) AS retry_after FROM run
"""


@query("w7_sliding_admission", SLIDING_SQL)
def sliding_admission(spark, sf):
    return _verdicts(admit_batch(_admissions(table(spark, sf, "events")), LIMIT, WINDOW))


@query("w7_single_slot", """
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS client, event_id, ts, lead(ts) OVER w AS nxt, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
chain(client, rn, ts) AS (SELECT client, rn, ts FROM e WHERE rn = 1 UNION ALL
 SELECT client, rn, ts FROM (SELECT e.client, e.rn, e.ts, row_number() OVER (PARTITION BY e.client, c.rn ORDER BY e.rn) AS first FROM chain c JOIN e ON e.client = c.client AND e.ts >= c.ts + INTERVAL 14400 SECOND AND e.rn > c.rn) WHERE first = 1)
SELECT e.client, count(*) AS events, count(c.rn) AS admitted FROM e LEFT JOIN chain c ON c.client = e.client AND c.rn = e.rn GROUP BY e.client
""")
def single_slot(spark, sf):
    """With one slot the admitted hits form a chain SQL can follow."""
    v = admit_batch(_admissions(table(spark, sf, "events")), 1, WINDOW)
    return v.groupBy("client").agg(F.count(F.lit(1)).alias("events"),
                                   F.count_if("admitted").alias("admitted"))


@query("w7_burst_count", """
SELECT client, sum(fresh) AS bursts FROM (SELECT client, CASE WHEN b - lag(b) OVER (PARTITION BY client ORDER BY b) <= 1 THEN 0 ELSE 1 END AS fresh FROM (
 SELECT DISTINCT user_id AS client, epoch_us(ts) // 14400000000 AS b FROM events)) GROUP BY client
""")
def burst_count(spark, sf):
    e = _admissions(table(spark, sf, "events"))
    return with_bursts(e, WINDOW).groupBy("client").agg(F.max("burst").alias("bursts"))


def _event_stream(spark, sf):
    """The events table as a bounded stream (a glob, as file streams want a pattern)."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


@query("x1_admission_stream", SLIDING_SQL)
def admission_stream(spark, sf):
    return _verdicts(drain(admit_stream(_admissions(_event_stream(spark, sf)), LIMIT, WINDOW)))


def _lookups(events):
    return events.select(
        lookup_key(F.lit("geo"), F.concat(F.lit(" User  "), F.col("user_id").cast("string"))).alias("key"),
        "event_id", "ts", (F.col("event_type") != "error").alias("ok"))


FIRST_SEEN_SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT 'geo|user ' || user_id AS key, event_id, ts, event_type <> 'error' AS ok FROM events),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM e WHERE ok),
chain(key, rn, ts) AS (SELECT key, rn, ts FROM r WHERE rn = 1 UNION ALL
 SELECT key, rn, ts FROM (SELECT r.key, r.rn, r.ts, row_number() OVER (PARTITION BY r.key, c.rn ORDER BY r.rn) AS first FROM chain c JOIN r ON r.key = c.key AND r.ts > c.ts + INTERVAL 21600 SECOND) WHERE first = 1)
SELECT a.key, (SELECT count(*) FROM chain c WHERE c.key = a.key) AS resolved, a.n AS lookups FROM (SELECT key, count(*) AS n FROM e GROUP BY key) a
"""


def _resolved(verdicts):
    return verdicts.groupBy("key").agg(F.count_if(F.col("action") == "resolve").alias("resolved"),
                                       F.count(F.lit(1)).alias("lookups"))


@query("x2_first_seen", FIRST_SEEN_SQL)
def first_seen(spark, sf):
    return _resolved(first_seen_batch(_lookups(table(spark, sf, "events")), TTL))


@query("x2_first_seen_stream", FIRST_SEEN_SQL)
def first_seen_over_stream(spark, sf):
    return _resolved(drain(first_seen_stream(_lookups(_event_stream(spark, sf)), TTL)))


sql_view("run_log", """
SELECT ts, event_type AS stage, CASE WHEN user_id % 4 = 0 THEN 'error:Timeout' ELSE 'ok' END AS outcome, floor(value * 10) AS ms FROM events
""")


def run_log(events):
    return events.select("ts", F.format_string(
        "run stage=%s outcome=%s ms=%d", F.col("event_type"),
        F.when(F.col("user_id") % 4 == 0, "error:Timeout").otherwise("ok"),
        F.floor(F.col("value") * 10)).alias("line"))


@query("a22_stage_summary", """
SELECT '' AS workflow, stage, outcome, count(*) AS n, sum(ms) AS total_ms, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms
FROM run_log GROUP BY stage, outcome
""")
def stage_rollup(spark, sf):
    return stage_summary(run_log(table(spark, sf, "events"))).withColumns(
        {c: F.round(c, 6) for c in ("mean_ms", "p95_ms")})


@query("x3_stage_minutes", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, stage, outcome, count(*) AS n, sum(ms) AS total_ms, max(ms) AS max_ms FROM run_log GROUP BY ALL
""")
def stage_minutes(spark, sf):
    log = run_log(table(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    m = stage_stream(log)
    return m.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))
