"""Joins along time, over events and the verdicts on their hours."""

from pyspark.sql import functions as F

from tierwatch.functions.shared import scratch_path, stage
from tierwatch.operators import anomaly, temporal
from tierwatch.streaming.time_points import POINT, count_windows, follow_windows
from workload.common import query, r6, rounded, table
from workload.detection import _EVENTS, _time_sql


def _verdicts(spark, sf_dir):
    counts = stage(anomaly.time_group_counts(table(spark, sf_dir, "events"), "ts", "event_type", bucket="hour"), "counts")
    return anomaly.time_anomalies(counts)


def _text(name):
    return F.col(name).cast("timestamp_ntz").cast("string").alias(name)


_VERDICTS = f"v AS ({_time_sql(_EVENTS, '0').replace('CAST(timestamp AS VARCHAR)', 'timestamp')})"


@query(
    f"WITH {_VERDICTS} SELECT event_id, CAST(v.timestamp AS VARCHAR) AS timestamp, {r6('distancia')}, outliers "
    "FROM events ASOF LEFT JOIN v ON events.ts >= v.timestamp"
)
def events_with_verdict(spark, sf_dir):
    """Every event with the latest verdict on an hour at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    found = temporal.as_of_join(events, _verdicts(spark, sf_dir), "ts", "timestamp")
    return rounded(found.select("event_id", _text("timestamp"), "distancia", "outliers"), "distancia")


@query(
    """WITH kinds AS (SELECT MIN(event_type) AS a, MAX(event_type) AS b FROM events),
l AS (SELECT event_id, user_id, ts FROM events, kinds WHERE event_type = a),
r AS (SELECT event_id AS last_id, user_id, ts AS last_ts, value AS last_value FROM events, kinds WHERE event_type = b)
SELECT l.event_id AS event_id, last_id, CAST(last_ts AS VARCHAR) AS last_ts, last_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.last_ts"""
)
def last_event_of_user(spark, sf_dir):
    """Events of one kind, each with its user's latest event of another."""
    events = table(spark, sf_dir, "events")
    kinds = events.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    left = events.where(F.col("event_type") == kinds["a"]).select("event_id", "user_id", "ts")
    right = events.where(F.col("event_type") == kinds["b"]).select(
        F.col("event_id").alias("last_id"), "user_id", F.col("ts").alias("last_ts"), F.col("value").alias("last_value")
    )
    found = temporal.as_of_join(left, right, "ts", "last_ts", ["user_id"])
    return found.select("event_id", "last_id", _text("last_ts"), "last_value")


# Sessions: a user's events at most a day apart.
_DAY = 86_400
_SESSIONS = """steps AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM steps),
sessions AS (SELECT user_id, MIN(ts) AS "start", MAX(ts) AS "end", COUNT(*) AS n FROM numbered GROUP BY user_id, run)"""


@query(f'WITH {_SESSIONS} SELECT user_id, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end", n FROM sessions')
def user_sessions(spark, sf_dir):
    found = temporal.merge_runs(table(spark, sf_dir, "events"), "ts", _DAY, ["user_id"])
    return found.select("user_id", _text("start"), _text("end"), "n")


# Runs of outstanding hours: distances beyond the 90th percentile, hours next to each other merged.
_RUNS = f"""{_VERDICTS},
far AS (SELECT timestamp FROM v WHERE distancia > (SELECT QUANTILE_CONT(distancia, 0.9) FROM v)),
fresh AS (SELECT timestamp, CASE WHEN timestamp - LAG(timestamp) OVER (ORDER BY timestamp) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM far),
labelled AS (SELECT timestamp, SUM(f) OVER (ORDER BY timestamp) AS run FROM fresh),
runs AS (SELECT MIN(timestamp) AS "start", MAX(timestamp) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS "end", COUNT(*) AS n FROM labelled GROUP BY run)"""


def _runs(spark, sf_dir):
    verdicts = stage(_verdicts(spark, sf_dir), "verdicts")
    limit = verdicts.agg(F.percentile("distancia", 0.9)).first()[0]
    runs = temporal.merge_runs(verdicts.where(F.col("distancia") > limit), "timestamp", 3600)
    return runs.withColumn("end", F.col("end") + F.expr("INTERVAL 1 HOUR") - F.expr("INTERVAL 0.000001 SECOND"))


@query(
    f"""WITH {_RUNS} SELECT event_id, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end", n
FROM events JOIN runs ON ts >= "start" AND ts <= "end\""""
)
def events_in_outstanding_runs(spark, sf_dir):
    """Events inside the merged runs of outstanding hours."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    found = temporal.rows_in_intervals(events, "ts", _runs(spark, sf_dir))
    return found.select("event_id", _text("start"), _text("end"), "n")


@query(
    f"""WITH {_SESSIONS}, {_RUNS} SELECT user_id, CAST(s."start" AS VARCHAR) AS "start", CAST(r."start" AS VARCHAR) AS other_start, r.n AS n
FROM sessions s JOIN runs r ON s."start" <= r."end" AND r."start" <= s."end\""""
)
def sessions_over_outstanding_runs(spark, sf_dir):
    """Sessions and the runs of outstanding hours that they overlap."""
    sessions = temporal.merge_runs(table(spark, sf_dir, "events"), "ts", _DAY, ["user_id"]).drop("n")
    found = temporal.overlapping(sessions, _runs(spark, sf_dir))
    return found.select("user_id", _text("start"), _text("other_start"), "n")


@query(
    f"WITH counts AS ({_EVENTS.removeprefix('WITH counts AS (')}, "
    "run AS (SELECT timestamp, grupo, n, COUNT(*) OVER w AS windows, AVG(n) OVER w AS mean, STDDEV_POP(n) OVER w AS std "
    "FROM counts WINDOW w AS (PARTITION BY grupo ORDER BY timestamp)) "
    f"SELECT CAST(timestamp AS VARCHAR) AS timestamp, grupo, n, windows, {r6('mean')}, {r6('std')} FROM run"
)
def streamed_counts(spark, sf_dir):
    """Events as a stream: every closed hour of a group with the group's running statistics."""
    return _streamed(spark, sf_dir).select(
        _text("timestamp"), "grupo", "n", "windows", (F.round("mean", 6) + F.lit(0.0)).alias("mean"),
        (F.round(F.sqrt(F.col("m2") / F.col("windows")), 6) + F.lit(0.0)).alias("std"),
    )


@query(_time_sql(_EVENTS, "0"))
def streamed_time_points(spark, sf_dir):
    """Events as a stream, then the report on all closed hours: the rows of the batch report."""
    found = anomaly.time_anomalies(stage(_streamed(spark, sf_dir).select("timestamp", "grupo", "n"), "streamed"))
    return rounded(found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz").cast("string")), "distancia")


def _streamed(spark, sf_dir):
    """All events through the stream, and then one record far ahead in time that closes their last windows."""
    shape = table(spark, sf_dir, "events").schema
    source = scratch_path(spark, "ahead")
    last = table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    last.write.parquet(source)
    counts, points = scratch_path(spark, "windows"), scratch_path(spark, "points")
    events = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("ts", "event_type")
    ahead = spark.readStream.schema(shape).parquet(source).select("ts", F.lit(None).cast("string").alias("event_type"))
    records = events.unionByName(ahead)
    count_windows(records, "ts", "event_type", counts, scratch_path(spark, "checkpoint")).awaitTermination()
    follow_windows(spark, counts, points, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(POINT).parquet(points).where("grupo is not null")


_KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    f"WITH {_VERDICTS}, {_EVENTS.removeprefix('WITH ')}, wide AS (SELECT timestamp, "
    + ", ".join(f"CAST(SUM(CASE WHEN grupo = '{k}' THEN n ELSE 0 END) AS BIGINT) AS {k}" for k in _KINDS)
    + f" FROM counts GROUP BY timestamp) SELECT CAST(timestamp AS VARCHAR) AS timestamp, {', '.join(_KINDS)}, {r6('distancia')}, outliers "
    "FROM wide JOIN v USING (timestamp)"
)
def hourly_report(spark, sf_dir):
    """The verdict on every hour beside the counts that it comes from."""
    counts = stage(anomaly.time_group_counts(table(spark, sf_dir, "events"), "ts", "event_type", bucket="hour"), "counts")
    report = anomaly.time_report(counts, _KINDS)
    return rounded(report.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz").cast("string")), "distancia")
