"""Queues, limits and windows over the event log, as batch replays of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..streaming import stateful as K

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PRIO = "CASE event_type WHEN 'purchase' THEN 'critical' WHEN 'signup' THEN 'high' WHEN 'click' THEN 'normal' ELSE 'low' END"
RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END"


def _jobs(spark, sf):
    p = F.when(F.col("event_type") == "purchase", "critical").when(F.col("event_type") == "signup", "high").when(F.col("event_type") == "click", "normal").otherwise("low")
    return table(spark, sf, "events").withColumn("priority", p)


@query(f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY {RANK}, ts, event_id) AS place FROM events")
def queue_order(spark, sf):
    return K.queue_order(_jobs(spark, sf), "priority", "ts", "event_id", "user_id").select("event_id", "place")


@query(f"SELECT event_id, row_number() OVER (ORDER BY {RANK}, ts, event_id) AS place FROM events")
def queue_all(spark, sf):
    """One queue for all users."""
    return K.queue_order(_jobs(spark, sf), "priority", "ts", "event_id").select("event_id", "place")


@query(f"SELECT {PRIO} AS priority, count(*) AS depth, count(DISTINCT user_id) AS owners FROM events GROUP BY 1")
def queue_stats(spark, sf):
    return _jobs(spark, sf).groupBy("priority").agg(F.count("*").alias("depth"), F.count_distinct("user_id").alias("owners"))


@query("SELECT user_id, event_type AS status, (SELECT count(*) FROM events e WHERE e.user_id = x.user_id) AS attempts FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1")
def job_state(spark, sf):
    return K.job_state(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "status", "attempts")


@query("WITH a AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS t FROM events GROUP BY 1, 2), m AS (SELECT max(ts) AS t FROM events) SELECT user_id, event_type, n, CAST(CASE WHEN event_type = 'click' THEN 60 * n WHEN event_type = 'view' THEN least(5 * n, 30) ELSE least(pow(2, n), 60) END AS INTEGER) AS delay, epoch(a.t) < epoch(m.t) - 86400 AS given_up FROM a, m")
def retry_state(spark, sf):
    d = table(spark, sf, "events")
    at = d.agg(F.max("ts").cast("string")).collect()[0][0]
    d = d.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    kind = F.when(F.col("event_type") == "click", "rate").when(F.col("event_type") == "view", "network").otherwise("server")
    return d.select("user_id", "event_type", "n", K.retry_delay(F.col("n"), kind).alias("delay"), K.expired(F.col("t"), F.lit(at)).alias("given_up"))


@query()
def rate_limited(spark, sf):
    return K.limited_batch(table(spark, sf, "events"), "user_id", 2, 3600.0).groupBy("key").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_windows(spark, sf):
    d = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.windowed_counts(d, "ts", "1 day", None, "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600 THEN 0 ELSE 1 END AS s FROM events), c AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM c GROUP BY user_id, k")
def user_sessions(spark, sf):
    d = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.sessions(d, "ts", "1 hour", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(*) AS documents FROM (SELECT DISTINCT sha256(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) FROM documents WHERE text IS NOT NULL) x")
def ingest_once(spark, sf):
    return K.ingest(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "text", "doc_id").agg(F.count("*").alias("documents"))
