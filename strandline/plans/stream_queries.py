"""Queries that run the streaming jobs over the tables until they are drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.plans.registry import ORACLES, register
from strandline.plans.time_queries import MS
from strandline.sources.shared import settled, shared_dir
from strandline.sources.tables import table
from strandline.streaming import jobs


def _base(spark) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _shuffled(spark, sf, base: str):
    """Events as a stream of sixteen files in four lots, rows up to two hours away from their order, and a function that closes it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    moved = F.col("ms") + F.pmod(F.xxhash64("event_id"), F.lit(7_200_000))
    low, high = e.agg(F.min("ms"), F.max("ms") + 7_200_001).first()
    dealt = settled(e.withColumn("lot", F.floor((moved - low) / (high - low) * 4)).repartition(4, F.xxhash64("event_id")))
    for k in range(4):
        dealt.where(F.col("lot") == k).drop("lot").write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    return stream, lambda: jobs.closing(e, "ms", high + 10**9).write.mode("append").parquet(f"{base}/in")


def _decided(spark, sf, rule):
    """What a rule decides over the shuffled events, drained, closed and drained again from the same checkpoint."""
    base = _base(spark)
    stream, close = _shuffled(spark, sf, base)
    jobs.appended(rule(stream), base)
    close()
    return jobs.appended(rule(stream), base)


def _events(spark, sf):
    e = jobs.source(spark, f"{sf}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def _windows(spark, sf):
    base, made = _base(spark), jobs.window_metrics(_events(spark, sf), "ts", "value", "event_type")
    jobs.drain(made, base, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/windows"), "complete")
    return spark.read.parquet(f"{base}/windows").withColumn("start", F.unix_millis("start"))


register("stream_windows", """
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1, 2""")(_windows)

register("stream_admitted", ORACLES["rate_limit"])(lambda spark, sf: _decided(spark, sf, lambda e: jobs.admitted(e, "user_id", "ms", "event_id", 3_600_000, 2)).select("event_id", "allowed"))
register("stream_quarantine", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type = 'error' AS bad, {MS} AS ms, row_number() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) AS k FROM events),
s AS (SELECT event_id, user_id, k, CASE WHEN bad THEN 'closing' ELSE 'tried' END AS state, CASE WHEN bad THEN ms + 7200000 ELSE 0 END AS until FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN s.until > e.ms THEN 'shut' WHEN bad THEN 'closing' ELSE 'tried' END, CASE WHEN s.until > e.ms THEN s.until WHEN bad THEN e.ms + 7200000 ELSE 0 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, state FROM s""")(lambda spark, sf: _decided(spark, sf, lambda e: jobs.quarantined(e, "user_id", "ms", "event_id", "event_type", "error", 7_200_000)).select("event_id", "state"))
register("stream_active_segments", f"""
WITH s AS (SELECT user_id, event_id AS id, {MS} AS a, {MS} + 3600000 AS z FROM events WHERE event_type = 'signup') SELECT e.event_id, s.id FROM events e JOIN s ON s.user_id = e.user_id AND s.a <= {MS} AND {MS} < s.z""")(
    lambda spark, sf: jobs.appended(jobs.active_segments(_events(spark, sf).select("user_id", "event_id", "ms"), table(spark, sf, "events").where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start"), (F.unix_millis(F.col("ts").cast("timestamp")) + 3_600_000).alias("end")), "user_id", "ms", "event_id"), _base(spark))
)
register("stream_merged", """
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_linenumber DESC) AS r FROM lineitem)
SELECT l_orderkey, max(l_partkey) AS l_partkey FROM k WHERE r = 1 AND l_partkey % 5 <> 0 GROUP BY 1""")(
    lambda spark, sf: jobs.merged_table(jobs.source(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", (F.col("l_partkey") % 5 == 0).alias("gone")), _base(spark), "l_orderkey", "l_partkey", "gone").select("l_orderkey", "l_partkey")
)
