"""Queries over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import merge, quality, search, segments, sequences
from strandline.plans.registry import ORACLES, QUERIES, register
from strandline.sources.tables import table

MS = "(epoch_us(ts) // 1000)"


def events(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", ms.alias("ms"))


register("tag_counts", "SELECT lower(event_type) AS tag, count(*) AS n, arg_min(event_type, event_id) AS label FROM events GROUP BY 1")(
    lambda spark, sf: search.tag_counts(table(spark, sf, "events"), "event_type", "event_id")
)


def _versions(spark, sf):
    """Every order, and a copy of every order with other stamps."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("long").alias("stamp"), "o_orderstatus")
    return o, o.withColumn("stamp", F.col("stamp") + F.col("o_orderkey") % 5 - 2)


SIDES = """a AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS stamp, o_orderstatus FROM orders),
b AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT + o_orderkey % 5 - 2 AS stamp, o_orderstatus FROM orders)"""

register("sync_verdicts", f"""WITH {SIDES} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN b.stamp IS NULL OR a.stamp > b.stamp THEN 'upload' WHEN a.stamp IS NULL OR b.stamp > a.stamp THEN 'download' ELSE 'same' END AS verdict
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")(lambda spark, sf: merge.verdicts(*_versions(spark, sf), "o_orderkey", "stamp"))

register("last_writer_wins", f"""WITH {SIDES},
u AS (SELECT *, 1 AS l, false AS deleted FROM a UNION ALL SELECT *, 0, o_orderstatus = 'P' FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY stamp DESC, l DESC) AS r FROM u)
SELECT o_orderkey, stamp, o_orderstatus FROM k WHERE r = 1 AND NOT deleted""")(
    lambda spark, sf: (lambda a, b: merge.last_writer(a.withColumn("deleted", F.lit(False)), b.withColumn("deleted", F.col("o_orderstatus") == "P"), "o_orderkey", "stamp", "deleted"))(*_versions(spark, sf))
)

register("fragment_accounting", """
WITH u AS (SELECT l_orderkey AS o_orderkey, count(*) AS uses FROM lineitem GROUP BY 1)
SELECT coalesce(o.o_orderkey, u.o_orderkey) AS o_orderkey,
  CASE WHEN o.o_orderkey IS NULL THEN 'unknown' WHEN uses IS NULL THEN 'unused' WHEN uses > 1 THEN 'repeated' ELSE 'once' END AS state
FROM (SELECT DISTINCT o_orderkey FROM orders) o FULL JOIN u ON o.o_orderkey = u.o_orderkey""")(
    lambda spark, sf: merge.accounting(table(spark, sf, "orders"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
)

register("clip_overlaps", f"""
SELECT event_id, {MS} AS ms, greatest(least({MS} + 3600000, coalesce(lead({MS}) OVER (PARTITION BY user_id ORDER BY ts, event_id), {MS} + 3600000)), {MS} + 250) AS end_ms FROM events""")(
    lambda spark, sf: segments.clip_overlaps(events(spark, sf).withColumn("end_ms", F.col("ms") + 3_600_000), "user_id", "ms", "end_ms", "event_id", 250).select("event_id", "ms", "end_ms")
)

register("asof_previous", f"""
WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 1),
p AS (SELECT user_id, event_id, {MS} AS ms FROM events WHERE event_type NOT IN (FROM k)),
m AS (SELECT user_id, event_id, {MS} AS ms FROM events WHERE event_type IN (FROM k)),
j AS (SELECT p.user_id, p.event_id, m.event_id AS match, row_number() OVER (PARTITION BY p.event_id ORDER BY m.ms DESC, m.event_id DESC) AS r
  FROM p LEFT JOIN m ON p.user_id = m.user_id AND m.ms <= p.ms)
SELECT user_id, event_id, match FROM j WHERE r = 1""")(
    lambda spark, sf: (
        lambda e, k: segments.asof_previous(e.where(F.col("event_type") != k), e.where(F.col("event_type") == k).withColumn("mark", F.col("event_id")), "user_id", "ms", "event_id", "mark")
    )(events(spark, sf), events(spark, sf).agg(F.min("event_type")).first()[0])
)

register("interval_overlaps", f"""
WITH e AS (SELECT user_id, event_id AS id, {MS} AS s, {MS} + 7200000 AS z FROM events)
SELECT a.user_id, a.id AS a_id, b.id AS b_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.s < b.z AND a.z > b.s WHERE a.id < b.id""")(
    lambda spark, sf: (lambda e: segments.interval_overlaps(e, e, "user_id", 7_200_000).where("a_id < b_id"))(
        events(spark, sf).select("user_id", F.col("event_id").alias("id"), F.col("ms").alias("start"), (F.col("ms") + 7_200_000).alias("end"))
    )
)

register("gap_sessions", f"""
WITH n AS (SELECT user_id, event_id, {MS} AS ms, CASE WHEN {MS} - lag({MS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id)::BIGINT AS session FROM n)
SELECT user_id, session, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM s GROUP BY 1, 2""")(
    lambda spark, sf: segments.gap_sessions(events(spark, sf), "user_id", "ms", "event_id", 1_800_000)
)

register("sum_ahead", f"""
SELECT event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY {MS} RANGE BETWEEN CURRENT ROW AND 19999999 FOLLOWING)::BIGINT AS ahead FROM events""")(
    lambda spark, sf: segments.sum_ahead(events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long")), "user_id", "ms", "cents", 20_000_000).select("event_id", "ahead")
)

register("rate_limit", f"""
WITH RECURSIVE r AS (SELECT event_id, user_id, {MS} AS ms, row_number() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) AS k FROM events),
g AS (SELECT event_id, user_id, k, true AS allowed, [ms] AS held FROM r WHERE k = 1
  UNION ALL SELECT event_id, user_id, k, len(h) < 2, CASE WHEN len(h) < 2 THEN h || [ms] ELSE h END FROM (SELECT r.*, list_filter(g.held, lambda x: x > r.ms - 3600000) AS h FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1))
SELECT event_id, allowed FROM g""")(
    lambda spark, sf: sequences.rate_limit(events(spark, sf), "user_id", "ms", "event_id", 3_600_000, 2).select("event_id", "allowed")
)

register("cumulative_share", """
SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / sum(l_quantity) OVER (PARTITION BY l_orderkey), 4) AS share FROM lineitem""")(
    lambda spark, sf: segments.cumulative_share(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "share")
)

register("fill_gaps", f"""
WITH v AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS a, min(event_id) OVER (PARTITION BY user_id) AS low, max(event_id) OVER (PARTITION BY user_id) + 1 AS high,
  min(CASE WHEN v IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM v),
j AS (SELECT k.*, coalesce(x.v, 0) AS va, coalesce(y.v, 1000) AS vb, coalesce(a, low) AS pa, coalesce(b, high) AS pb FROM k LEFT JOIN v x ON x.event_id = a LEFT JOIN v y ON y.event_id = b)
SELECT event_id, round(coalesce(v, va + (vb - va) * coalesce((event_id - pa) / nullif(pb - pa, 0), 0)), 9) AS filled FROM j""")(
    lambda spark, sf: segments.fill_gaps(events(spark, sf).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value"))), "user_id", "event_id", "v", 1000.0).select("event_id", F.round("filled", 9).alias("filled"))
)

#: Events of three kinds as segments of one or two hours, the others as points.
_SEG = f"""s AS (SELECT user_id, event_id AS id, {MS} AS a, {MS} + 3600000 * (1 + event_id % 2) AS z FROM events WHERE event_id % 3 = 0), p AS (SELECT user_id, event_id, {MS} AS ms FROM events WHERE event_id % 3 <> 0)"""


def _points(spark, sf):
    e = events(spark, sf)
    seg = e.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("id"), F.col("ms").alias("start"), (F.col("ms") + 3_600_000 * (1 + F.col("event_id") % 2)).alias("end"))
    return e.where("event_id % 3 <> 0").select("user_id", "event_id", "ms"), seg


register("segment_at", f"""
WITH {_SEG}, j AS (SELECT p.*, s.id, s.z, row_number() OVER (PARTITION BY event_id ORDER BY s.a DESC, s.z DESC, s.id DESC) AS k FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.a <= p.ms)
SELECT user_id, event_id, CASE WHEN ms < z THEN id END AS match FROM j WHERE k = 1""")(lambda spark, sf: segments.segment_at(*_points(spark, sf), "user_id", "ms", "event_id"))
register("next_end", f"""
WITH {_SEG}, j AS (SELECT p.*, s.id, row_number() OVER (PARTITION BY event_id ORDER BY s.z, s.id) AS k FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.z > p.ms)
SELECT user_id, event_id, id AS match FROM j WHERE k = 1""")(lambda spark, sf: segments.next_end(*_points(spark, sf), "user_id", "ms", "event_id"))


def _units(spark, sf):
    u = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("place")).agg(F.sum("l_quantity").alias("q"), F.max("l_returnflag").alias("flag"))
    return u.select("l_orderkey", "place", (F.col("place") * 20).cast("double").alias("start"), (F.col("place") * 20 + F.least(F.col("q"), F.lit(30.0))).alias("end"), "flag")


_UNITS = "u AS (SELECT l_orderkey, l_linenumber AS place, (l_linenumber * 20)::DOUBLE AS start, l_linenumber * 20 + least(sum(l_quantity), 30) AS \"end\", max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"
_NOW = lambda spark, sf: table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 100).cast("double").alias("at"))

register("unit_limits", f"""
WITH {_UNITS}, l AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY l_orderkey ORDER BY place), "end" + 2) AS hard FROM u) SELECT l_orderkey, place, hard, least(hard, "end" + 2) AS soft FROM l""")(
    lambda spark, sf: segments.soft_hard_limits(_units(spark, sf), "l_orderkey").select("l_orderkey", "place", "hard", "soft")
)
register("covered_seconds", f"""
WITH {_UNITS}, n AS (SELECT o_orderkey AS l_orderkey, (o_orderkey % 100)::DOUBLE AS pos FROM orders)
SELECT n.l_orderkey, greatest(0, min(start) - any_value(pos)) AS seconds FROM n LEFT JOIN u ON u.l_orderkey = n.l_orderkey AND flag <> 'R' AND "end" > pos GROUP BY 1""")(
    lambda spark, sf: segments.covered_until(_units(spark, sf), _NOW(spark, sf), "l_orderkey", F.col("flag") != "R")
)
register("units_to_make", f"""
WITH {_UNITS}, n AS (SELECT o_orderkey AS l_orderkey, (o_orderkey % 100)::DOUBLE AS pos FROM orders)
SELECT l_orderkey, place FROM (SELECT u.l_orderkey, place, row_number() OVER (PARTITION BY u.l_orderkey ORDER BY start, place) AS k FROM u JOIN n USING (l_orderkey) WHERE flag <> 'R' AND "end" > pos AND start <= pos + 60) WHERE k <= 2""")(
    lambda spark, sf: segments.units_to_make(_units(spark, sf), _NOW(spark, sf), "l_orderkey", F.col("flag") != "R", 60.0, 2)
)
register("owned_chunks", """
WITH d AS (SELECT doc_id, n_chars, unnest(range(0, greatest(ceil((n_chars - 12) / 348.0)::BIGINT - 1, 0) + 1)) AS piece FROM documents WHERE n_chars > 0)
SELECT doc_id, piece, piece * 348 AS start, least(piece * 348 + 360, n_chars) AS "end", CASE WHEN piece = 0 THEN 0 ELSE piece * 348 + 6 END AS "limit" FROM d""")(
    lambda spark, sf: segments.owned_chunks(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 360, 12).select("doc_id", "piece", "start", "end", "limit")
)

register("delay_metrics", """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95, round(avg((value <= 50)::INT), 6) AS share FROM events GROUP BY 1""")(
    lambda spark, sf: events(spark, sf).groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), segments.percentile("value", 0.95).alias("p95"), F.round(F.avg((F.col("value") <= 50).cast("int")), 6).alias("share")
    )
)

register("fixed_windows", """
WITH d AS (SELECT doc_id, n_chars, unnest(range(0, greatest(ceil((n_chars - 12) / 348.0)::BIGINT - 1, 0) + 1)) AS piece FROM documents WHERE n_chars > 0)
SELECT doc_id, piece, piece * 348 AS start, least(piece * 348 + 360, n_chars) AS "end" FROM d""")(
    lambda spark, sf: segments.fixed_windows(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 360, 12).select("doc_id", "piece", "start", "end")
)

register("watch_state", """
SELECT event_id, CASE WHEN value < 15 THEN 'new' WHEN 100 - value <= 30 OR value >= 95 THEN 'done' ELSE 'watching' END AS state FROM events""")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", T.watch_state(F.col("value"), F.lit(100.0)).alias("state"))
)

register("clock", """
WITH s AS (SELECT event_id, greatest(coalesce(floor(value * 60 + 0.5), 0), 0)::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock FROM s""")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", T.clock(F.col("value") * 60).alias("clock"))
)

_SPEECH = """WITH s AS (SELECT conv_id, turn, CASE turn % 9 WHEN 8 THEN '' WHEN 7 THEN 'Subtítulos por la comunidad de Amara.org' ELSE text END AS text,
  -(conv_id * 7 + turn) % 16 / 10 AS logprob, (conv_id + turn * 3) % 10 / 10 AS silence, 1 + (conv_id + turn) % 20 / 10 AS compression FROM conversations),
c AS (SELECT *, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN contains(text, 'Amara.org') THEN 'pattern' WHEN (silence > 0.72 AND logprob < -1) OR (compression > 2.6 AND logprob < -0.7) THEN 'metric' ELSE 'ok' END AS class FROM s)"""


def _speech(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "CASE turn % 9 WHEN 8 THEN '' WHEN 7 THEN 'Subtítulos por la comunidad de Amara.org' ELSE text END AS text",
        "-(conv_id * 7 + turn) % 16 / 10 AS logprob", "(conv_id + turn * 3) % 10 / 10 AS silence", "1 + (conv_id + turn) % 20 / 10 AS compression",
    )


register("asr_class", f"""{_SPEECH} SELECT conv_id, turn, class,
  CASE WHEN (silence > 0.55 AND logprob < -1.0) OR (compression > 2.4 AND logprob < -0.5) OR (logprob < -1.2 AND compression > 1.8) THEN 'drop'
    WHEN (logprob < -0.6 AND silence > 0.3) OR (logprob < -0.9 AND compression > 1.5) THEN 'doubtful' ELSE 'fine' END AS suspect FROM c""")(
    lambda spark, sf: _speech(spark, sf).select("conv_id", "turn", quality.asr_class(F.col("text"), F.col("logprob"), F.col("silence"), F.col("compression")).alias("class"),
        quality.asr_suspect(F.col("logprob"), F.col("silence"), F.col("compression")).alias("suspect"))
)

register("asr_report", f"""{_SPEECH},
g AS (SELECT *, round(greatest(0, least(1, (logprob + 1.5) / 1.4)), 3) < 0.42 OR silence > 0.48 OR compression > 2.35 AS grey FROM c),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (class = 'ok') AS kept, count(*) FILTER (class = 'empty') AS "empty", count(*) FILTER (class IN ('pattern', 'metric')) AS removed,
  count(*) FILTER (class = 'pattern') AS patterns, count(*) FILTER (class = 'ok' AND grey) AS doubtful FROM g GROUP BY 1),
r AS (SELECT *, removed / n AS r, coalesce(doubtful / nullif(kept, 0), 0) AS d FROM n)
SELECT * EXCLUDE (r, d), patterns > 0 OR (kept = 0 AND removed > 0) OR r > 0.15 OR d > 0.25 AS review, patterns > 0 OR r > 0.25 OR d > 0.35 AS confirm FROM r""")(
    lambda spark, sf: quality.asr_report(_speech(spark, sf), "conv_id")
)

# the names under which an earlier release ran these on all rows
for _n in ("sync_verdicts", "last_writer_wins", "fragment_accounting", "interval_overlaps"):
    QUERIES[f"{_n}_all"], ORACLES[f"{_n}_all"] = QUERIES[_n], ORACLES[_n]
