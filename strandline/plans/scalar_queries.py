"""Queries of column functions: keys, links, tags, labels and pace."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import library as L
from strandline.functions import pace as P
from strandline.functions import text as T
from strandline.operators import quality
from strandline.plans.registry import register
from strandline.sources.tables import table

FOLD = f"translate(lower(%s), '{T.ACCENTED}', '{T.PLAIN}')"
NORMAL = f"trim(regexp_replace({FOLD % '%s'}, '\\s+', ' ', 'g'))"


def events(spark, sf):
    return table(spark, sf, "events")


register("normal_text", f"SELECT conv_id, turn, md5({NORMAL % 'text'}) AS digest FROM conversations")(
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", F.md5(L.normal(F.col("text"))).alias("digest"))
)

CLEAN = "trim(substr(trim(regexp_replace(regexp_replace(text, '[#,;]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 30))"
register("clean_tag", f"SELECT conv_id, turn, upper(substr(c, 1, 1)) || substr(c, 2) AS tag FROM (SELECT conv_id, turn, {CLEAN} AS c FROM conversations)")(
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", L.clean_tag(F.col("text")).alias("tag"))
)

TAGS = "SELECT c_custkey, [c_mktsegment] || [x FOR x IN range(1, c_custkey % 11 + 1)]::VARCHAR[] AS tags, CASE c_custkey % 4 WHEN 0 THEN ' # ' WHEN 1 THEN lower(c_mktsegment) ELSE 'new tag' END AS tag FROM customer"
register("add_tag", f"""
WITH t AS ({TAGS}), r AS (SELECT *, CASE WHEN trim(replace(tag, '#', ' ')) = '' THEN 'empty' WHEN lower(tag) = lower(tags[1]) THEN 'repeated' WHEN len(tags) >= 10 THEN 'full' ELSE '' END AS reason FROM t)
SELECT c_custkey, reason, array_to_string(CASE WHEN reason = '' THEN list_append(tags, 'New tag') ELSE tags END, ',') AS tags FROM r""")(
    lambda spark, sf: table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat(array(c_mktsegment), transform(filter(sequence(0L, c_custkey % 11), x -> x > 0), x -> string(x))) AS tags",
        "CASE c_custkey % 4 WHEN 0 THEN ' # ' WHEN 1 THEN lower(c_mktsegment) ELSE 'new tag' END AS tag",
    ).select("c_custkey", L.add_tag(F.col("tags"), F.col("tag")).alias("r")).select("c_custkey", "r.reason", F.array_join("r.tags", ",").alias("tags"))
)
register("remove_tag", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Kept' ELSE c_mktsegment || ',Kept' END AS tags FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", F.array_join(L.remove_tag(
        F.array("c_mktsegment", F.lit("Kept")), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise("none")), ",").alias("tags"))
)

register("seen_share", """
SELECT event_id, round(CASE WHEN value >= 15 AND (value >= 170 OR value / 200 >= 0.95) THEN 1 ELSE greatest(0, least(1, value / 200)) END, 9) AS share FROM events""")(
    lambda spark, sf: events(spark, sf).select("event_id", F.round(L.seen_share(F.col("value"), F.lit(200.0)), 9).alias("share"))
)
register("reading_state", "SELECT event_id, CASE WHEN floor(value)::INT % 101 <= 0 THEN 'unread' WHEN floor(value)::INT % 101 >= 98 THEN 'finished' ELSE 'reading' END AS state FROM events")(
    lambda spark, sf: events(spark, sf).select("event_id", L.reading_state(F.floor("value").cast("int") % 101).alias("state"))
)
register("chapter_state", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = l_orderkey % 5 THEN 'reading' WHEN l_returnflag = 'R' THEN 'read' WHEN l_returnflag = 'A' THEN 'pending'
  WHEN l_linenumber <= greatest(l_orderkey % 5, l_orderkey % 7) THEN 'read' ELSE 'pending' END AS state FROM lineitem""")(
    lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", L.chapter_state(
        F.col("l_linenumber"), F.col("l_orderkey") % 5, F.col("l_orderkey") % 7, F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "unread")).alias("state"))
)

register("store_keys", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'x' ELSE 'youtube' END AS platform,
  CASE o_orderkey % 3 WHEN 2 THEN 'vid' || o_orderkey ELSE o_orderkey::VARCHAR END AS id, CASE o_orderkey % 3 WHEN 1 THEN (o_orderkey % 4)::INT ELSE 0 END AS place,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://x.com/i/status/' || o_orderkey || CASE WHEN o_orderkey % 4 > 0 THEN '/video/' || (o_orderkey % 4 + 1) ELSE '' END
    ELSE 'https://www.youtube.com/watch?v=vid' || o_orderkey END AS url FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.key_parts(F.expr(
        "CASE o_orderkey % 3 WHEN 0 THEN concat('file:', o_orderkey) WHEN 1 THEN concat('x:', o_orderkey, ':', o_orderkey % 4) ELSE concat('vid', o_orderkey) END")).alias("k"))
    .select("o_orderkey", "k.platform", "k.id", "k.place", L.canonical_url(F.col("k")).alias("url"))
)
register("video_links", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE 'abc_' || (o_orderkey + 1000) END AS id FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.video_id(F.expr("""
      concat(CASE o_orderkey % 6 WHEN 0 THEN 'https://youtu.be/' WHEN 1 THEN 'http://www.youtube.com/watch?list=a&v=' WHEN 2 THEN ' https://m.youtube.com/shorts/'
        WHEN 3 THEN 'https://www.youtube.com/embed/' WHEN 4 THEN 'https://youtube.com/watch?v=' ELSE 'https://example.org/watch?v=' END, 'abc_', o_orderkey + 1000,
        CASE o_orderkey % 6 WHEN 1 THEN '&t=3' WHEN 2 THEN '?x=1' ELSE '' END)""")).alias("id"))
)
register("post_links", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE o_orderkey::VARCHAR END AS id, CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS place FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.post_id(F.expr("""
      concat(CASE o_orderkey % 4 WHEN 0 THEN 'https://x.com/some_one/status/' WHEN 1 THEN 'twitter.com/a/status/' WHEN 2 THEN 'https://mobile.twitter.com/i/web/status/' ELSE 'https://x.com/explore/' END,
        o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN '/video/2' WHEN 2 THEN '?s=20' ELSE '' END)""")).alias("p")).select("o_orderkey", "p.id", "p.place")
)
register("safe_links", "SELECT page_id, CASE WHEN url LIKE 'https://%' AND lower(regexp_extract(url, '^https://([^/?#:@]+)', 1)) = 'm.tionsh.example.net' THEN url ELSE '' END AS url FROM pages")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", L.safe_url(F.col("url"), "m.tionsh.example.net").alias("url"))
)
register("language_codes", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'pt' WHEN 2 THEN '' ELSE 'zh' END AS code, CASE o_orderkey % 3 WHEN 0 THEN 'en' END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'es' END AS target FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.short_code(F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN ' PT_br' WHEN 3 THEN 'zh' END")).alias("code"),
        L.direction(F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'EN-es' WHEN 1 THEN 'es-es' ELSE 'spanish' END")).alias("d")).select("o_orderkey", "code", "d.source", "d.target")
)
register("text_prints", """
SELECT conv_id, turn, sha256(coalesce(text, '')) AS sha, substr(sha256(coalesce(text, '')), 1, 12) AS short,
  list_reduce([2166136261::BIGINT] || [unicode(c)::BIGINT FOR c IN string_split(coalesce(text, ''), '') IF c <> ''], lambda h, c: ((xor(h, c) * 16777619) & 4294967295)::BIGINT) AS fnv FROM conversations""")(
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"),
        F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(12)).alias("short"), L.fnv1a(F.col("text")).alias("fnv"))
)
UNIT = "replace(regexp_replace(printf('%.1f', floor({0} * 10 + 0.5) / 10), '\\.0$', ''), '.', ',')"
register("size_labels", f"""
WITH b AS (SELECT o_orderkey, (o_totalprice * o_totalprice)::DOUBLE AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1048576 THEN floor(n / 1024 + 0.5)::BIGINT || ' KB' WHEN n < 1073741824 THEN {UNIT.format('n / 1048576')} || ' MB' ELSE {UNIT.format('n / 1073741824')} || ' GB' END AS size FROM b""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.size_label(F.col("o_totalprice") * F.col("o_totalprice")).alias("size"))
)
register("time_labels", """
WITH m AS (SELECT event_id, floor(value + 0.5)::BIGINT AS m, epoch_us(ts) // 1000 AS ms, ts FROM events)
SELECT event_id, CASE WHEN m < 0 THEN '' WHEN m < 1 THEN 'under 1 min' WHEN m < 60 THEN '~' || m || ' min' WHEN m % 60 > 0 THEN '~' || (m // 60) || ' h ' || (m % 60) || ' min' ELSE '~' || (m // 60) || ' h' END AS minutes,
  CASE WHEN a < 1 THEN 'just now' WHEN a < 60 THEN a || CASE a WHEN 1 THEN ' minute' ELSE ' minutes' END WHEN a < 1440 THEN (a // 60) || CASE a // 60 WHEN 1 THEN ' hour' ELSE ' hours' END ELSE (a // 1440) || CASE a // 1440 WHEN 1 THEN ' day' ELSE ' days' END END AS age,
  CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' ELSE strftime(ts, '%-d %b') END AS day
FROM (SELECT *, greatest(epoch_ms(TIMESTAMP '2024-01-10 00:00:00') - ms, 0) // 60000 AS a, DATE '2024-01-10' - ts::DATE AS d FROM m)""")(
    lambda spark, sf: events(spark, sf).select("event_id", L.minutes_label(F.col("value")).alias("minutes"),
        L.age_label(F.lit(1_704_844_800_000) - F.unix_millis(F.col("ts").cast("timestamp"))).alias("age"), L.day_label(F.col("ts").cast("date"), F.lit("2024-01-10").cast("date")).alias("day"))
)
#: n as a roman numeral by digits, in SQL text for both engines.
_DIGITS = {1000: ["", "M", "MM", "MMM"], **{b: ["", a, a * 2, a * 3, a + c, c, c + a, c + a * 2, c + a * 3, a + d] for b, a, c, d in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X"))}}
_ROMAN = " || ".join(f"CASE {{0}} % {b * 10} // {b} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END" for b, xs in _DIGITS.items())
register("roman_numerals", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN 0 ELSE (o_orderkey % 3999 + 1)::INT END AS value FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.roman(F.expr(
        "concat(" + _ROMAN.format("(o_orderkey % 3999 + 1)").replace("//", "div").replace(" || ", ", ") + ", CASE WHEN o_orderkey % 10 = 9 THEN 'IIII' ELSE '' END)")).alias("value"))
)

HALF = "floor(({0}) * 100 + 0.5) / 100"
register("pace_rates", f"""
WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS voice, (l_linenumber - 1) * 1.5::DOUBLE AS room, l_discount * 20 AS rate, l_tax * 50 AS delay FROM lineitem),
n AS (SELECT *, voice / nullif(room, 0) AS raw, CASE WHEN voice > 0.2 AND room > 0.2 THEN least(1, room * 1.12::DOUBLE / voice) WHEN voice > 0.2 THEN 0.75 ELSE 1 END AS f0 FROM e),
f AS (SELECT *, CASE WHEN f0 > 0.96::DOUBLE THEN 1 ELSE f0 END AS f1 FROM n), g AS (SELECT *, CASE WHEN delay > 1.5 THEN least(f1, 0.85) ELSE f1 END AS f2 FROM f),
h AS (SELECT *, greatest(0.75, CASE WHEN delay > 3 THEN least(f2, 0.75) ELSE f2 END) AS v FROM g)
SELECT l_orderkey, l_linenumber, CASE WHEN rate <= 0 THEN 1 ELSE least(greatest({HALF.format('floor(rate / 0.05 + 1e-9) * 0.05')}, 0.25), 2) END::DOUBLE AS down,
  CASE WHEN room <= 0 THEN 1.25 WHEN raw <= 1 THEN 1 ELSE least(1.25, {HALF.format('ceil(raw / 0.05 - 1e-9) * 0.05')}) END::DOUBLE AS needed,
  CASE WHEN room > 0.05 AND raw <= 1.12 THEN {HALF.format('greatest(1, raw)')} ELSE {HALF.format('least(greatest(CASE WHEN room + 1 > 0.05 THEN voice / (room + 1) END, 1.12), 1.25)')} END::DOUBLE AS voice_rate,
  CASE WHEN v >= 1 - 1e-9 THEN 1 ELSE {HALF.format('least(greatest(floor(v / 0.05 + 1e-9 + 0.5) * 0.05, 0.75), 1)')} END::DOUBLE AS video_rate FROM h""")(
    lambda spark, sf: table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity / 10 AS voice", "(l_linenumber - 1) * 1.5D AS room", "l_discount * 20 AS rate", "l_tax * 50 AS delay").select(
        "l_orderkey", "l_linenumber", P.rate_down(F.col("rate")).alias("down"), P.rate_needed(F.col("voice"), F.col("room")).alias("needed"),
        P.voice_rate(F.col("voice"), F.lit(0.0), F.col("room"), F.col("room") + 1).alias("voice_rate"), P.video_rate(F.col("voice"), F.col("room"), F.col("delay")).alias("video_rate"))
)
register("voice_seconds", """
SELECT conv_id, turn, round(CASE WHEN turn % 4 = 0 THEN 2.5 WHEN turn % 4 = 1 THEN 0 WHEN turn % 4 = 2 AND length(coalesce(text, '')) > 0 THEN length(text) / 17.5 ELSE length(coalesce(text, '')) * 1.15 / 17.5 END, 6) AS seconds FROM conversations""")(
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", F.round(P.voice_seconds(F.when(F.col("turn") % 4 == 0, 2.5).otherwise(0.0),
        F.when(F.col("turn") % 4 == 1, "error").otherwise("ready"), F.when(F.col("turn") % 4 == 2, F.col("text")), F.col("text")), 6).alias("seconds"))
)
register("speech_cost", """
SELECT conv_id, turn, (len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) + 6 * len(regexp_extract_all(text, '[.!?…]')) + 3 * len(regexp_extract_all(text, '[,;:]')) + 2 * len(regexp_extract_all(text, '[–—]')))::INT AS cost FROM conversations""")(
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", P.speech_cost(F.col("text")).alias("cost"))
)
register("queue_waits", """
SELECT o_orderkey, least(5000, 400 * pow(2, greatest(o_orderkey % 7, 1) - 1))::INT AS wait,
  list_max([x FOR x IN [3000, 1500, 800, 400] IF x < least(3000, o_totalprice / 100)])::INT AS smaller, greatest(256, least(8192, floor(length(o_orderpriority) / 3.2 * 1.8)::INT + 256))::INT AS budget,
  (ceil(o_totalprice / 60) * 2)::BIGINT AS credits FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", P.retry_wait(F.col("o_orderkey") % 7).alias("wait"), P.smaller_block(F.col("o_totalprice") / 100, F.lit(3000)).alias("smaller"),
        P.token_budget(F.col("o_orderpriority")).alias("budget"), P.credits(F.col("o_totalprice")).alias("credits"))
)
register("confidence", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (-l_discount * 20 + 1.5) / 1.4)), 3)::DOUBLE AS confidence FROM lineitem")(
    lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", quality.confidence(-F.col("l_discount") * 20).alias("confidence"))
)
register("iso_duration", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE (o_orderkey % 50) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 END::BIGINT AS seconds FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", T.iso_duration(F.expr(
        "CASE WHEN o_orderkey % 5 = 4 THEN concat('T', o_orderkey) ELSE concat('PT', o_orderkey % 50, 'H', o_orderkey % 60, 'M', o_orderkey % 59, 'S') END")).alias("seconds"))
)
