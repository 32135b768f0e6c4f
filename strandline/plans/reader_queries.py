"""Queries that build subtitle, playlist and post texts from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.registry import register
from strandline.sources import contents as X
from strandline.sources import playlists as P
from strandline.sources import subtitles as S
from strandline.sources.tables import table

SAID = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>]|-->', ' '{g}), '\\\\s+', ' '{g}))"


def _stamp(s: str, comma: str) -> str:
    return f"concat(lpad(string(({s}) div 3600), 2, '0'), ':', lpad(string(({s}) div 60 % 60), 2, '0'), ':', lpad(string(({s}) % 60), 2, '0'), '{comma}500')"


def subtitle_files(spark, sf, kind):
    """One file for each conversation: turns of four seconds with tags in them; every seventh cue ends before it starts."""
    comma, mark = ("," if kind == "srt" else "."), ("" if kind == "srt" else " align:start")
    turns = table(spark, sf, "conversations").withColumn("s", F.expr("int(turn) * 5"))
    end = f"IF((conv_id + turn) % 7 = 0, {_stamp('greatest(s - 1, 0)', comma)}, {_stamp('s + 4', comma)})"
    head = "string(turn + 1), '\n', " if kind == "srt" else ""
    cue = f"concat({head}{_stamp('s', comma)}, ' --> ', {end}, '{mark}\r\n<i>', {SAID.format(g='')}, '</i>\n')"
    cue = turns.select("conv_id", "turn", F.expr(cue).alias("cue"))
    files = cue.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cue"))), lambda x: x["cue"]), "\n").alias("t"))
    return files.select("conv_id", F.concat(F.lit("" if kind == "srt" else "﻿WEBVTT\n\nNOTE a comment\n\n"), "t").alias("text"))


_CUES = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {SAID.format(g=", 'g'").replace(chr(92) * 2, chr(92))} AS said, (turn * 5)::BIGINT AS s, (conv_id + turn) % 7 = 0 AS bad FROM conversations)
SELECT conv_id, (s + 0.5)::DOUBLE AS start, (s + 4.5)::DOUBLE AS "end", said AS text FROM t WHERE NOT bad AND said <> ''"""

register("srt_cues", _CUES)(
    lambda spark, sf: S.cues(subtitle_files(spark, sf, "srt"), "conv_id", "text", F.lit("srt")).where("fine").select("conv_id", "start", "end", "text")
)
register("vtt_cues", _CUES)(
    lambda spark, sf: S.cues(subtitle_files(spark, sf, "vtt"), "conv_id", "text", F.lit("vtt")).where("fine").select("conv_id", "start", "end", "text")
)
register("subtitle_files", f"""
WITH t AS (SELECT conv_id, {SAID.format(g=", 'g'").replace(chr(92) * 2, chr(92))} AS said, (conv_id + turn) % 7 = 0 AS bad, turn FROM conversations)
SELECT conv_id, count(*) FILTER (NOT bad AND said <> '') AS cues, CASE WHEN count(*) FILTER (bad OR said = '') > 0 THEN 'bad' WHEN max(turn * 5 + 4.5) > 10800 THEN 'long' ELSE 'ok' END AS state FROM t GROUP BY 1""")(
    lambda spark, sf: S.file_states(S.cues(subtitle_files(spark, sf, "srt"), "conv_id", "text", F.lit("srt")), "conv_id")
)
register("subtitle_formats", "SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'vtt' WHEN 1 THEN 'srt' WHEN 2 THEN 'vtt' ELSE '' END AS format FROM (SELECT DISTINCT conv_id FROM conversations)")(
    lambda spark, sf: subtitle_files(spark, sf, "srt").select("conv_id", S.detect_format(
        F.expr("IF(conv_id % 4 = 0, 'A.VTT', 'a.txt')"), F.expr("CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN concat('WEBVTT\n\n', text) ELSE 'plain' END")).alias("format"))
)
register("vtt_plain_text", f"""
WITH t AS (SELECT conv_id, turn, {SAID.format(g=", 'g'").replace(chr(92) * 2, chr(92))} AS said FROM conversations),
n AS (SELECT * FROM t WHERE said <> '' AND NOT regexp_matches(said, '^[0-9]+$')), k AS (SELECT *, lag(said) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM n)
SELECT conv_id, md5(coalesce(string_agg(said, ' ' ORDER BY turn), '')) AS digest FROM k WHERE before IS NULL OR before <> said GROUP BY 1""")(
    lambda spark, sf: subtitle_files(spark, sf, "vtt").select("conv_id", F.md5(S.vtt_text(F.col("text"))).alias("digest"))
)


def _captions(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    doc = F.to_json(F.struct(F.array(F.struct(F.transform("p", lambda x: F.struct(F.concat(x["text"], F.lit(" ")).alias("utf8"))).alias("segs")), F.struct(F.lit(None).cast("array<struct<utf8:string>>").alias("segs"))).alias("events")))
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<transcript>"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("<text start='1'><b>"), esc(x["text"]), F.lit("</b></text>"))), ""), F.lit("</transcript>"))
    return c.select("conv_id", F.md5(S.json3_text(doc)).alias("json3"), F.md5(S.xml_text(xml)).alias("xml"), S.json3_text(F.lit("no json")).alias("bad"))


register("caption_documents", """
WITH t AS (SELECT conv_id, trim(regexp_replace(string_agg(coalesce(text, ''), ' ' ORDER BY turn), '\\s+', ' ', 'g')) AS t FROM conversations GROUP BY 1)
SELECT conv_id, md5(t) AS json3, md5(t) AS xml, '' AS bad FROM t""")(_captions)

register("fetched_segments", """
SELECT event_id, greatest(value - 50, 0)::DOUBLE AS start, floor((greatest(value - 50, 0) + event_id % 9 / 2) * 1000 + 0.5) / 1000 AS "end", (event_id % 9 / 2)::DOUBLE AS duration, event_type AS text FROM events WHERE event_id % 11 > 1""")(
    lambda spark, sf: S.fetched_segments(table(spark, sf, "events").selectExpr("event_id", "IF(event_id % 11 = 0, 'x', string(round(value - 50, 2))) AS start", "event_id % 9 / 2 AS duration",
        "IF(event_id % 11 = 1, ' ', event_type) AS text"), "event_id").select("event_id", "start", "end", "duration", "text")
)
register("picked_language", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'es' WHEN 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'de' END END AS lang FROM customer""")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", S.pick_language(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'fr' ELSE 'de' END"), F.expr("IF(c_nationkey % 2 = 0, array('it', 'en'), array('it'))"), ["es", "en"]).alias("lang"))
)
register("picked_track", """
WITH t AS (SELECT source, lang, doc_id % 2 = 0 AS generated, CASE lang WHEN 'fr' THEN 0 WHEN 'es' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS o FROM documents WHERE n_chars > 20)
SELECT source, lang, generated FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY generated, o, lang) = 1""")(
    lambda spark, sf: S.pick_track(table(spark, sf, "documents").select("source", "lang", (F.col("doc_id") % 2 == 0).alias("generated"), "n_chars"), "source", "fr")
)


def _playlists(spark, sf):
    line = F.expr("concat('#EXTINF:', string(l_quantity / 4), ',\n', IF(l_linenumber % 4 = 0, '#gap', concat('s', l_linenumber, '.m4s')))")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("p")).select(
        "l_orderkey", F.concat(F.lit('#EXTM3U\n#EXT-X-MAP:URI="i.mp4"\n'), F.array_join(F.transform("p", lambda x: x["t"]), "\r\n")).alias("text"))


register("audio_segments", """
SELECT l_orderkey, (row_number() OVER w)::INT AS piece, 's' || l_linenumber || '.m4s' AS uri, round(sum(l_quantity / 4) OVER w - l_quantity / 4, 3) AS start, l_quantity / 4 AS duration
FROM lineitem WHERE l_linenumber % 4 <> 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, (l_quantity / 4)::VARCHAR ROWS UNBOUNDED PRECEDING)""")(lambda spark, sf: P.audio_segments(_playlists(spark, sf), "l_orderkey", "text"))

register("audio_track", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a/mp4a/64000/x' WHEN 1 THEN 'b' ELSE 'c' END AS uri, CASE o_orderkey % 3 WHEN 0 THEN 64000 WHEN 1 THEN 32000 ELSE 0 END AS rate FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", P.audio_track(F.expr("""
      concat('#EXTM3U\n#EXT-X-STREAM-INF:X\n', CASE o_orderkey % 3 WHEN 2 THEN '#EXT-X-MEDIA:TYPE=AUDIO,URI="c"\n#EXT-X-MEDIA:TYPE=AUDIO\n' ELSE '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio-32000",URI="b"\r\n' END,
        IF(o_orderkey % 3 = 0, '#EXT-X-MEDIA:TYPE=AUDIO,URI="a/mp4a/64000/x"', ''))""")).alias("t")).select("o_orderkey", "t.uri", "t.rate")
)


def _posts(spark, sf):
    link = lambda w, h: f"concat('https://video.twimg.com/v/', o_orderkey, '/{w}x{h}/a.mp4')"
    vs = f"""array(named_struct('url', {link(1280, 720)}, 'bitrate', 2000, 'content_type', 'video/mp4'), named_struct('url', {link(640, 360)}, 'bitrate', 800, 'content_type', 'video/mp4'),
      named_struct('url', 'http://elsewhere/x.mp4', 'bitrate', 9000, 'content_type', 'video/mp4'), named_struct('url', 'https://video.twimg.com/l.m3u8', 'bitrate', 0, 'content_type', 'application/x-mpegURL'))"""
    media = f"array(named_struct('type', IF(o_orderkey % 5 = 3, 'animated_gif', 'video'), 'media_url_https', 'https://pbs.twimg.com/p.jpg', 'video_info', named_struct('duration_millis', o_totalprice, 'variants', {vs})))"
    post = f"named_struct('id_str', string(o_orderkey), 'text', concat(o_orderpriority, ' https://t.co/abc'), 'lang', IF(o_orderkey % 2 = 0, 'und', 'EN'), 'user', named_struct('screen_name', o_orderstatus), 'mediaDetails', {{}})"
    none = "CAST(NULL AS array<struct<type:string>>)"
    first = f"""CASE o_orderkey % 5 WHEN 0 THEN '{{"__typename": "TweetTombstone"}}' WHEN 1 THEN to_json({post.format(none)})
      WHEN 2 THEN to_json(named_struct('id_str', 'outer', 'quoted_tweet', {post.format(media)})) ELSE to_json({post.format(media)}) END"""
    second = f"to_json(named_struct('code', IF(o_orderkey % 10 < 5, 200, 404), 'tweet', named_struct('id', string(o_orderkey), 'text', o_orderpriority, 'lang', 'es', 'author', named_struct('screen_name', 'm'), 'media', named_struct('videos', array(named_struct('duration', 12.5D, 'thumbnail_url', 'https://other/p.jpg', 'formats', {vs}))))))"
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(first).alias("one"), F.expr(second).alias("two"), F.lit(0).alias("place"))
    o = P.resolve_posts(P.mirrored_posts(P.syndicated_posts(o, "one", "place", "first"), "two", "place", "second"), "first", "second")
    best, saving = P.pick_mp4(F.col("record.mp4"))["width"], P.pick_mp4(F.col("record.mp4"), saving=True)["width"]
    return o.select("o_orderkey", "error", "source", *[f"record.{c}" for c in ("id", "author", "text", "lang", "seconds", "cover", "hls")], best.alias("best"), saving.alias("saving"))


register("video_posts", """
WITH o AS (SELECT *, o_orderkey % 5 AS k, o_orderkey % 10 < 5 AS mirror FROM orders), s AS (SELECT *, CASE WHEN k IN (2, 4) THEN 'first' WHEN k IN (0, 1) AND mirror THEN 'second' END AS source FROM o)
SELECT o_orderkey, CASE WHEN source IS NOT NULL THEN NULL WHEN k = 0 THEN 'unavailable' WHEN k = 1 THEN 'no_video' ELSE 'gif' END AS error, source,
  CASE WHEN source IS NOT NULL THEN o_orderkey::VARCHAR END AS id, CASE source WHEN 'first' THEN o_orderstatus WHEN 'second' THEN 'm' END AS author, CASE WHEN source IS NOT NULL THEN o_orderpriority END AS text,
  CASE source WHEN 'first' THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'en' END WHEN 'second' THEN 'es' END AS lang,
  CASE source WHEN 'first' THEN round(o_totalprice / 1000, 3) WHEN 'second' THEN 12.5 END AS seconds, CASE source WHEN 'first' THEN 'https://pbs.twimg.com/p.jpg' WHEN 'second' THEN '' END AS cover,
  CASE WHEN source IS NOT NULL THEN 'https://video.twimg.com/l.m3u8' END AS hls, CASE WHEN source IS NOT NULL THEN 1280 END AS best, CASE WHEN source IS NOT NULL THEN 640 END AS saving FROM s""")(_posts)


def _encoded(spark, sf):
    """Every document in five charsets; a letter outside a charset becomes a question mark first."""
    d = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.col("text").alias("t"))
    latin = F.concat(F.regexp_replace("t", "[^\x01-\x7e\u00a0-\u00ff]", "?"), F.lit("é."))
    mark = lambda h: F.unhex(F.lit(h))
    forms = [F.encode("t", "UTF-8"), F.concat(mark("EFBBBF"), F.encode("t", "UTF-8")), F.concat(mark("FFFE"), F.encode("t", "UTF-16LE")), F.concat(mark("FEFF"), F.encode("t", "UTF-16BE")), F.encode(latin, "ISO-8859-1")]
    return d.select("doc_id", F.posexplode(F.array(*forms)).alias("form", "bytes"))


register("decoded_files", r"""
SELECT doc_id, f::INT AS form, md5(CASE WHEN f = 4 THEN regexp_replace(text, '[^\x01-\x7e\x{a0}-\x{ff}]', '?', 'g') || 'é.' ELSE text END) AS text FROM documents, range(5) r(f) WHERE length(text) > 0""")(
    lambda spark, sf: _encoded(spark, sf).select("doc_id", "form", F.md5(X.decoded(F.col("bytes"))).alias("text"))
)


def _answers(spark, sf):
    """Conversations as provider answers: a text, timed pieces by offset or by start and end, plain pieces, or an object."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("p"))
    turn = lambda x: x["turn"].cast("string")
    forms = [
        F.to_json(F.struct(F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("c"))),
        F.to_json(F.struct(F.transform("p", lambda x: F.struct(x["t"].alias("text"), (x["turn"] * 1500).alias("offset"), F.when(x["turn"] != 2, x["turn"] * 250 + 500).alias("duration"))).alias("c"))),
        F.to_json(F.struct(F.transform("p", lambda x: F.struct(x["t"].alias("text"), F.when(x["turn"] == 1, "soon").otherwise(turn(x)).alias("start"), (x["turn"] + 2).alias("end"))).alias("c"))),
        F.to_json(F.struct(F.transform("p", lambda x: x["t"]).alias("c"))), F.lit('{"c": {"text": "no list"}}'),
    ]
    return c.select("conv_id", F.posexplode(F.array(*forms)).alias("form", "json")).select("conv_id", "form", F.try_variant_get(F.try_parse_json("json"), "$.c", "variant").alias("content"))


_FLAT = "trim(replace(coalesce(text, ''), chr(10), ' '))"
register("content_texts", f"""
WITH c AS (SELECT conv_id, trim(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS a, coalesce(trim(string_agg({_FLAT}, ' ' ORDER BY turn) FILTER ({_FLAT} <> '')), '') AS b, coalesce(trim(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(coalesce(text, '')) <> '')), '') AS d FROM conversations GROUP BY 1)
SELECT conv_id, f::INT AS form, md5(CASE f WHEN 0 THEN a WHEN 3 THEN d WHEN 4 THEN '' ELSE b END) AS text FROM c, range(5) r(f)""")(lambda spark, sf: _answers(spark, sf).select("conv_id", "form", F.md5(X.content_text(F.col("content"))).alias("text")))
register("content_segments", f"""
WITH t AS (SELECT conv_id, turn, {_FLAT} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS place FROM conversations)
SELECT conv_id, 1 AS form, place::INT AS place, turn * 1.5::DOUBLE AS start, CASE turn WHEN 2 THEN 0 ELSE (turn * 250 + 500) / 1000 END AS duration, round(turn * 1.5::DOUBLE + CASE turn WHEN 2 THEN 0 ELSE (turn * 250 + 500) / 1000 END, 3) AS "end", md5(text) AS text FROM t WHERE text <> ''
UNION ALL SELECT conv_id, 2, place::INT, turn::DOUBLE, 2.0::DOUBLE, turn + 2.0::DOUBLE, md5(text) FROM t WHERE text <> '' AND turn <> 1""")(
    lambda spark, sf: X.content_segments(_answers(spark, sf).withColumn("k", F.struct("conv_id", "form")), "k", "content").select("k.conv_id", "k.form", "place", "start", "duration", "end", F.md5("text").alias("text"))
)

register("fetched_texts", r"""
WITH t AS (SELECT conv_id, trim(regexp_replace(string_agg(coalesce(text, ''), ' ' ORDER BY turn), '\s+', ' ', 'g')) AS t FROM conversations GROUP BY 1)
SELECT conv_id, length(t) > 1500 AS kept, md5(CASE WHEN length(t) > 1500 THEN t END) AS text FROM t""")(
    lambda spark, sf: S.joined_text(table(spark, sf, "conversations"), "conv_id", "turn", "text", 1500).select("conv_id", F.col("text").isNotNull().alias("kept"), F.md5("text").alias("text"))
)
