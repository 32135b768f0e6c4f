"""Readers of audio playlists and posts with video that are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.library import safe_url

#: Preferred audio bit rates, hosts of media, languages that say nothing.
PREFERRED = [64000, 32000, 128000]
MEDIA_HOST, IMAGE_HOST = "video.twimg.com", "pbs.twimg.com"
NO_LANGUAGE = ["und", "zxx", "qme", "qht"]


def audio_segments(lists: DataFrame, key: str, text: str) -> DataFrame:
    """(key, piece, uri, start, duration) of media playlists: a duration line counts if a link follows it.

    Pieces of one playlist are ordered in one window; a playlist is one row of the input.
    """
    rows = lists.select(key, F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)).alias("lines"))
    rows = rows.select(key, "lines", F.posexplode("lines").alias("line", "said")).where(F.col("said").startswith("#EXTINF:"))
    rows = rows.select(key, "line", F.regexp_extract("said", r"^#EXTINF:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double").alias("duration"), F.get("lines", F.col("line") + 1).alias("uri"))
    rows = rows.where("duration is not null and uri <> '' and not startswith(uri, '#')")
    w = Window.partitionBy(key).orderBy("line")
    start = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select(key, F.row_number().over(w).alias("piece"), "uri", F.round(start, 3).alias("start"), "duration")


def audio_track(master: Column, preferred: list[int] = PREFERRED) -> Column:
    """struct(uri, rate) of a master playlist: the first preferred bit rate there is, else the first track."""
    media = F.filter(F.split(master, r"\r?\n"), lambda x: x.startswith("#EXT-X-MEDIA:") & F.contains(x, F.lit("TYPE=AUDIO")) & x.rlike('URI="[^"]+"'))

    def track(x: Column) -> Column:
        rate = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit("")).try_cast("int")
        return F.struct(F.regexp_extract(x, 'URI="([^"]+)"', 1).alias("uri"), F.coalesce(rate(r"/mp4a/(\d+)/"), rate(r'GROUP-ID="audio-(\d+)"'), F.lit(0)).alias("rate"))

    tracks = F.transform(media, track)
    at_rate = lambda r: F.get(F.filter(tracks, lambda t: t["rate"] == r), F.lit(0))
    return F.coalesce(*map(at_rate, preferred), F.get(tracks, F.lit(0)))


VARIANT = "struct<url:string,bitrate:int,content_type:string,container:string>"


def variants(raw: Column) -> Column:
    """struct(mp4, hls) of an array of variants: mp4 by bit rate with width and height from the link, hls the last list; other hosts dropped."""
    safe = F.filter(F.coalesce(raw, F.array().cast(f"array<{VARIANT}>")), lambda v: safe_url(F.coalesce(v["url"], F.lit("")), MEDIA_HOST) != "")
    kind = lambda v: F.lower(F.coalesce(F.nullif(v["content_type"], F.lit("")), v["container"], F.lit("")))
    side = lambda v, k: F.coalesce(F.nullif(F.regexp_extract(v["url"], r"/(\d+)x(\d+)/", k), F.lit("")).try_cast("int"), F.lit(0))
    shaped = lambda v: F.struct(F.coalesce(v["bitrate"], F.lit(0)).alias("bitrate"), v["url"].alias("url"), side(v, 1).alias("width"), side(v, 2).alias("height"))
    mp4 = F.array_sort(F.transform(F.filter(safe, lambda v: kind(v).isin("video/mp4", "mp4")), shaped))
    hls = F.filter(safe, lambda v: F.contains(kind(v), F.lit("mpegurl")) | (kind(v) == "m3u8"))
    return F.struct(mp4.alias("mp4"), F.coalesce(F.get(hls, F.size(hls) - 1)["url"], F.lit("")).alias("hls"))


def pick_mp4(mp4: Column, saving: bool = False) -> Column:
    """The highest bit rate whose short side is at most 720 (360 when saving data), else the lowest."""
    most = 360 if saving else 720
    fit = F.filter(mp4, lambda v: (F.least(v["width"], v["height"]) > 0) & (F.least(v["width"], v["height"]) <= most))
    return F.coalesce(F.get(fit, F.size(fit) - 1), F.get(mp4, F.lit(0)))


_MEDIA = f"array<struct<type:string,media_url_https:string,video_info:struct<duration_millis:double,variants:array<{VARIANT}>>>>"
_POST = f"id_str:string,text:string,lang:string,user:struct<screen_name:string>,mediaDetails:{_MEDIA}"
_OTHER = f"id:string,text:string,lang:string,author:struct<screen_name:string>,media:struct<all:array<struct<type:string>>,videos:array<struct<duration:double,thumbnail_url:string,variants:array<{VARIANT}>,formats:array<{VARIANT}>>>>"
RECORD = ["id", "author", "text", "lang", "seconds", "cover", "mp4", "hls"]


def _record(id_, author, text, lang, seconds, cover, streams) -> Column:
    low = F.lower(F.coalesce(lang, F.lit("")))
    said = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*https://t\.co/\S+\s*$", "")), 1, 280)
    return F.struct(
        id_.alias("id"), F.coalesce(author, F.lit("")).alias("author"), said.alias("text"), F.when(low.isin(NO_LANGUAGE), "").otherwise(low).alias("lang"),
        F.round(F.coalesce(seconds, F.lit(0.0)), 3).alias("seconds"), safe_url(F.coalesce(cover, F.lit("")), IMAGE_HOST).alias("cover"), streams["mp4"].alias("mp4"), streams["hls"].alias("hls"),
    )


def _with_record(df: DataFrame, post: tuple, video: Column, seconds: Column, cover: Column, streams: Column, lost: Column, gif: Column, name: str) -> DataFrame:
    """df with struct(record, error) `name`; steps are columns of their own so that each is computed once."""
    df = df.withColumn("_v", video).withColumn("_s", variants(streams))
    error = F.when(lost, "unavailable").when(F.col("_v").isNull() & ~gif, "no_video").when(gif, "gif").when((F.size("_s.mp4") == 0) & (F.col("_s.hls") == ""), "no_video")
    record = _record(*post, seconds, cover, F.col("_s"))
    df = df.withColumn("_e", error).withColumn(name, F.struct(F.when(F.col("_e").isNull(), record).alias("record"), F.col("_e").alias("error")))
    return df.drop("_doc", "_p", "_m", "_v", "_s", "_e")


def syndicated_posts(df: DataFrame, raw: str, place: str, name: str) -> DataFrame:
    """df with struct(record, error) `name` of posts as JSON in `raw`; a post without video takes the one that it quotes.

    error: unavailable, no_video, gif, or null with a record.
    """
    df = df.withColumn("_doc", F.from_json(raw, f"struct<__typename:string,{_POST},quoted_tweet:struct<{_POST}>>"))
    videos = lambda p: F.filter(F.coalesce(p["mediaDetails"], F.array().cast(_MEDIA)), lambda m: m["type"].isin("video", "animated_gif"))
    doc, post = F.col("_doc"), F.struct(*[f"_doc.{c}" for c in ("id_str", "text", "lang", "user", "mediaDetails")])
    df = df.withColumn("_p", F.when((F.size(videos(doc)) == 0) & doc["quoted_tweet"]["id_str"].isNotNull(), doc["quoted_tweet"]).otherwise(post))
    df = df.withColumn("_m", videos(F.col("_p")))
    p, v = F.col("_p"), F.col("_v")
    lost = doc.isNull() | (doc["__typename"] == "TweetTombstone") | F.coalesce(doc["id_str"] == "", F.lit(True))
    shown = p["id_str"], p["user"]["screen_name"], p["text"], p["lang"]
    video = F.get("_m", F.least(F.col(place), F.size("_m") - 1))
    gif = F.coalesce(v["type"] == "animated_gif", F.lit(False))
    return _with_record(df, shown, video, v["video_info"]["duration_millis"] / 1000, v["media_url_https"], v["video_info"]["variants"], F.coalesce(lost, F.lit(False)), gif, name)


def mirrored_posts(df: DataFrame, raw: str, place: str, name: str) -> DataFrame:
    """The same for the second source's JSON."""
    df = df.withColumn("_doc", F.from_json(raw, f"struct<code:int,tweet:struct<{_OTHER}>>")).withColumn("_p", F.col("_doc.tweet"))
    df = df.withColumn("_m", F.coalesce("_p.media.videos", F.array().cast(_OTHER.partition("videos:")[2][:-1])))
    p, v = F.col("_p"), F.col("_v")
    lost = p.isNull() | ~F.coalesce(F.col("_doc.code") == 200, F.lit(True))
    gif = v.isNull() & F.coalesce(F.exists(p["media"]["all"], lambda m: m["type"] == "gif"), F.lit(False))
    shown = F.coalesce(p["id"], F.lit("")), p["author"]["screen_name"], p["text"], p["lang"]
    video = F.get("_m", F.least(F.col(place), F.size("_m") - 1))
    return _with_record(df, shown, video, v["duration"], v["thumbnail_url"], F.coalesce(v["variants"], v["formats"]), lost, gif, name)


def resolve_posts(df: DataFrame, first: str, second: str) -> DataFrame:
    """df with record, error and source: the first source with a record; a gif is final; otherwise the first error."""
    a, b = F.col(first), F.col(second)
    final = F.coalesce(a["error"] == "gif", F.lit(False))
    source = F.when(a["record"].isNotNull(), "first").when(~final & b["record"].isNotNull(), "second")
    df = df.withColumn("source", source)
    error = F.when(F.col("source").isNotNull(), None).when(~final & (b["error"] == "gif"), "gif").otherwise(a["error"])
    record = F.when(F.col("source") == "first", a["record"]).when(F.col("source") == "second", b["record"])
    return df.withColumn("record", record).withColumn("error", error)
