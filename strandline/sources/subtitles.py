"""Readers of subtitle and caption texts that are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import squeeze

STAMP = r"^(?:(\d+):)?([0-5]?\d):([0-5]\d)[,.](\d{1,3})(?:\s.*)?$"
MAX_SECONDS = 3 * 3600


def lines_of(text: Column) -> Column:
    """Blocks between blank lines, each an array of its trimmed lines that aren't empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "^\ufeff", ""), r"\r\n?", "\n")
    return F.filter(F.transform(F.split(t, r"\n{2,}"), lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != "")), lambda b: F.size(b) > 0)


def seconds(stamp: Column) -> Column:
    """Seconds of hh:mm:ss,mmm or mm:ss.mmm, settings after it ignored; null where it is no time."""
    s = F.trim(stamp)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(s, STAMP, k), F.lit("")).try_cast("long"), F.lit(0))
    ms = F.rpad(F.regexp_extract(s, STAMP, 4), 3, "0").try_cast("long")
    return F.when(s.rlike(STAMP), part(1) * 3600 + part(2) * 60 + part(3) + ms / 1000)


def detect_format(name: Column, text: Column) -> Column:
    """vtt or srt by the file name, else by the first 1000 characters; empty where it is neither."""
    n, head = F.lower(F.coalesce(name, F.lit(""))), F.substring(F.coalesce(text, F.lit("")), 1, 1000)
    return (
        F.when(n.endswith(".vtt"), "vtt").when(n.endswith(".srt"), "srt").when(head.rlike(r"(?m)^WEBVTT"), "vtt")
        .when(~F.contains(head, F.lit("-->")), "").when(head.rlike(r",\d{3}"), "srt").otherwise("vtt")
    )


def cues(files: DataFrame, key: str, text: str, kind: Column) -> DataFrame:
    """(key, block, start, end, text, fine) of every timed block of the files; kind is srt or vtt.

    fine: the block is a cue, with valid times in order and a text once tags are gone. A block's place is
    its number, so nothing is sorted.
    """
    b = files.select(key, kind.alias("kind"), F.posexplode(lines_of(F.col(text))).alias("block", "lines"))
    b = b.where(~((F.col("kind") == "vtt") & F.col("lines")[0].rlike(r"(?i)^(NOTE|STYLE|REGION)(\s|$)")))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    b = b.withColumn("at", at).where("at > 0")
    # an srt cue has its time in the first line, or in the second after a number
    placed = (F.col("kind") == "vtt") | (F.col("at") == 1) | ((F.col("at") == 2) & F.col("lines")[0].rlike(r"^\d+$"))
    when = F.split(F.get("lines", F.col("at") - 1), "-->")
    said = squeeze(F.regexp_replace(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " "), "<[^>]*>", ""))
    b = b.select(key, "block", seconds(when[0]).alias("start"), seconds(when[1]).alias("end"), said.alias("text"), placed.alias("placed"))
    return b.select(key, "block", "start", "end", "text", F.coalesce(F.expr("placed and end > start and text <> ''"), F.lit(False)).alias("fine"))


def file_states(found: DataFrame, key: str) -> DataFrame:
    """(key, cues, state) of each file of cues(): bad if a timed block is no cue, long beyond MAX_SECONDS, else ok."""
    got = found.groupBy(key).agg(F.count_if("fine").alias("cues"), F.count("*").alias("declared"), F.max(F.when(F.col("fine"), F.col("end"))).alias("last"))
    state = F.when(F.col("cues") != F.col("declared"), "bad").when(F.col("last") > MAX_SECONDS, "long").otherwise("ok")
    return got.select(key, "cues", state.alias("state"))


def vtt_text(text: Column) -> Column:
    """Plain text: headers, times, cue numbers and tags gone, a line equal to the one before dropped."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^\ufeff", ""), r"\r?\n"), lambda x: F.trim(x))
    noise = r"(?i)^(WEBVTT|NOTE|STYLE|REGION|Kind:|Language:)|-->|^\d+$"
    kept = F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(noise)), lambda x: squeeze(F.regexp_replace(x, "<[^>]*>", "")))
    kept = F.filter(kept, lambda x: x != "")
    return F.array_join(F.filter(kept, lambda x, i: (i == 0) | (x != F.get(kept, i - 1))), " ")


def json3_text(raw: Column) -> Column:
    """Joined pieces of a json3 caption document; empty where it isn't one."""
    doc = F.from_json(raw, "struct<events:array<struct<segs:array<struct<utf8:string>>>>>")
    pieces = F.flatten(F.transform(F.filter(doc["events"], lambda e: e["segs"].isNotNull()), lambda e: F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit("")))))
    return F.coalesce(squeeze(F.array_join(pieces, "")), F.lit(""))


def xml_text(raw: Column) -> Column:
    """Joined <text> elements of an XML caption document, tags gone and five entities decoded."""
    inside = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(?s)<text[^>]*>(.*?)</text>"), F.lit(1))
    t = F.regexp_replace(F.array_join(inside, " "), "<[^>]*>", "")
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(ch))
    return squeeze(t)


def fetched_segments(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, start, duration, text) as (key, start, end, duration, text); rows without a start or text are dropped."""
    start, long = F.greatest(F.lit(0.0), F.col("start").try_cast("double")), F.greatest(F.lit(0.0), F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0)))
    good = rows.where(F.col("start").try_cast("double").isNotNull() & (squeeze(F.coalesce("text", F.lit(""))) != ""))
    r = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return good.select(key, r(start).alias("start"), r(start + long).alias("end"), r(long).alias("duration"), squeeze(F.col("text")).alias("text"))


def pick_language(got: Column, available: Column, wanted: list[str]) -> Column:
    """The received language if it is wanted, else the first wanted one that is available, else the received one."""
    first = F.get(F.filter(F.array(*map(F.lit, wanted)), lambda x: F.array_contains(available, x)), F.lit(0))
    return F.when(got.isin(wanted), got).otherwise(F.coalesce(first, got))


def pick_track(tracks: DataFrame, key: str, wanted: str) -> DataFrame:
    """The best of tracks(key, lang, generated, n_chars) of each key: by hand before generated, then the
    wanted language, es, en and the rest by name; texts of 20 characters or fewer don't count."""
    order = F.when(F.col("lang") == wanted, 0).when(F.col("lang") == "es", 1).when(F.col("lang") == "en", 2).otherwise(3)
    best = F.min(F.struct(F.col("generated").cast("int").alias("g"), order.alias("o"), F.col("lang").alias("lang")))
    return tracks.where("n_chars > 20").groupBy(key).agg(best.alias("b")).select(key, "b.lang", (F.col("b.g") == 1).alias("generated"))


def joined_text(rows: DataFrame, key: str, place: str, text: str, least: int = 20) -> DataFrame:
    """(key, text) of the texts of a key in the order of their place, blanks between them squeezed; null if it isn't longer than `least`."""
    t = squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, F.coalesce(text, F.lit("")).alias("_t")))), lambda x: x["_t"]), " "))
    return rows.groupBy(key).agg(t.alias("text")).withColumn("text", F.when(F.length("text") > least, F.col("text")))
