"""Contents that come in several forms: subtitle files of unknown charset, and provider answers that are text, list or object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest subtitle file that is read.
MAX_BYTES = 2 << 20
#: What ISO 8859-1 and Windows-1252 read differently; bytes that the latter leaves open stay controls.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_W1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def decoded(c: Column) -> Column:
    """Text of bytes: UTF-16 by its byte order mark, else UTF-8 if they are valid, else Windows-1252. The mark is dropped.

    An odd last byte of UTF-16 is dropped too. Null stays null."""
    head, even = F.hex(F.substring(c, 1, 2)), F.octet_length(c) - F.octet_length(c) % 2
    utf16 = lambda name: F.decode(F.substring(c, F.lit(1), even), name)
    text = (
        F.when(head == "FFFE", utf16("UTF-16LE")).when(head == "FEFF", utf16("UTF-16BE")).when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
        .otherwise(F.translate(F.decode(c, "ISO-8859-1"), _C1, _W1252))
    )
    return F.regexp_replace(text, "^﻿", "")


def subtitle_files(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """(path, name, text, fault) of the files in a folder and those below it; fault is empty, too_large or not_subtitles, and then text is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "[^/]*$", 0)
    fault = F.when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too_large").when(~F.lower(name).rlike(r"\.(srt|vtt)$"), "not_subtitles")
    return files.select("path", name.alias("name"), F.when(fault.isNull(), decoded(F.col("content"))).alias("text"), fault.alias("fault"))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _got(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def content_text(v: Column) -> Column:
    """Text of a variant: a string as it is, the pieces of a list (their text, if they are objects) joined by blanks; else empty."""
    flat = lambda s: F.trim(F.replace(F.coalesce(s, F.lit("")), F.lit("\n"), F.lit(" ")))
    piece = lambda x: F.when(_kind(x) == "OBJECT", flat(_got(x, "$.text"))).otherwise(F.trim(F.coalesce(_got(x, "$"), F.lit(""))))
    pieces = F.filter(F.transform(_got(v, "$", "array<variant>"), piece), lambda s: s != "")
    return F.when(_kind(v) == "STRING", F.trim(_got(v, "$"))).when(_kind(v) == "ARRAY", F.trim(F.array_join(pieces, " "))).otherwise("")


def content_segments(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, place, start, end, duration, text) of the timed pieces of rows(key, content variant), in seconds.

    offset and duration are milliseconds; else startTime or start and endTime or end are seconds, and without an end
    duration is. Missing numbers are 0, negative ones too. Pieces without a text or with what is no number are left
    out, and so is whatever isn't a list of objects."""
    x = F.col("x")
    each = rows.where(_kind(F.col(content)) == "ARRAY").select(key, F.posexplode(_got(F.col(content), "$", "array<variant>")).alias("place", "x")).where(_kind(x) == "OBJECT")
    there = lambda p: _got(x, f"$.{p}", "variant").isNotNull()
    said = lambda p: F.nullif(F.coalesce(_got(x, f"$.{p}"), F.lit("")), F.lit(""))
    number = lambda s: F.when(s.isNull(), 0.0).otherwise(s.try_cast("double"))
    end = F.when(there("endTime"), said("endTime")).otherwise(said("end"))
    start = F.when(there("offset"), number(said("offset")) / 1000).otherwise(number(F.when(there("startTime"), said("startTime")).otherwise(said("start"))))
    each = each.withColumn("text", F.trim(F.replace(F.coalesce(said("text"), F.lit("")), F.lit("\n"), F.lit(" ")))).withColumn("_s", start)
    long = F.when(there("offset"), number(said("duration")) / 1000).when(end.isNull(), number(said("duration"))).otherwise(end.try_cast("double") - F.col("_s"))
    each = each.withColumn("_d", long).where("text <> '' AND _s IS NOT NULL AND _d IS NOT NULL")
    s, d = F.greatest(F.lit(0.0), F.col("_s")), F.greatest(F.lit(0.0), F.col("_d"))
    return each.select(key, "place", F.round(s, 3).alias("start"), F.round(s + d, 3).alias("end"), F.round(d, 3).alias("duration"), "text")
