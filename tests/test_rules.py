"""Readers, chunkers and stateful rules on cases with a known result."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import library as L
from strandline.functions import normal as N
from strandline.functions import text as T
from strandline.operators import chunks as C
from strandline.operators import sequences as S
from strandline.operators import slices
from strandline.sources import playlists as P
from strandline.sources import subtitles as U


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_subtitles_with_faults(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,5\r\n<i>One</i> two\r\n\r\n2\r\n00:00:03,000 --> 00:00:02,000\r\nback\r\n\r\n3\n00:61:00,000 --> 00:00:02,000\nbad\n\nno time here\n\n4\n1:00:00.250 --> 1:00:01.000\n<b></b>\n"
    files = spark.createDataFrame([(1, srt), (2, None), (3, "")], "k int, text string")
    rows = U.cues(files, "k", "text", F.lit("srt")).orderBy("block").collect()
    assert [(r.start, r.end, r.text, r.fine) for r in rows] == [(1.0, 2.5, "One two", True), (3.0, 2.0, "back", False), (None, 2.0, "bad", False), (3600.25, 3601.0, "", False)]
    assert [(r.k, r.cues, r.state) for r in U.file_states(U.cues(files, "k", "text", F.lit("srt")), "k").collect()] == [(1, 1, "bad")]
    vtt = "WEBVTT - x\n00:01.000 --> 00:02.000 align:start\nHi\n\nNOTE\n00:05.000 --> 00:06.000\nno\n\nid\n00:07.000 --> 00:08.000\nthere\n"
    got = U.cues(spark.createDataFrame([(1, vtt)], "k int, text string"), "k", "text", F.lit("vtt")).where("fine").collect()
    assert [(r.start, r.text) for r in got] == [(1.0, "Hi"), (7.0, "there")]


def test_posts_without_json(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, "{}")], "k int, t string").withColumn("p", F.lit(0))
    got = P.resolve_posts(P.mirrored_posts(P.syndicated_posts(df, "t", "p", "a"), "t", "p", "b"), "a", "b").collect()
    assert [(r.error, r.record) for r in got] == [("unavailable", None)] * 3


@pytest.mark.parametrize("text, want", [
    ("El Sr. Pérez llegó. ¿Vino? Sí.", ["El Sr. Pérez llegó.", "¿Vino?", "Sí."]), ("Ver pág. 12 hoy. Fin", ["Ver pág. 12 hoy.", "Fin"]), ("Mide 3.5 m. y pesa poco", ["Mide 3.5 m. y pesa poco"]),
    ("J. R. R. Tolkien escribió.", ["J. R. R. Tolkien escribió."]), ("Título\n\nTexto que\nsigue aquí.", ["Título", "Texto que\nsigue aquí."]), ("—¿Vienes? —preguntó.", ["—¿Vienes? —preguntó."]),
    ("1. uno\n2. dos", ["1. uno", "2. dos"]), ("", []), (" \n ", []), ("Los EE. UU. ganan. Fin.", ["Los EE. UU. ganan.", "Fin."]),
])
def test_units(text, want):
    assert [p for _, _, p in C.units(text)] == want


def test_long_units_and_blocks():
    long = "palabra " * 40 + "corta, " + "otra " * 40 + "; " + "x" * 700
    for a, b, p in C.units(long):
        assert p == long[a:b] and 0 < len(p) <= C.HARD and p == p.strip()
    for size in (50, 333):
        for text in (long, "a\n\nb. c " * 200, "y" * 1000, ""):
            got = C.blocks(size)(text)
            assert "".join(p for *_, p in got) == text and all(p == text[a:b] for a, b, p in got)
    assert [p for *_, p in C.paragraphs(10)("aaa\n\nbbb\n\ncccccccc. dd")] == ["aaa\n\nbbb", "cccccccc.", "dd"]
    assert max(len(p) for *_, p in C.short("uno dos " * 200)) <= 400
    assert C.wrapped_lines("aa bb cccccc".split(), 5) == 3 and C.wrapped_lines([], 5) == 0
    assert [p for *_, p in C.captions(10, 1)("uno dos de la tres. Si")] == ["uno dos", "de la", "tres. Si"]


def test_tiling(spark):
    p = spark.createDataFrame([(1, 0, 3), (1, 3, 9), (2, 0, 3), (2, 4, 9), (3, 0, 5), (3, 3, 9), (4, 0, 9), (4, 0, 9)], "k int, start long, end long")
    t = spark.createDataFrame([(k, 9) for k in range(1, 5)] + [(5, 0), (6, 4)], "k int, n int")
    assert {r.k: r.tiles for r in C.tiling(p, t, "k", "n").collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_rate_limit_counts_only_what_it_allows(spark):
    df = spark.createDataFrame([(1, t, t) for t in (0, 1, 2, 9, 11, 12)] + [(2, 0, 0)], "k int, t long, i long")
    got = S.rate_limit(df, "k", "t", "i", 10, 2).orderBy("k", "t").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, True]


def test_groups_by_what_ends_a_text(spark):
    rows = [(k, i, 4.0 * i, 4.0 * i + 3.5, t, False) for k, ts in {1: ["One.\n", "two"], 2: ["One.", "two"], 3: ["One. ", "two"], 4: ["a", "b.\n", "c"]}.items() for i, t in enumerate(ts)]
    got = S.timed_groups(spark.createDataFrame(rows, "k int, place int, start double, end double, text string, change boolean"), "k")
    assert [(x.k, x.group) for x in got.orderBy("k", "place").collect()] == [(1, 0), (1, 0), (2, 0), (2, 1), (3, 0), (3, 0), (4, 0), (4, 0), (4, 1)]


def test_slices_equal_plain_windows(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randrange(2000), i, r.choice([None, r.randrange(9)])) for i in range(400)]
    df = slices.cut(spark.createDataFrame(rows, "k int, t long, i long, v int"), "t", 16)
    df = slices.neighbour(df, ["k"], ["t", "i"], "v", "after", True)
    df = slices.last_known(df, ["k"], ["t", "i"], F.col("v"), "known")
    got = {x.i: x for x in slices.running_sum(df, ["k"], ["t", "i"], "i", "total").collect()}
    assert len(got) == len(rows)
    for k in (1, 2, None):
        own, known, total = sorted((t, i, v) for a, t, i, v in rows if a == k), None, 0
        for n, (t, i, v) in enumerate(own):
            known, total = (v if v is not None else known), total + i
            assert (got[i].known, got[i].total) == (known, total)
            assert got[i].after == (own[n + 1][2] if n + 1 < len(own) else None)
    empty = slices.cut(spark.createDataFrame([], "k int, t long, v int"), "t")
    assert slices.running_sum(empty, ["k"], ["t"], "v", "s").count() == 0


def test_scalars_on_odd_input(spark):
    assert one(spark, T.clock(F.lit(59.6))) == "1:00" and one(spark, T.watch_state(F.lit(None).cast("double"), F.lit(10.0))) == "new"
    assert one(spark, L.fnv1a(F.lit(None).cast("string"))) == 0x811C9DC5 and one(spark, L.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, L.roman(F.lit("xiv"))) == 14 and one(spark, L.roman(F.lit("IIII"))) == 0
    assert one(spark, L.video_id(F.lit("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1"))) == "dQw4w9WgXcQ" and one(spark, L.video_id(F.lit(None).cast("string"))) == ""
    assert one(spark, N.rate_of(F.lit("1,26"))) == 1.26 and one(spark, N.rate_of(F.lit(""))) == 1.0
    assert one(spark, N.unmark_terms(F.lit("` npm ` y `hooks`"))).strip() == "npm y hooks"
