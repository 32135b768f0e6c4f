"""Places in a text that has changed: quotes found again, blocks placed one after the other, and the best match of
titles between two tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import fold, once

#: Characters of a quote and of what stands before it; shorter ones aren't searched for.
QUOTE, BEFORE, SHORTEST, HALF = 40, 24, 8, 10


def nearest(text: Column, backwards: Column, needle: Column, at: Column) -> Column:
    """Start of the needle's occurrence nearest to a place, the earlier of equals; null without any.

    backwards is the text reversed, in which the last occurrence before the place is the first one found."""
    n, size = F.length(needle), F.length(text)
    ahead = F.call_function("locate", needle, text, at + 1)
    behind = F.call_function("locate", F.reverse(needle), backwards, F.greatest(size - at - n, F.lit(0)) + 1)
    after, before = F.when(ahead > 0, ahead - 1), F.when(behind > 0, size - n - behind + 1)
    near = F.when(before.isNotNull() & (after.isNull() | (at - before <= after - at)), before).otherwise(after)
    return F.when(n > 0, near)


def find_quotes(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows(text, at, quote, before) with place, where the quote now stands, and found, how it was found.

    index: the quote is too short to search for; same: it still stands at its place; quote: elsewhere, accents and
    case apart, the nearest one; half: its first half; before: what stood before it; kept: nothing is left and
    the place stays, within the text; empty: there is no text, place 0. A null place is 0, null strings are empty."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = once(rows, "_t", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({"_at": F.greatest(F.lit(0), F.least(F.floor(F.coalesce("at", F.lit(0))).cast("int"), size)), "_q": F.coalesce("quote", F.lit("")), "_b": fold(F.coalesce("before", F.lit("")))})
    hit = lambda needle: nearest(F.col("_f"), F.col("_r"), needle, F.col("_at"))
    mark = lambda p, k: F.struct((F.col(p) if isinstance(p, str) else p).cast("int").alias("p"), F.lit(k).alias("k"))
    q = fold(F.col("_q"))
    half = F.substring(q, F.lit(1), F.greatest(F.lit(HALF), F.floor(F.length("_q") / 2).cast("int")))
    same = F.substring("_t", F.col("_at") + 1, F.length("_q")) == F.col("_q")
    rows = rows.withColumn("_c", F.when(F.length("_t") == 0, mark(F.lit(0), "empty")).when(F.length("_q") < SHORTEST, mark("_at", "index")).when(same, mark("_at", "same")))
    # only texts that are searched are folded and turned round
    rows = once(once(rows, "_f", F.when(F.col("_c").isNull(), fold(F.col("_t")))), "_r", F.reverse("_f"))
    end = F.when(F.length("_b") >= SHORTEST, hit(F.col("_b")) + F.length("_b"))
    after = F.when(end <= size, end).when(end > size, size)  # least() would take the size for a missing end
    for name, c in (("quote", hit(q)), ("half", hit(half)), ("before", after)):
        rows = once(rows, "_n", F.coalesce("_c", F.when(F.col("_c").isNull() & c.isNotNull(), mark(c, name)))).drop("_c").withColumnRenamed("_n", "_c")
    c = F.coalesce("_c", mark("_at", "kept"))
    return rows.withColumns({"place": c["p"].cast("long"), "found": c["k"]}).drop("_t", "_at", "_q", "_b", "_f", "_r", "_c")


#: Needles by length, window around the expected place, how far beyond it to look at last, letters compared,
#: shares of them that must agree, occurrences compared, and the share of the block before that a place must advance.
NEEDLES, BACK, AHEAD, MARGIN, FAR, LAST, COMPARED = (64, 40, 20, 12), 80, 600, 120, 900, 24, 240
SURE, ENOUGH, TRIES, ADVANCE, SLACK, LEAST = 0.55, 0.45, 6, 0.6, 0.2, 6


def compact(text: str) -> str:
    """The letters a-z and digits of a text, accents and case apart."""
    plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", text)).lower()
    return re.sub("[^a-z0-9]", "", plain)


def agreement(text: str, block: str, at: int) -> float:
    """Share of the block's first letters that the text has at the same distance from a place."""
    own = block[:COMPARED]
    return sum(a == b for a, b in zip(text[at : at + len(own)], own)) / len(own)


def _occurrences(text: str, needle: str, low: int, high: int) -> list[int]:
    found: list[int] = []
    while len(found) < TRIES and (at := text.find(needle, found[-1] + 1 if found else low, high)) >= 0:
        found.append(at)
    return found


def _place(text: str, block: str, expected: int, last: int | None, length: int) -> int | None:
    """Where a block starts, given where it should and the place and length of the block placed before."""
    least = 0 if last is None else last + int(length * ADVANCE)
    first = min(NEEDLES[0], len(block))
    low, high = max(0, expected - BACK), min(len(text), expected + max(AHEAD, first + MARGIN))
    sizes = [first, *(n for n in NEEDLES[1:] if n < first)]
    hits = next((h for n in sizes if (h := _occurrences(text, block[:n], low, high))), [])
    rated = [(agreement(text, block, at), -k, at) for k, at in enumerate(hits)]
    if (best := max((r for r in rated if r[2] >= least), default=None)) and best[0] >= SURE:
        return best[2]
    onward = max((r for r in rated if last is None or r[2] > last), default=None)
    if onward and onward[0] >= ENOUGH and onward[2] >= least - int(length * SLACK):
        return onward[2]
    at = text.find(block[: min(LAST, first)], expected, min(len(text), expected + FAR))
    return at if at >= max(least, 0) and agreement(text, block, at) >= ENOUGH else None


def place_blocks(texts: DataFrame, key: str, text: str = "text", blocks: str = "blocks") -> DataFrame:
    """(key, block, length, place, firm) for every block of texts(key, text, blocks array<string>), in compact letters.

    Blocks follow each other: each is looked for around the end of the one before, by its first letters, and the
    occurrence that goes on like the block is taken. firm: it was found. Places of the others are spread between those found,
    by the lengths of the blocks. Null texts and blocks are empty; blocks below LEAST letters aren't looked for. A text and
    its blocks are one row."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, t, bs in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t, bs = compact(t or ""), [compact(b or "") for b in bs or []]
                places: list[int | None] = []
                last, length, expected = None, 0, 0
                for b in bs:
                    at = _place(t, b, expected, last, length) if len(b) >= LEAST else None
                    places.append(at)
                    if at is not None:
                        last, length, expected = at, len(b), at + len(b)
                    elif len(b) >= LEAST:
                        expected = last + length if last is not None else expected + len(b)
                    elif last is not None:
                        expected = last + length
                for i, (b, at, p) in enumerate(zip(bs, places, spread(places, len(t), [len(b) for b in bs]))):
                    for col, v in zip(out, (k.as_py(), i, len(b), p, at is not None)):
                        col.append(v)
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [key, "block", "length", "place", "firm"])

    return texts.select(key, text, blocks).mapInArrow(run, f"`{key}` {kind}, block int, length long, place long, firm boolean")


def spread(places: list[int | None], total: int, lengths: list[int]) -> list[int]:
    """Places with the unknown ones put between their known neighbours (0 and the end), in proportion to what comes before each."""
    out = list(places)
    for i, at in enumerate(places):
        if at is None and (i == 0 or places[i - 1] is not None):
            end = next((j for j in range(i, len(places)) if places[j] is not None), len(places))
            low, high = (places[i - 1] if i else 0), (places[end] if end < len(places) else total)
            sizes = [max(1, lengths[max(0, j)]) for j in range(i - 1, end)] if any(lengths) else [1] * (end - i + 1)
            run = 0
            for j in range(i, end):
                run += sizes[j - i]
                out[j] = int(low + (high - low) * run / sum(sizes) + 0.5)
    return out


#: Words that don't help to compare titles.
TITLE_STOP = (
    "el la los las un una unos unas de del y o a en con por para que su sus al lo "
    "the a an of and or to in on for how is"
).split()
#: Least score of a match, what an author adds, and the least share of an author's words.
MATCH, AUTHOR, AUTHOR_SHARE = 0.6, 0.25, 0.5


def title_words(c: Column) -> Column:
    """Folded words of two letters or more that aren't in TITLE_STOP."""
    return F.filter(_title_split(c), lambda w: (F.length(w) > 1) & ~w.isin(TITLE_STOP))


def _title_split(c: Column) -> Column:
    return F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")


def best_matches(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """wanted(id, title, author) with match and score: the row of offered(id, title, author, cover) whose title holds
    the largest share of the wanted title's words, an agreeing author adding to it; the smallest id of equals. Null
    below MATCH, without words or without an offer that has a cover.

    Titles of offers are read once. Only their words that some wanted title has are dealt, by offer, so that the words
    a pair shares are counted where they are; authors are asked of pairs only that an author could still lift to MATCH."""
    asked = wanted.select(F.col("id").alias("book"), title_words(F.col("title")).alias("words"), title_words(F.col("author")).alias("by")).withColumn("n", F.size("words"))
    offers = offered.where("cover is not null").select(F.col("id").alias("offer"), "title", F.col("author").alias("offer_by"))
    own = asked.select("book", "n", F.explode("words").alias("word")).groupBy("book", "n", "word").agg(F.count("*").alias("times"))
    # words that no title asks for, stop words among them, fall out of the join
    terms = offers.select("offer", F.explode(F.array_distinct(_title_split(F.col("title")))).alias("word")).join(own.select("word").distinct(), "word", "left_semi")
    shared = terms.repartition("offer").join(own, "word").groupBy("offer", "book", "n").agg(F.sum("times").alias("hits"))
    shared = shared.where(F.col("hits") / F.col("n") + AUTHOR >= MATCH)
    rated = shared.join(offers.select("offer", title_words(F.col("offer_by")).alias("offer_by")), "offer").join(asked.select("book", "by"), "book")
    agree = (F.size("by") > 0) & (F.size(F.filter("by", lambda w: F.array_contains("offer_by", w))) >= AUTHOR_SHARE * F.size("by"))
    rated = rated.withColumn("score", F.col("hits") / F.col("n") + F.when(agree, AUTHOR).otherwise(0.0))
    best = rated.where(F.col("score") >= MATCH).groupBy("book").agg(F.max(F.struct("score", (-F.col("offer")).alias("o"))).alias("m"))
    best = best.select(F.col("book").alias("id"), (-F.col("m.o")).alias("match"), F.col("m.score").alias("score"))
    return wanted.join(best, "id", "left")


def compact_text(c: Column) -> Column:
    """The letters a-z and digits of a text, accents and case apart. Null is empty."""
    return F.regexp_replace(_folded(c), "[^a-z0-9]+", "")


def _folded(c: Column) -> Column:
    """fold() with one character for each of the text: İ alone gives two in lower case, of which the first counts."""
    return fold(F.replace(F.coalesce(c, F.lit("")), F.lit("İ"), F.lit("i")))


def compacted(c: Column) -> Column:
    """struct(text, places): the letters a-z and digits of a text, accents and case apart, and where each stood. Null is empty."""
    letter = lambda x: x.between("a", "z") | x.between("0", "9")  # noqa: E731 - one character each, compared by bytes
    places = F.array_compact(F.transform(F.split(_folded(c), ""), lambda x, i: F.when(letter(x), i)))
    return F.struct(compact_text(c).alias("text"), places.alias("places"))


#: Letters of a page's start that are looked for, at first and then, and the fewest.
START, FIRST, FEWEST = 40, 14, 6


def place_pages(texts: DataFrame, key: str, text: str = "text", marks: str = "marks") -> DataFrame:
    """(key, page, place): where the pages of texts(key, text, marks array<struct<page, sample>>) start in a text that was changed.

    Pages are looked for by the first letters of their samples, always behind the one before; one that isn't found, or
    whose sample has fewer than FEWEST letters, is left out. A text and its marks are one row."""
    rows = once(texts.select(key, text, marks), "_c", compacted(F.col(text)))
    page = texts.schema[marks].dataType.elementType["page"].dataType.simpleString()
    starts = F.transform(marks, lambda m: F.struct(m["page"].alias("page"), F.substring(compact_text(m["sample"]), 1, START).alias("n")))
    rows = once(rows, "_m", starts)
    seek = lambda needle, s: F.call_function("locate", needle, F.col("_c.text"), s["at"] + 1)

    def step(s: Column, m: Column) -> Column:
        whole, size = seek(m["n"], s), F.length(m["n"])
        hit = F.when(size < FEWEST, 0).when((whole == 0) & (size > FIRST), seek(F.substring(m["n"], 1, FIRST), s)).otherwise(whole)
        found = F.struct((hit - 1 + F.greatest(F.lit(1), F.floor(size / 2).cast("int"))).alias("at"), F.array_append(s["out"], F.struct(m["page"].alias("page"), F.get("_c.places", hit - 1).alias("place"))).alias("out"))
        return F.when(hit > 0, found).otherwise(s)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<page:{page},place:int>>").alias("out"))
    return rows.select(key, F.explode(F.aggregate("_m", begin, step)["out"]).alias("x")).select(key, "x.page", "x.place")
