"""Pages of positioned text pieces: columns, lines, boundaries, boxes, outlines and speech time along a text.

Pieces are rows (doc, page, item, str, x, y, width, height). Windows run within a page, which is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.normal import first_fragment, last_fragment
from strandline.operators.sequences import scan, streamed

WIDTH, SPLIT, FULL = 595.0, 0.22, 0.7


def median(c: str) -> Column:
    """Median of the positive values, 0 without any; an aggregate."""
    return F.coalesce(F.median(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def columns(pieces: DataFrame, keys: list[str], width: float = WIDTH) -> DataFrame:
    """(keys, columns, split) of each page: two columns where the widest gap between neighbouring x is over SPLIT of the width and both sides hold two pieces."""
    rows = _halved(pieces.where("trim(str) <> ''").dropna(subset=keys), keys, width).groupBy(*keys).agg(F.max("split").alias("split"))
    return rows.select(*keys, F.when(F.col("split").isNotNull(), 2).otherwise(1).alias("columns"), "split")


def _halved(pieces: DataFrame, keys: list[str], width: float) -> DataFrame:
    """pieces with the split that columns() finds for their page, null on pages of one column. Blank pieces don't count."""
    w, worded = Window.partitionBy(*keys), F.coalesce(F.trim("str") != "", F.lit(False))
    rows = pieces.withColumn("_b", F.lag("x").over(w.orderBy(F.desc(worded), "x")))  # blank ones come last, so none is before another
    # the first of equal gaps
    gap = F.when(worded, F.struct(F.coalesce(F.col("x") - F.col("_b"), F.lit(0.0)).alias("g"), (-F.col("x")).alias("x")))
    rows = rows.withColumn("_m", F.max(gap).over(w)).withColumn("_s", -F.col("_m.x") - F.col("_m.g") / 2)
    side = lambda c: F.count_if(worded & c).over(w)
    l, r = side(F.col("x") < F.col("_s")), side(F.col("x") >= F.col("_s"))
    two = (F.count_if(worded).over(w) >= 6) & (F.col("_m.g") > width * SPLIT) & (F.least(l, r) >= 2)
    return rows.withColumn("split", F.when(two, F.col("_s"))).drop("_b", "_m", "_s")


def lines(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with the number of their visual line and its height on the page.

    A piece joins the first line whose mean y is within 0.45 of the page's median height (1.5 at least);
    the mean moves with it. Pages are read in the order of their items; pieces without a page are left out.
    """
    rows = pieces.dropna(subset=keys).withColumn("_tol", F.median(F.when(F.col("height") > 0, F.col("height"))).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("_tol", F.greatest(F.lit(1.5), F.coalesce("_tol", F.lit(10.0)) * 0.45)).sortWithinPartitions(*keys, "item")

    def step(state, r):
        for n, line in enumerate(state):
            if abs(line[0] - r["y"]) <= r["_tol"]:
                line[1] += 1
                line[0] = (line[0] * (line[1] - 1) + r["y"]) / line[1]
                return state, (n,)
        state.append([r["y"], 1])
        return state, (len(state) - 1,)

    return streamed(rows, keys, ["y", "_tol"], list, step, "line long").drop("_tol")


def reading_order(pieces: DataFrame, keys: list[str], width: float = WIDTH) -> DataFrame:
    """pieces(keys, item, str, x, y, width, height, rtl) with their place (from 0) in the order in which a page is read.

    A page is a stack of bands, highest y first: pieces of a band are on one line. Within a band come pieces that
    span the page (wider than FULL of it, or across the gap between its columns), then column by column; from right
    to left where most pieces of the page are. Equals keep the order of their items. A page is one window."""
    w = Window.partitionBy(*keys)
    turned = F.count_if(F.coalesce("rtl", F.lit(False))).over(w) * 2 > F.count("*").over(w)
    lined = lines(_halved(pieces, keys, width).withColumn("_rtl", turned), keys).repartition(*keys)
    rows = lined.withColumn("_band", F.round(F.avg("y").over(Window.partitionBy(*keys, "line")), 6))
    wide = F.coalesce("width", F.lit(0.0))
    spans = F.col("split").isNotNull() & ((wide > width * FULL) | (F.col("x") < F.col("split")) & (F.col("x") + wide > F.col("split")))
    column = F.when(F.col("split").isNull() | (F.col("x") < F.col("split")), 0).otherwise(1)
    turn = F.when(F.col("_rtl"), -1).otherwise(1)
    w = w.orderBy(F.desc("_band"), "line", F.when(spans, 0).otherwise(1), F.when(spans, 0).otherwise(column * turn), F.col("x") * turn, "item")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumn("column", F.when(spans, -1).otherwise(column)).drop("line", "_band", "split", "_rtl")


def line_texts(lined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text, x, y, width) of lines(): pieces from left to right, a blank where the gap is over 0.15 of the height."""
    w = Window.partitionBy(*keys, "line").orderBy("x", "item")
    before = F.lag(F.struct((F.col("x") + F.coalesce("width", F.lit(0.0))).alias("end"), "str")).over(w)
    rows = lined.withColumn("_b", before)
    blank = F.col("_b").isNotNull() & (F.col("x") - F.col("_b.end") > F.greatest(F.lit(1.0), F.col("height") * 0.15)) & ~F.col("_b.str").rlike(r"\s$") & ~F.col("str").rlike(r"^\s")
    rows = rows.withColumn("_s", F.concat(F.when(blank, " ").otherwise(""), "str"))
    got = rows.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("x", "item", "_s"))).alias("p"), F.min("x").alias("x"), F.avg("y").alias("y"), F.max(F.struct("x", (F.col("x") + F.coalesce("width", F.lit(0.0))).alias("e"))).alias("last"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("p", lambda q: q["_s"]), ""), r"\s+", " "))
    return got.select(*keys, "line", text.alias("text"), "x", "y", F.greatest(F.lit(0.0), F.col("last.e") - F.col("x")).alias("width")).where("text <> ''")


def boundaries(pieces: DataFrame, doc: str, order: list[str], split: DataFrame | None = None, keys: list[str] | None = None, width: float = WIDTH) -> DataFrame:
    """Neighbouring pieces of a document: kind, separator, the words that meet, gap and step between the lines.

    split: columns() of the pages by `keys`, for breaks between columns. A document's pieces are one window.
    """
    rows = pieces.join(split.select(*keys, "split"), keys, "left") if split is not None else pieces.withColumn("split", F.lit(None).cast("double"))
    side = F.struct("page", "item", "str", "x", "y", "width", "height", "eol", "split")
    rows = rows.select(doc, *order, side.alias("l"), F.lead(side).over(Window.partitionBy(doc).orderBy(*order)).alias("r")).where("r is not null")
    a, b = F.col("l"), F.col("r")
    narrow = (a["width"] <= width * FULL) & (b["width"] <= width * FULL)
    apart = a["split"].isNotNull() & narrow & ((a["x"] < a["split"]) != (b["x"] < a["split"]))
    same = F.abs(a["y"] - b["y"]) <= F.greatest(F.lit(1.5), F.greatest(a["height"], b["height"], F.lit(8.0)) * 0.45)
    kind = F.when(a["page"] != b["page"], "page").when(apart, "column").when(same, "gap").otherwise("wrap")
    end = F.regexp_replace(a["str"], r"\s+$", "")
    sep = (
        F.when(end.endswith("­"), "soft").when(end.rlike("[-‐‑‒]$"), "hyphen").when(a["str"].rlike(r"\s$") | b["str"].rlike(r"^\s"), "space")
        .when(F.coalesce(a["eol"], F.lit(False)), "eol").otherwise("")
    )
    gap = F.when(kind == "gap", b["x"] - a["x"] - F.coalesce(a["width"], F.lit(0.0))).otherwise(0.0)
    return rows.select(
        doc, a["item"].alias("left_item"), b["item"].alias("right_item"), kind.alias("kind"), sep.alias("separator"), last_fragment(a["str"]).alias("left_word"), first_fragment(b["str"]).alias("right_word"),
        gap.alias("gap"), (a["y"] - b["y"]).alias("step"), a["str"].rlike(r"[.!?…»”\"')\]]\s*$").alias("stopped"),
    )


def page_quality(pieces: DataFrame, pages: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, pieces, chars, mean, low) of every page of either side: mean score and pieces below 85."""
    n = pieces.groupBy(*keys).agg(F.count("*").alias("pieces"), F.sum(F.length("str")).alias("chars"), F.avg(score).alias("mean"), F.count_if(F.col(score) < 85).alias("low"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select(*keys).join(n, keys, "full").select(*keys, zero("pieces"), zero("chars"), "mean", zero("low"))


def same_letters(pieces: DataFrame, texts: DataFrame, doc: str) -> DataFrame:
    """(doc, kept): whether a text has as many of each letter and digit as its pieces, compared as sums of hashes."""
    def sums(df: DataFrame, c: str, name: str) -> DataFrame:
        letters = df.select(doc, F.explode(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), "")).alias("ch")).where("ch <> ''")
        return letters.groupBy(doc).agg(F.sum(F.xxhash64("ch").cast("decimal(38,0)")).alias(name))

    both = sums(pieces, "str", "a").join(sums(texts, "text", "b"), doc, "full")
    return both.select(doc, (F.col("a").eqNullSafe(F.col("b"))).alias("kept"))


def structure_roles(pieces: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with the role of their mark; marks with several roles have none."""
    one = roles.groupBy(*keys).agg(F.min("role").alias("role"), F.max("role").alias("_r")).where("role = _r").drop("_r")
    return pieces.join(one, keys, "left")


def thin_chapters(chapters: DataFrame, key: str, length: str, least: int = 1200) -> DataFrame:
    """Chapters(key, position, length) that keep their distance from the next one kept, from the end backwards; the first always stays.

    The distance is `least` or, in short texts, a share of the length by the number of chapters.
    """
    n = chapters.groupBy(key).agg(F.count("*").alias("_n"), F.min("position").alias("_first"))
    rows = chapters.join(n, key).withColumn("_min", F.least(F.lit(least), F.floor(F.greatest(F.col(length), F.lit(1)) / F.greatest(F.lit(4), F.col("_n") * 2)))).withColumn("_back", -F.col("position"))

    def step(after, r):
        ok = (after if after is not None else max(1, r[length])) - r["position"] >= r["_min"]
        return (r["position"] if ok else after), (ok,)

    kept = scan(rows, key, ["_back"], lambda: None, step, "_ok boolean")
    return kept.where((F.col("_ok")) | (F.col("position") == F.col("_first"))).select(key, "position").distinct()


def speech_clock(costs: DataFrame, key: str, place: str, cost: str) -> DataFrame:
    """costs with the sum before each place and its share of the key's total: the time at which it is said."""
    w = Window.partitionBy(key).orderBy(place)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(cost).over(Window.partitionBy(key))
    return costs.withColumn("before", before).withColumn("share", F.coalesce(F.try_divide(before, total), F.lit(0.0)))


def place_at(clocked: DataFrame, at: DataFrame, key: str, place: str, cost: str) -> DataFrame:
    """(key, place) said at a share of the time, at(key, fraction): the first place whose own time ends there or later."""
    w = clocked.join(at, key)
    total = F.sum(cost).over(Window.partitionBy(key))
    hit = w.withColumn("_t", total).where(F.col("before") + F.col(cost) >= F.col("fraction") * F.col("_t"))
    return hit.groupBy(key).agg(F.min(place).alias(place))


def next_cost(tail: Column) -> Column:
    """Time that a letter takes by what follows it: paragraph 27, stop 19, line 11, comma or dash 8, else 1."""
    sign = F.regexp_extract(tail, r"^\s*[»\"'’”)\]]*\s*([.!?…]+|[,;:—–-])", 1)
    return F.when(F.substring(tail, 1, 3).rlike(r"\n\s*\n"), 27).when(tail.startswith("\n"), 11).when(sign.rlike("[.!?…]"), 19).when(sign != "", 8).otherwise(1)
