"""Boxes of a page, (keys, id, x0, y0, x1, y1): which ones meet, and boxes merged until none meet.

Boxes meet on a grid, not page by page: a box lies in at most four cells of a grid as fine as its own size, and
looks for others in that grid and the coarser ones of its page. Boxes are merged page by page as far as pages are
small, what is left of larger ones on the grid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import settled

SIDES = ["x0", "y0", "x1", "y1"]
#: Boxes of a page that are compared with each other at once.
CHUNK = 512


def touching(boxes: DataFrame, keys: list[str], margin: float = 8) -> DataFrame:
    """Pairs (keys, a, b), a < b, of boxes of a page that meet within the margin. Boxes without a side meet nothing."""
    least = math.ceil(math.log2(max(margin, 1)))
    rows = boxes.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in SIDES]).dropna(subset=["id", *SIDES])
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + F.lit(margin)
    rows = rows.withColumn("level", F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(size, F.lit(1.0))))).cast("int"))
    # the levels of a page are a few; a box that is alone on its page meets nothing
    levels = rows.groupBy(*keys).agg(F.collect_set("level").alias("levels"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(levels, keys)

    def cells(df: DataFrame) -> DataFrame:
        edge = F.pow(F.lit(2.0), F.col("level"))
        for axis, low, high in (("cx", "x0", "x1"), ("cy", "y0", "y1")):
            df = df.withColumn(axis, F.explode(F.sequence(F.floor(F.col(low) / edge), F.greatest(F.floor(F.col(low) / edge), F.floor((F.col(high) + (margin + 1e-6)) / edge)))))
        return df

    b = cells(rows).select(*keys, "level", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("id", *SIDES)])
    a = rows.withColumnRenamed("level", "own").withColumn("level", F.explode(F.filter("levels", lambda k: k >= F.col("own"))))
    a = cells(a.drop("levels"))
    meet = a.join(b, [*keys, "level", "cx", "cy"]).where((F.col("own") < F.ceil(F.log2(F.greatest(F.lit(2.0 ** least), F.col("b_x1") - F.col("b_x0") + margin, F.col("b_y1") - F.col("b_y0") + margin, F.lit(1.0))))) | (F.col("id") < F.col("b_id")))
    meet = meet.where(f"x0 - {margin} <= b_x1 and b_x0 - {margin} <= x1 and y0 - {margin} <= b_y1 and b_y0 - {margin} <= y1")
    # a pair counts in one cell only: that of the low corner of what they share
    edge = F.pow(F.lit(2.0), F.col("level"))
    meet = meet.where((F.col("cx") == F.floor(F.greatest("x0", "b_x0") / edge)) & (F.col("cy") == F.floor(F.greatest("y0", "b_y0") / edge)))
    return meet.select(*keys, F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b"))


def classes(box: np.ndarray, margin: float) -> np.ndarray:
    """For each of some boxes (rows of four sides) the first of those it becomes one with, when boxes that meet are merged until none do."""
    of, now, first = np.arange(len(box)), box, np.arange(len(box))
    while len(now) > 1:
        x0, y0, x1, y1 = now.T
        x, y = x0[:, None] - margin <= x1, y0[:, None] - margin <= y1
        meet = x & x.T & y & y.T
        np.fill_diagonal(meet, True)
        to = meet.argmax(1)  # the first one met, or itself
        if (to == np.arange(len(now))).all():
            break
        while (to[to] != to).any():
            to = to[to]
        order = np.argsort(to, kind="stable")
        heads, to = np.unique(to, return_inverse=True)
        at = np.flatnonzero(np.diff(to[order], prepend=-1))
        now = np.hstack([np.minimum.reduceat(now[order, :2], at), np.maximum.reduceat(now[order, 2:], at)])
        of, first = to[of], first[heads]
    return first[of]


def contracted(boxes: DataFrame, keys: list[str], margin: float, chunk: int = CHUNK) -> DataFrame:
    """boxes, merged as far as those of a page meet among `chunk` boxes that follow each other downwards; whole: these are all of the page, so it is finished.

    Which boxes end in one doesn't depend on the order in which they are merged. A page streams through one task, a chunk at a time."""
    # boxes without a page meet nothing
    w = Window.partitionBy(*keys, F.when(~F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda known: known), F.col("id")))
    rows = boxes.withColumn("_n", (F.row_number().over(w.orderBy("y0", "id")) - 1) % chunk).withColumn("whole", F.count("*").over(w) <= chunk)
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def put(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        box, to = np.column_stack([t[c].to_numpy() for c in SIDES]), np.arange(len(t))
        starts = np.flatnonzero(t["_n"].to_numpy() == 0)
        ends = np.append(starts[1:], len(t))
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            to[s:e] = s + classes(box[s:e], margin)
        yield from t.append_column("to", t["id"].take(pa.array(to))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b["_n"].to_numpy() == 0)
            if len(starts):  # what began earlier ends before the last start
                yield from put([*held, b.slice(0, starts[-1])])
                b, held = b.slice(starts[-1]), []
            held.append(b)
        if held:
            yield from put(held)

    return _united(rows.mapInArrow(run, f"{made}, to {rows.schema['id'].dataType.simpleString()}"), keys, F.min("whole").alias("whole"))


def _united(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    """Boxes of one `to` as one box."""
    sides = [(F.min if c.endswith("0") else F.max)(c).alias(c) for c in SIDES]
    return rows.groupBy(*keys, "to").agg(F.min("id").alias("id"), *sides, F.sum("boxes").alias("boxes"), F.min("repeated").alias("repeated"), *more).drop("to")


def merged(boxes: DataFrame, keys: list[str], margin: float = 8, max_rounds: int = 200, chunk: int = CHUNK) -> DataFrame:
    """(keys, id, x0, y0, x1, y1, boxes, repeated): boxes that meet become one, which may meet others, until none do.

    id is the smallest of those merged, repeated holds if it does for all of them. Pages of up to `chunk` boxes are
    finished at once. Others go on in rounds: every box joins the neighbour, or itself, that comes first in a random
    order, so a chain of boxes halves in about each round."""
    flag = F.col("repeated") if "repeated" in boxes.columns else F.lit(False)
    now = boxes.select(*keys, "id", *[F.col(c).cast("double").alias(c) for c in SIDES], F.lit(1).cast("long").alias("boxes"), F.coalesce(flag, F.lit(False)).alias("repeated"))
    now = settled(contracted(now, keys, margin, chunk))
    done, now = [now.where("whole").drop("whole")], now.where("not whole").drop("whole")
    if now.isEmpty():
        return done[0]
    for k in range(max_rounds):
        pairs = settled(touching(now, keys, margin))
        if pairs.isEmpty():
            for part in done:
                now = now.unionByName(part)
            return now
        open_ = pairs.select(*keys).distinct()
        done.append(now.join(open_, keys, "left_anti"))  # pages that are finished
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("to"))
        both = pairs.select(*keys, F.col("a").alias("id"), rank("b").alias("r")).unionByName(pairs.select(*keys, F.col("b").alias("id"), rank("a").alias("r")))
        to = both.groupBy(*keys, "id").agg(F.min("r").alias("r"))
        joined = now.join(open_, keys, "left_semi").join(to, [*keys, "id"], "left").withColumn("to", F.least(rank("id"), F.coalesce("r", rank("id")))["to"])
        now = settled(_united(joined, keys))
    raise RuntimeError(f"boxes still meet after {max_rounds} rounds")
