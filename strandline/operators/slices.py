"""Windows over keys of any size: a key's rows are cut into slices of their order, and what a slice needs from
the others (one sum, one row, one value) is carried over a small table of slices.

A window by key alone puts all rows of a key into one task. Here a task holds one slice; the table has at
most SLICES rows a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def cut(df: DataFrame, order: str, slices: int = SLICES, least: int = 1) -> DataFrame:
    """df with _slice, equal widths of the order column (a number) between its ends, `least` wide at least; nulls are slice -1."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = max((high - low) / slices, least) if low is not None else 1
    place = F.floor((F.col(order) - F.lit(low if low is not None else 0)) / F.lit(width)).cast("long")
    return df.withColumn("_slice", F.coalesce(place, F.lit(-1).cast("long")))


def _carried(df: DataFrame, key: list[str], made: Column, over: Column) -> DataFrame:
    """df joined with `over`, computed on the table of slices from each slice's `made`."""
    table = df.groupBy(*key, "_slice").agg(made.alias("_v")).withColumn("_c", over).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_slice").alias("_s"), "_c")
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(table, same, "left").drop("_s", *[f"_k{i}" for i in range(len(key))])


def _by(key: list[str], down: bool):
    return Window.partitionBy(*key).orderBy(F.desc("_slice") if down else F.col("_slice"))


def running_sum(df: DataFrame, key: list[str], order: list, value: str, name: str, down: bool = False) -> DataFrame:
    """df (cut, by the first of order) with the sum of value up to each row, its equals in order included; from the end if down."""
    before = F.coalesce(F.sum("_v").over(_by(key, down).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = _carried(df, key, F.sum(value), before)
    local = F.sum(value).over(Window.partitionBy(*key, "_slice").orderBy(*order))
    return df.withColumn(name, F.col("_c") + local).drop("_c")


def neighbour(df: DataFrame, key: list[str], order: list[str], value: str, name: str, ahead: bool) -> DataFrame:
    """df (cut) with the value of the next row in order, or of the one before."""
    o, v = F.struct(*order), F.struct(F.col(value).alias("v"))
    edge = F.min_by(v, o) if ahead else F.max_by(v, o)
    move = F.lead if ahead else F.lag
    df = _carried(df, key, edge, move("_v").over(_by(key, False)))
    local = move(v).over(Window.partitionBy(*key, "_slice").orderBy(*order))
    return df.withColumn(name, F.coalesce(local, F.col("_c"))["v"]).drop("_c")


def last_known(df: DataFrame, key: list[str], order: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """df (cut) with the latest value that isn't null at or before each row; ahead: the first at or behind it."""
    df = df.withColumn("_x", value)
    o = F.when(F.col("_x").isNotNull(), F.struct(*order))
    pick, edge = (F.first, F.min_by(F.col("_x"), o)) if ahead else (F.last, F.max_by(F.col("_x"), o))
    # the nearest earlier slice that has one; with ahead the slices run backwards
    over = F.last("_v", ignorenulls=True).over(_by(key, ahead).rowsBetween(Window.unboundedPreceding, -1))
    df = _carried(df, key, edge, over)
    frame = (0, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, 0)
    local = pick("_x", ignorenulls=True).over(Window.partitionBy(*key, "_slice").orderBy(*order).rowsBetween(*frame))
    return df.withColumn(name, F.coalesce(local, F.col("_c"))).drop("_c", "_x")


def range_sum(df: DataFrame, key: list[str], order: str, value: str, name: str, horizon: int) -> DataFrame:
    """df with the sum of value from each row's order up to, not at, `horizon` later. Slices are at least that
    wide, so a row is needed in its own slice and the one before."""
    df = cut(df, order, least=horizon)
    rows = df.withColumn("_own", F.col("_slice")).withColumn("_slice", F.explode(F.array("_slice", F.col("_slice") - 1)))
    w = Window.partitionBy(*key, "_slice").orderBy(order).rangeBetween(0, horizon - 1)
    return rows.withColumn(name, F.sum(value).over(w)).where("_slice = _own").drop("_slice", "_own")
