"""Timed segments: clipping, matching, sessions, sums over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import slices


def clip_overlaps(df: DataFrame, key: str, start: str, end: str, tie: str, least: int) -> DataFrame:
    """Ends clipped to the next start, but at least `least` after their own start."""
    df = slices.neighbour(slices.cut(df, start), [key], [start, tie], start, "_next", ahead=True)
    return df.withColumn(end, F.greatest(F.least(F.col(end), F.coalesce("_next", F.col(end))), F.col(start) + least)).drop("_next", "_slice")


def asof_previous(points: DataFrame, marks: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """The latest mark of the key at or before each point; one sort of both sides in slices of time, no range join."""
    a = points.select(key, time, tie, F.lit(1).alias("_point"), F.lit(None).cast(marks.schema[value].dataType).alias("match"))
    b = marks.select(key, time, F.lit(None).cast(points.schema[tie].dataType).alias(tie), F.lit(0).alias("_point"), F.col(value).alias("match"))
    both = slices.last_known(slices.cut(a.unionByName(b), time), [key], [time, "_point", "match"], F.col("match"), "_m")
    return both.where("_point = 1").select(key, tie, F.col("_m").alias("match"))


def interval_overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of (id, start, end) intervals of a key that overlap. Time is cut into cells of `width`, both sides meet in shared cells, and a pair is kept in the cell of its later start only."""
    cells = lambda d, p: d.select(
        key, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("cell"),
    )
    a, b = cells(left.where("end > start"), "a"), cells(right.where("end > start"), "b")
    hit = a.join(b, [key, "cell"]).where("a_start < b_end and a_end > b_start")
    return hit.where(F.col("cell") == F.floor(F.greatest("a_start", "b_start") / width)).select(key, "a_id", "b_id")


def gap_sessions(df: DataFrame, key: str, time: str, tie: str, gap: int) -> DataFrame:
    """Runs of a key whose neighbours are at most `gap` apart."""
    df = slices.neighbour(slices.cut(df, time), [key], [time, tie], time, "_before", ahead=False)
    df = df.withColumn("_new", F.coalesce((F.col(time) - F.col("_before") > gap).cast("long"), F.lit(1)))
    got = slices.running_sum(df, [key], [time, tie], "_new", "session")
    return got.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"))


def sum_ahead(df: DataFrame, key: str, time: str, value: str, horizon: int) -> DataFrame:
    """Sum of a whole-numbered time's rows from each row up to, not at, `horizon` later."""
    return slices.range_sum(df, [key], time, value, "ahead", horizon)


def cumulative_share(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    run, all_ = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    return df.withColumn("share", F.round(F.sum(value).over(run) / F.sum(value).over(all_), 4))


def fill_gaps(df: DataFrame, key: str, position: str, value: str, total: float) -> DataFrame:
    """Nulls between known values interpolated by position; before the first known one from 0, behind the last one to `total`."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    ends = df.groupBy(F.col(key).alias("_key")).agg(F.min(position).alias("_first"), (F.max(position) + 1).alias("_end"))
    df = slices.cut(df, position)
    df = slices.last_known(slices.last_known(df, [key], [position], known, "_a"), [key], [position], known, "_b", ahead=True)
    df = df.join(ends, F.col(key).eqNullSafe(F.col("_key")))
    # the first row stands at 0 and a row behind the last one at the total
    a = F.coalesce("_a", F.struct(F.col("_first").alias("p"), F.lit(0.0).alias("v")))
    b = F.coalesce("_b", F.struct(F.col("_end").alias("p"), F.lit(float(total)).alias("v")))
    part = F.coalesce(F.try_divide(F.col(position) - a["p"], b["p"] - a["p"]), F.lit(0.0))
    return df.withColumn("filled", F.coalesce(F.col(value), a["v"] + (b["v"] - a["v"]) * part)).drop("_a", "_b", "_first", "_end", "_key", "_slice")


def segment_at(points: DataFrame, segments: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """(key, tie, match): the last of segments(key, start, end, id) that begins at or before a point, if it holds the point; else null."""
    ends = segments.withColumn("mark", F.struct(F.col("end").alias("end"), F.col("id").alias("id")))
    found = asof_previous(points, ends.withColumnRenamed("start", time), key, time, tie, "mark")
    return found.join(points.select(tie, F.col(time).alias("_t")), tie).select(key, tie, F.when(F.col("_t") < F.col("match.end"), F.col("match.id")).alias("match"))


def next_end(points: DataFrame, segments: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """(key, tie, match): the first of segments(key, start, end, id) that ends after a point; a forward as-of match on ends."""
    a = points.select(key, F.col(time).alias("_t"), tie, F.lit(1).alias("_point"), F.lit(None).cast("struct<end:bigint,id:bigint>").alias("_m"))
    b = segments.select(key, F.col("end").alias("_t"), F.lit(None).cast(points.schema[tie].dataType).alias(tie), F.lit(0).alias("_point"), F.struct(F.col("end").cast("long").alias("end"), F.col("id").cast("long").alias("id")).alias("_m"))
    # an end at the point itself comes before it and doesn't count
    both = slices.last_known(slices.cut(a.unionByName(b), "_t"), [key], ["_t", "_point", "_m"], F.col("_m"), "_f", ahead=True)
    return both.where("_point = 1").select(key, tie, F.col("_f.id").alias("match"))


def soft_hard_limits(units: DataFrame, key: str, borrow: float = 2.0) -> DataFrame:
    """units(key, place, start, end) with hard (the next start, or `borrow` after the end) and soft (at most `borrow` after the end)."""
    pause = F.col("end") + borrow
    hard = F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("place")), pause)
    return units.withColumn("hard", hard).withColumn("soft", F.least(F.col("hard"), pause))


def covered_until(units: DataFrame, now: DataFrame, key: str, open_: Column) -> DataFrame:
    """(key, seconds): from now(key, at) to the first unit(key, start, end) still open that ends later; null if all are done."""
    left = units.where(open_).join(now, key).where("end > at").groupBy(key).agg(F.min("start").alias("s"))
    return now.join(left, key, "left").select(key, F.greatest(F.lit(0.0), F.col("s") - F.col("at")).alias("seconds"))


def units_to_make(units: DataFrame, now: DataFrame, key: str, open_: Column, horizon: float, limit: int) -> DataFrame:
    """The first `limit` open units of each key that end after now(key, at) and start within the horizon."""
    near = units.where(open_).join(now, key).where(f"end > at and start <= at + {horizon}")
    w = Window.partitionBy(key).orderBy("start", "place")
    return near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).select(key, "place")


def owned_chunks(df: DataFrame, length: str, size: int, overlap: int = 0) -> DataFrame:
    """fixed_windows with `limit`, the middle of the overlap from which a chunk owns what it holds, and the last chunk taking a short tail."""
    cut = fixed_windows(df, length, size, overlap)
    return cut.withColumn("limit", F.when(F.col("piece") == 0, 0).otherwise(F.col("start") + overlap // 2))


def percentile(column: str, p: float):
    """Nearest-rank percentile as an aggregate; counts of distinct values are combined before the shuffle."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def fixed_windows(df: DataFrame, length: str, size: int, overlap: int = 0) -> DataFrame:
    """Rows (index, start, end) that cover 0..length in steps of size - overlap."""
    step = size - overlap
    last = F.greatest(F.ceil((F.col(length) - overlap) / step).cast("long") - 1, F.lit(0))
    df = df.where(F.col(length) > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return df.withColumn("start", F.col("piece") * step).withColumn("end", F.least(F.col("piece") * step + size, F.col(length)))
