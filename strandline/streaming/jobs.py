"""Structured Streaming jobs: windows over late events, admission by rate, ticks against segments, incremental merges.

Each function starts from a streaming DataFrame; sinks are tables in folders that driver and executors share.
drain() runs a query over what is there now and ends, which is also how the registered queries run them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.merge import last_writer


def source(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Files of a Parquet folder (or one file) as a stream, `files` of them in a micro-batch at most."""
    schema, path = spark.read.parquet(path).schema, path.rstrip("/")
    # as a pattern, because the file source takes other paths for folders
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, base: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs the stream over all that is there, giving each micro-batch to each(batch, number); its checkpoint lies in base."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def appended(stream: DataFrame, base: str) -> DataFrame:
    """The stream's rows as a table in base. A batch that is run again replaces what it wrote before."""
    drain(stream, base, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/rows/batch={n}"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows").select(*stream.columns)


def window_metrics(events: DataFrame, time: str, value: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and largest value of each key and window; events later than `late` behind the newest are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most")).select(F.col("w.start").alias("start"), key, "n", "mean", "most")


def in_order(events: DataFrame, key: str, time: str, tie: str, columns: list[str], late: str, step: Callable, expires: Callable, made: str) -> DataFrame:
    """(key, tie, made) of step(state, row) -> (state, values) over each key's rows in the order of their time (ms) and tie.

    Rows wait in the state of their key until the watermark, `late` behind the newest row, has passed them, so the
    result is that of a batch, however rows are spread over micro-batches; a row that comes later than that is
    dropped. A timer wakes a key when its next row is due, or when expires(state), a time in ms, has passed and the
    state goes. state is a list of numbers, None at first. Rows without a tie only move the watermark, see closing()."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = (json.loads(x) for x in state.get) if state.exists else (None, [])
        for frame in frames:
            waiting += json.loads(frame[frame[tie].notna()][[time, tie, *columns]].to_json(orient="values"))
        mark, out = state.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda r: r[:2])
        ready = [r for r in waiting if r[0] <= mark]
        waiting = waiting[len(ready) :]
        for r in ready:
            held, values = step(held, dict(zip((time, tie, *columns), r)))
            out.append((k[0], r[1], *values))
        due = waiting[0][0] if waiting else expires(held) if held is not None else None
        if due is None or not waiting and due <= mark:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held), json.dumps(waiting)))
            state.setTimeoutTimestamp(max(due, mark) + 1)
        yield pd.DataFrame(out, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, {made}"
    names = [x.split()[0] for x in schema.split(", ")]
    stamped = events.select(key, time, tie, *columns).withColumn("_ts", F.timestamp_millis(time)).withWatermark("_ts", late)
    return stamped.groupBy(key).applyInPandasWithState(run, schema, "held string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def closing(events: DataFrame, time: str, at: int) -> DataFrame:
    """One row for the folder that `events` are read from: nothing but a late time, at which all that waits is due."""
    return events.sparkSession.range(1).select(*[(F.lit(at) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])


def admitted(events: DataFrame, key: str, time: str, tie: str, span: int, limit: int, late: str = "3 hours") -> DataFrame:
    """(key, tie, allowed): events of a key let through while fewer than `limit` were within the last `span` ms.

    Decided in the order of time, see in_order(). The state of a key is the times of what it let through
    within the span, and goes `span` after the last of them."""

    def step(held, row):
        held = [h for h in held or [] if h > row[time] - span]
        ok = len(held) < limit
        return [*held, row[time]] if ok else held, (ok,)

    return in_order(events, key, time, tie, [], late, step, lambda held: (held[-1] if held else 0) + span, "allowed boolean")


def quarantined(events: DataFrame, key: str, time: str, tie: str, outcome: str, bad: str, shut: int = 600_000, late: str = "3 hours") -> DataFrame:
    """(key, tie, state): tries of a key, which is shut for `shut` ms after one that ended `bad`.

    While a key is shut its rows aren't tried (`shut`) and what they would have ended in doesn't count; other rows are
    `tried`, or `closing` if they shut the key. The first row at or after the end of that time is tried again."""

    def step(until, row):
        if until and until[0] > row[time]:
            return until, ("shut",)
        return ([row[time] + shut], ("closing",)) if row[outcome] == bad else (None, ("tried",))

    return in_order(events, key, time, tie, [outcome], late, step, lambda until: until[0], "state string")


def active_segments(ticks: DataFrame, segments: DataFrame, key: str, time: str, tie: str, width: int = 3_600_000) -> DataFrame:
    """(tie, id) of ticks with the segments(key, start, end, id) that hold them: a stream against a table.

    A tick meets the segments of its key and stretch of time, `width` long, only."""
    spread = segments.where("end > start").withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    return ticks.withColumn("_slot", F.floor(F.col(time) / width)).join(spread, [key, "_slot"]).where((F.col("start") <= F.col(time)) & (F.col(time) < F.col("end"))).select(tie, "id")


def _versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions that lie in a folder and were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("version=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def merged_table(changes: DataFrame, base: str, key: str, stamp: str, deleted: str) -> DataFrame:
    """The newest version of every key of a stream of changes, tombstones kept so that later old changes lose to them.

    Every micro-batch writes a new version of the table in base from the last one there, also after a
    restart; a batch that is run again starts from the version before it. Versions older than that go.
    """
    spark = changes.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        before = [v for v in _versions(spark, base) if v < n]
        old = spark.read.parquet(f"{base}/version={before[-1]}") if before else batch.limit(0)
        new = last_writer(batch.withColumn("_gone", F.lit(False)), old.select(*batch.columns).withColumn("_gone", F.lit(False)), key, stamp, "_gone")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{base}/version={n}")
        for v in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/version={v}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    drain(changes, base, each)
    last = _versions(spark, base)
    return spark.read.parquet(f"{base}/version={last[-1]}").where(~F.col(deleted)) if last else spark.createDataFrame([], changes.schema)
