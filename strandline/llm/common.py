"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.tables import table  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one below the warehouse only
    where it is unset and master is local (tests, bench)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/strandline-shared"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *order) -> DataFrame:
    """df in the order given with _row, each row's place in all of df (from 0), and _part, the range it lies in.

    Ranges hold about as many rows each, whatever the keys: equal rows are told apart by the place where they
    were read. Only the sizes of the ranges pass through the driver. df is cut by a checkpoint."""
    spark = df.sparkSession
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = df.repartitionByRange(partitions(spark), *order, "_tie").sortWithinPartitions(*order, "_tie")
    df = materialize(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    df = df.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    first, seen = [], 0
    for part, n in sorted(map(tuple, df.groupBy("_part").count().collect())):
        first.append((part, seen))
        seen += n
    starts = spark.createDataFrame(first, "_part int, _first long")
    return df.join(F.broadcast(starts), "_part").withColumn("_row", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_first")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list:
    """The column as Python strings, null as the empty string."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def carried(docs: DataFrame, names: list[str]) -> None:
    """An error if columns of docs that are to be carried have the names of new ones."""
    if clash := [c for c in docs.columns if c in names]:
        raise ValueError(f"columns {clash} of the input have the names of results")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest reachable node of every node in edges(u long, v long).

    Alternates large-star and small-star steps, written as partially aggregated minima and
    equi-joins, so a node with very many neighbours is never gathered into one task and a skewed
    join can be split by adaptive execution. Every round is cut by a checkpoint. Returns (node,
    component), nodes without edges are not in it. A graph that isn't settled after max_rounds is an error.
    """
    e = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    for _ in range(max_rounds):
        # a forest of stars: no node hangs on two others or on one that hangs itself
        hung = e.groupBy("u").agg(F.count("*").alias("n"))
        if not hung.where("n > 1").unionByName(hung.join(e.select(F.col("v").alias("u")), "u", "left_semi")).limit(1).count():
            break
        # large star: the larger neighbours of a node hang on its smallest neighbour or itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        e = materialize(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component")))
