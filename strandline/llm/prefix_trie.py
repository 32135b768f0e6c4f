"""Prefix trie of conversations with sums over subtrees, by heavy-path decomposition.

A prefix of turns is named by 128 bits: the exclusive or of hashes of (depth, turn), so that a running
aggregate names all prefixes of a conversation, in slices if it is long, and a node's own hash taken away names
its parent. Two different prefixes share a name with probability 2**-128.

A node's heavy child is the one with most members (ties: smallest conv_id), so a light child has at most half of
its parent's members and a conversation meets at most log2(conversations) light nodes. Heavy edges make paths. A
path's nodes are arrays in the order of depth (of SLICE nodes at most, sums carried from slice to slice), which
are suffix-summed; then the path's sum is added to the parent of its head. Paths are done by the number of light
nodes above them, deepest first: a logarithmic number of rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, numbered, partitions, shared_path

#: Conversations share the turns of the first of FAMILY ids; at most SHARED - 1 of them.
FAMILY, SHARED = 5, 9
#: Nodes of a path in one array.
SLICE = 4096
#: Bits of conv_id whose ids are joined to one string before hashing.
CHUNK_BITS = 10
KEY = ["depth", "a", "b"]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their lengths, turns with depth and hashes) as rebuilt from shared first turns.

    convs: conv_id, h, length. turns: conv_id, slice, depth (from 1), x and y (hashes of role and text), bytes, length."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    turns = numbered(turns, "conv_id", F.asc_nulls_first("turn"), "role", "text")
    turns = turns.select("conv_id", "_part", "_row", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"), F.octet_length("text").cast("long").alias("bytes"))
    convs = turns.groupBy("conv_id").agg(F.min("_row").alias("start"), F.count("*").alias("n"))
    convs = convs.withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED)
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.drop("n_base"))
    placed = turns.join(convs, "conv_id").withColumn("place", F.col("_row") - F.col("start"))
    own = placed.where("place >= h").select("conv_id", (F.col("_part") + 1).alias("slice"), (F.col("head") + F.col("place") - F.col("h") + 1).alias("depth"), "x", "y", "bytes", "length")
    heads = placed.where(F.col("place") < SHARED - 1).select(F.col("conv_id").alias("base"), "place", "x", "y", "bytes")
    shared = heads.join(convs.select("base", "conv_id", "h", "length"), "base").where("place < h")
    return convs, own.unionByName(shared.select("conv_id", F.lit(0).alias("slice"), (F.col("place") + 1).alias("depth"), "x", "y", "bytes", "length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth: a and b name the prefix, pa and pb the one before."""
    turns = turns.withColumn("u", F.xxhash64("depth", "x", "y")).withColumn("v", F.xxhash64("y", "depth", "x")).drop("x", "y")
    turns = turns.repartition(partitions(turns.sparkSession), "conv_id", "slice")
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = turns.groupBy("conv_id", "slice").agg(*[F.bit_xor(c).alias(c) for c in "uv"]).select("conv_id", "slice", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"c{c}") for c in "uv"])
    within = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.join(carried, ["conv_id", "slice"])
    rows = rows.withColumns({"a": F.col("cu").bitwiseXOR(F.bit_xor("u").over(within)), "b": F.col("cv").bitwiseXOR(F.bit_xor("v").over(within))})
    return rows.select("conv_id", *KEY, F.col("a").bitwiseXOR(F.col("u")).alias("pa"), F.col("b").bitwiseXOR(F.col("v")).alias("pb"), "bytes", (F.col("depth") == F.col("length")).alias("last"))


def id_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted ids of every node at which conversations end.

    Ids are joined in groups of at most 2**CHUNK_BITS, which are then hashed one after the other as a stream."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))
    dealt = chunks.repartition(partitions(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if node == key:
                    at.update(b"," + ids.encode())
                    continue
                if key:
                    for col, v in zip(out, (*key, at.hexdigest())):
                        col.append(v)
                key, at = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], [*KEY, "ends"])
        if key:
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([at.hexdigest()])], [*KEY, "ends"])

    return dealt.select(*KEY, "ids").mapInArrow(run, "depth long, a long, b long, ends string")


def linked(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with their members, parents, children and hashes of ends, and whether they are light."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("pa", "pb", "bytes")])
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("pa", "pb", "bytes")]).unionByName(root)
    nodes = materialize(nodes)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    kids = kids.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("c"))).alias("best"))
    turnless = convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id")
    ends = id_hashes(rows.where("last").select(*KEY, "conv_id").unionByName(turnless))
    full = nodes.join(kids, KEY, "left").join(ends, KEY, "left")
    above = nodes.join(kids, KEY).select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), (-F.col("best.c")).alias("heavy"))
    full = full.join(above, ["depth", "pa", "pb"], "left")
    return full.select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "ends", (F.col("depth") > 0).__and__(F.col("conv_id") != F.col("heavy")).alias("light"))


FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends", "leaves", "saved"]
PATH = ["head_depth", "head_conv"]


def suffix_sums(arrays: DataFrame) -> DataFrame:
    """Nodes of the path arrays with leaves and saved summed from each to the end of its array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path = b.column("path")
            n, at = path.value_lengths().to_numpy(zero_copy_only=False), path.flatten()
            ends = np.cumsum(n)
            columns = dict(zip(at.type.names, at.flatten())) if hasattr(at.type, "names") else {at.type.field(i).name: c for i, c in enumerate(at.flatten())}
            for c in ("leaves", "saved"):
                total = np.append(np.cumsum(columns[c].to_numpy(zero_copy_only=False)[::-1])[::-1], 0)
                columns[c] = pa.array(total[:-1] - np.repeat(total[ends], n))
            keys = [pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), n)) for c in (*PATH, "slice")]
            yield pa.RecordBatch.from_arrays([*keys, *(columns[c] for c in FIELDS)], [*PATH, "slice", *FIELDS])

    kinds = ", ".join(f"{c} {'string' if c == 'ends' else 'long'}" for c in (*PATH, "slice", *FIELDS))
    return arrays.mapInArrow(run, kinds)


def climb(level: DataFrame, added: DataFrame | None) -> DataFrame:
    """The nodes of one level's paths with the sums over their subtrees; added: sums of light children by node."""
    if added is not None:
        level = level.join(added, ["conv_id", "depth"], "left")
        level = level.withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
    level = level.withColumn("slice", F.expr(f"(depth - head_depth) div {SLICE}"))
    arrays = level.groupBy(*PATH, "slice").agg(F.array_sort(F.collect_list(F.struct("depth", *[c for c in FIELDS if c != "depth"]))).alias("path"))
    nodes = materialize(suffix_sums(arrays))
    later = Window.partitionBy(*PATH).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    tops = nodes.where(F.col("depth") == F.col("head_depth") + F.col("slice") * SLICE)
    behind = tops.select(*PATH, "slice", *[F.sum(c).over(later).alias(f"more_{c}") for c in ("leaves", "saved")]).where("more_leaves is not null")
    nodes = nodes.join(behind, [*PATH, "slice"], "left")
    return nodes.select(*PATH, *[c if c not in ("leaves", "saved") else (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in FIELDS])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations(conv_id, turn, role, text), the root included.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Turns are ordered by turn, null first, equal ones by role and text; repeated
    rows are turns of their own. Null roles and texts are empty. Rows without conv_id belong to no conversation.
    Other columns are ignored. An empty table gives no rows."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations)
    rows = materialize(prefixes(turns))
    nodes = materialize(linked(convs, rows))
    # the light nodes above a conversation's turns, at most log2(conversations)
    lights = rows.select("conv_id", *KEY).join(nodes.where("light").select(*KEY, F.col("conv_id").alias("head")), KEY)
    lights = lights.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "head"))).alias("lights"))
    above = F.filter(F.coalesce("lights", F.array().cast("array<struct<depth:bigint,head:bigint>>")), lambda x: x["depth"] <= F.col("depth"))
    nodes = nodes.join(lights, "conv_id", "left").withColumn("above", above).withColumn("top", F.try_element_at("above", F.lit(-1)))
    nodes = nodes.select(
        F.size("above").alias("level"), F.coalesce("top.depth", F.lit(0)).cast("long").alias("head_depth"), F.coalesce("top.head", F.lit(0)).cast("long").alias("head_conv"),
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved",
    )
    base = shared_path(spark, "prefix-trie")
    nodes.write.partitionBy("level").parquet(f"{base}/nodes")
    nodes = spark.read.schema(nodes.schema).parquet(f"{base}/nodes")  # an empty table has no files
    top, added, done = nodes.agg(F.max("level")).first()[0], None, []
    for k in range(-1 if top is None else top, -1, -1):
        path = f"{base}/level-{k}"
        climb(nodes.where(F.col("level") == k).drop("level"), added).write.parquet(path)
        done.append(path)
        heads = spark.read.parquet(path).where("depth = head_depth and depth > 0")
        added = heads.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    if not done:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return spark.read.parquet(*done).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
