"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is the first 60 bits of md5(key). The directory starts at depth 0; a bucket over the
byte limit splits on the next bit until each fits. Instead of one pass for each bit, a round sums
bytes by prefix over a span of bits, which gives every bucket of these depths at once, and only the
prefixes that are still too large enter the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize

BITS = 60
#: Bits that one round looks at.
SPAN = 10


def hash_bits(key) -> F.Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def prefix(h, depth) -> F.Column:
    return F.expr(f"shiftright({h}, {BITS} - {depth})")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard_depth, shard_prefix, shard_bytes, oversized) of every row.

    Null keys hash as the empty string, null texts have no bytes. Repeated keys stay together; a
    shard whose rows share all hash bits, or one row above the limit, can't be split further: it ends at
    the depth where nothing but that hash is left (60) and is flagged as oversized. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        hash_bits(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_h"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    rows = materialize(rows)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, low, live = [], 0, None
    if total <= limit:
        return rows.select(
            "doc_id", "n_bytes", F.lit(0).alias("shard_depth"), F.lit(0).cast("long").alias("shard_prefix"),
            F.lit(total).cast("long").alias("shard_bytes"), F.lit(False).alias("oversized"),
        )
    active = rows.select("_h", "n_bytes")
    while low < BITS:
        high = min(low + SPAN, BITS)
        cells = active.groupBy(prefix("_h", high).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        nodes = (
            cells.select("n_bytes", "cell", F.explode(F.sequence(F.lit(low + 1), F.lit(high))).alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
            .agg(F.sum("n_bytes").alias("bytes"))
        )
        nodes = materialize(nodes)
        big = nodes.where(F.col("bytes") > limit)
        parent = big.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        small = nodes.where(F.col("bytes") <= limit).withColumn("up", F.expr("shiftright(prefix, 1)"))
        first = small.where(F.col("depth") == low + 1)
        leaves = first.select("depth", "prefix", "bytes").unionByName(
            small.where(F.col("depth") > low + 1).join(parent, ["depth", "up"], "left_semi").select("depth", "prefix", "bytes")
        )
        last = big.where(F.col("depth") == high)
        done.append(leaves.withColumn("oversized", F.lit(False)))
        if high == BITS:
            done.append(last.select("depth", "prefix", "bytes").withColumn("oversized", F.lit(True)))
            break
        if last.limit(1).count() == 0:
            break
        live = last.select(F.col("prefix").alias("p"))
        active = active.withColumn("p", prefix("_h", high)).join(live, "p", "left_semi").select("_h", "n_bytes")
        active, low = materialize(active), high
    directory = done[0]
    for d in done[1:]:
        directory = directory.unionByName(d)
    # a row meets its leaf: every depth that has leaves is one possible prefix of the row
    depths = [r[0] for r in directory.select("depth").distinct().collect()]
    tries = rows.select("*", F.explode(F.array(*[F.lit(d) for d in sorted(depths)])).alias("depth"))
    tries = tries.withColumn("prefix", F.expr(f"shiftright(_h, {BITS} - depth)"))
    return tries.join(directory, ["depth", "prefix"]).select(
        "doc_id", "n_bytes", F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"),
        F.col("bytes").alias("shard_bytes"), "oversized",
    )
