"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are rotated to their principal dimensions. Within a label they are put into epsilon grid
order: sorted by the grid cells (edge epsilon) of the leading dimensions. Intervals of the order are
joined recursively, parent pairs to child pairs, and a pair of intervals whose bounding boxes in the
leading dimensions are farther apart than epsilon is skipped. Pairs of leaf intervals go to a kernel
that halves them further in the same way and compares what is left exactly in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import connected_components, materialize, partitions

LEAD = 6
LEAF = 2048
FANOUT = 8
#: Vectors that the rotation is fitted on, at most (about). It only steers the order, never a link.
SAMPLE = 20_000


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def valid(col: str) -> str:
    fine = f"forall({col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return f"{col} is not null and size({col}) > 0 and {fine} and exists({col}, x -> x <> 0)"


def rotation(vectors: DataFrame) -> np.ndarray | None:
    n = vectors.count()
    if not n:
        return None
    some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(min(1, SAMPLE / n) * 1_000_000) + 1)
    rows = [r[0] for r in some.select("embedding").collect()]
    if not rows:
        return None
    width = max(map(len, rows))
    x = _unit([r for r in rows if len(r) == width])
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(width, width))
    return axes[:, ::-1][:, :LEAD]


def grid(vectors: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """vectors with `lead` (leading coordinates) and `cell` (their grid cells); ones of another width than the axes keep their own first coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, cell = [], []
            for v in b.column("embedding").to_pylist():
                x = _unit([v])[0]
                y = x @ axes if len(x) == len(axes) else np.pad(x[: axes.shape[1]], (0, max(0, axes.shape[1] - len(x))))
                lead.append(y)
                cell.append(np.floor(y / eps).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lead, pa.list_(pa.float64())), pa.array(cell, pa.list_(pa.int32()))], [*b.schema.names, "lead", "cell"]
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(run, f"rep long, label string, copies long, embedding {kind}, width int, lead array<double>, cell array<int>")


def join_blocks(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, cosine: float, eps: float, same: bool, out) -> None:
    """Recursive part in a kernel: calls out(i, j) with index arrays of linked rows."""

    def go(i0, i1, j0, j1):
        if same and j1 <= i0:
            return
        gap = np.maximum(0, np.maximum(la[i0:i1].min(0) - lb[j0:j1].max(0), lb[j0:j1].min(0) - la[i0:i1].max(0)))
        if (gap * gap).sum() > (eps + 1e-9) ** 2:
            return
        if i1 - i0 <= 128 and j1 - j0 <= 128:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= cosine - 1e-9)
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            exact = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
            if exact.any():
                out(i[exact], j[exact])
            return
        i = (i0 + i1) // 2 if i1 - i0 > 128 else i1
        j = (j0 + j1) // 2 if j1 - j0 > 128 else j1
        for p, q in ((i0, i), (i, i1)):
            for r, s in ((j0, j), (j, j1)):
                if p < q and r < s:
                    go(p, q, r, s)

    go(0, len(a), 0, len(b))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indexes over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def label_key(table: DataFrame) -> Column:
    """Labels of any type as text that is equal where they are; the two zeros of a floating type are one."""
    kind, c = table.schema["label"].dataType, F.col("label")
    if isinstance(kind, T.FractionalType):
        return F.when(c == 0, F.lit("0")).otherwise(c.cast("string"))
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return c.cast("string") if isinstance(kind, T.AtomicType) else F.when(c.isNotNull(), F.to_json(F.struct(c)))


def near_vectors(table: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings(vec_id, embedding, label).

    Vectors are compared if labels (of any type) are equal and not null. Null or zero vectors, ones with null or
    non-finite components, and ones of different length link with nothing. Equal vectors of a label
    are one class with a multiplicity and link to each other. Each row is a vector of its own: rows that
    repeat a vec_id link only if their vectors do, and rows without one take part with kept = false.
    component_id is the smallest vec_id of a component, null where none has one. An empty table gives no
    rows; other columns are ignored.
    """
    spark, eps = table.sparkSession, float(np.sqrt(2 - 2 * cosine))
    parts = partitions(spark)
    # floats travel as floats; all arithmetic is in double precision
    kind = "array<float>" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), label_key(table).alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.withColumn("ok", F.coalesce(F.expr(f"label is not null and {valid('embedding')}"), F.lit(False)))
    good = rows.where("ok").drop("ok")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    axes = rotation(good)
    if axes is None:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    base = classes.select("rep", "label", "copies", "embedding", F.size("embedding").alias("width"))
    ordered = materialize(grid(base, axes, eps))
    # intervals of the order: ranks within a label are found from counts of the cells' sort keys
    ordered = ordered.withColumn("ord", F.struct("label", "width", "cell", "rep"))
    dealt = ordered.repartitionByRange(max(1, parts), "label", "width", "cell", "rep").sortWithinPartitions("label", "width", "cell", "rep")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).drop("ord"))
    within = Window.partitionBy("part", "label", "width").orderBy("cell", "rep")
    leaf = dealt.withColumn("slot", F.floor((F.row_number().over(within) - 1) / LEAF).cast("long"))
    leaf = leaf.withColumn("block", F.col("part").cast("long") * F.lit(1 << 32) + F.col("slot"))
    leaf = materialize(leaf.drop("slot", "part", "cell"))
    low = F.array(*[F.min(F.col("lead")[k]) for k in range(axes.shape[1])])
    high = F.array(*[F.max(F.col("lead")[k]) for k in range(axes.shape[1])])
    level = leaf.groupBy("label", "width", "block").agg(low.alias("low"), high.alias("high"))
    number = Window.partitionBy("label", "width").orderBy("block")
    levels = [materialize(level.withColumn("node", F.row_number().over(number).cast("long") - 1))]
    while levels[-1].groupBy("label", "width").count().where("count > 1").limit(1).count():
        k = axes.shape[1]
        up = levels[-1].groupBy("label", "width", F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.array(*[F.min(F.col("low")[x]) for x in range(k)]).alias("low"), F.array(*[F.max(F.col("high")[x]) for x in range(k)]).alias("high")
        )
        levels.append(materialize(up))
    far = "aggregate(zip_with(zip_with(a.low, b.high, (x, y) -> x - y), zip_with(b.low, a.high, (x, y) -> x - y), (x, y) -> pow(greatest(0D, x, y), 2)), 0D, (s, x) -> s + x)"
    pairs = levels[-1].select("label", "width", F.col("node").alias("p"), F.col("node").alias("q"))
    for child in reversed(levels[:-1]):
        up = F.floor(F.col("node") / FANOUT)
        a = child.select("label", "width", up.alias("p"), F.struct("node", "low", "high").alias("a"))
        b = child.select("label", "width", up.alias("q"), F.struct("node", "low", "high").alias("b"))
        joined = pairs.join(a, ["label", "width", "p"]).join(b, ["label", "width", "q"])
        joined = joined.where("a.node <= b.node").where(F.expr(far) <= (eps + 1e-9) ** 2)
        pairs = materialize(joined.select("label", "width", F.col("a.node").alias("p"), F.col("b.node").alias("q")))
    name = levels[0].select("label", "width", "node", "block")
    pairs = pairs.join(name.select("label", "width", F.col("node").alias("p"), F.col("block").alias("pa")), ["label", "width", "p"])
    pairs = pairs.join(name.select("label", "width", F.col("node").alias("q"), F.col("block").alias("pb")), ["label", "width", "q"])
    pairs = materialize(pairs.select("label", "width", "pa", "pb"))
    packed = leaf.groupBy("label", "width", "block").agg(F.sort_array(F.collect_list(F.struct("lead", "rep", "copies", "embedding"))).alias("v"))
    packed = materialize(packed)
    left = pairs.join(packed.select("label", "width", F.col("block").alias("pa"), F.col("v").alias("va")), ["label", "width", "pa"])
    both = left.join(packed.select("label", "width", F.col("block").alias("pb"), F.col("v").alias("vb")), ["label", "width", "pb"])

    def table_of(v):
        f = v.flatten() if isinstance(v, pa.ListScalar) else v
        emb, lead = f.field("embedding"), f.field("lead")
        x = np.asarray(emb.flatten(), dtype=np.float64).reshape(len(emb), -1)
        return x / np.sqrt((x * x).sum(axis=1))[:, None], np.asarray(lead.flatten()).reshape(len(lead), -1), np.asarray(f.field("rep")), np.asarray(f.field("copies"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                same = b.column("pa")[k].as_py() == b.column("pb")[k].as_py()
                xa, la, ra, ca = table_of(b.column("va")[k].values)
                xb, lb, rb, cb = (xa, la, ra, ca) if same else table_of(b.column("vb")[k].values)
                found: list = []
                join_blocks(xa, xb, la, lb, cosine, eps, same, lambda i, j: found.append((i, j)))
                if not found:
                    continue
                i, j = (np.concatenate(x) for x in zip(*found))
                ids = ra if same else np.concatenate([ra, rb])
                j2 = j if same else j + len(ra)
                copies = ca if same else np.concatenate([ca, cb])
                n = np.bincount(i, weights=copies[j2], minlength=len(ids)) + np.bincount(j2, weights=copies[i], minlength=len(ids))
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                root = _roots(len(ids), place[i], place[j2])
                hit = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(n[hit].astype(np.int64)), pa.array(ids[order][root[place[hit]]])], ["rep", "n", "root"]
                )

    found = materialize(both.select("pa", "pb", "va", "vb").mapInArrow(link, "rep long, n long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    info = classes.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("label", "embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    info = materialize(info)
    info = info.join(info.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    some = good.join(info, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return some.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
