"""Merging, deduplication and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import slices


def verdicts(local: DataFrame, remote: DataFrame, key: str, stamp: str) -> DataFrame:
    """upload, download or same for each key of either side; the later stamp wins."""
    a, b = local.select(key, F.col(stamp).alias("local_stamp")), remote.select(key, F.col(stamp).alias("remote_stamp"))
    x, y = F.col("local_stamp"), F.col("remote_stamp")
    verdict = F.when(y.isNull() | (x > y), "upload").when(x.isNull() | (y > x), "download").otherwise("same")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def last_writer(local: DataFrame, remote: DataFrame, key: str, stamp: str, deleted: str) -> DataFrame:
    """Newest version of each key, local first on a tie, without deleted ones; one aggregation, no sort of a key's rows."""
    both = local.withColumn("_local", F.lit(1)).unionByName(remote.withColumn("_local", F.lit(0)))
    rest = [c for c in local.columns if c not in (key, stamp)]
    newest = both.groupBy(key).agg(F.max(F.struct(stamp, "_local", *rest)).alias("m")).where(~F.coalesce(F.col(f"m.{deleted}"), F.lit(False)))
    return newest.select(key, f"m.{stamp}", *[f"m.{c}" for c in rest if c != deleted])


def duplicate_groups(df: DataFrame, identity, key: str) -> DataFrame:
    """Groups of more than one row of equal identity with the newest (largest) key."""
    got = df.groupBy(identity.alias("identity")).agg(F.count("*").alias("n"), F.max(key).alias("canonical"))
    return got.where((F.col("n") > 1) & F.col("identity").isNotNull())


def evict(df: DataFrame, group: str, order: str, size: str, budget: int, keep: float = 0.9) -> DataFrame:
    """Oldest rows to drop so that each group over its budget fits `keep` of it."""
    total = df.groupBy(F.col(group).alias("_g")).agg(F.sum(size).alias("total")).where(F.col("total") > budget)
    df = slices.running_sum(slices.cut(df, order), [group], [F.desc(order)], size, "held", down=True)
    return df.join(total, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("held") > budget * keep).select(group, order, size)


def missing_items(source: DataFrame, target: DataFrame) -> DataFrame:
    """Multiset difference."""
    return source.exceptAll(target)


def accounting(fragments: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Each fragment with the number of uses, and used keys that are no fragment."""
    n = used.groupBy(key).agg(F.count("*").alias("uses"))
    f = fragments.select(key).distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("uses").isNull(), "unused").when(F.col("uses") > 1, "repeated").otherwise("once")
    return f.join(n, key, "full").select(key, state.alias("state"))
