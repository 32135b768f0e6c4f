"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows cost much more to work on than to move.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Texts in a single file are dealt to all cores, because one row group is one task."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in TEXTS and len(df.inputFiles()) == 1:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
