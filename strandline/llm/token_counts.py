"""Token counts through a digest cache.

Text is normalised (null is the empty string) and digested; the tokenizer version is the digest of
its file. Counts are looked up by (content digest, tokenizer digest); only distinct misses are
encoded and they are appended to the cache table, from which all counts are then read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import remove
from strandline.llm.packing import encoder

CACHE = "content string, n_tokens long, version string"
_PIECES: dict[str, object] = {}


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    if path.endswith(".json"):
        encode = encoder(path)
        return lambda texts: [len(encode(x)) for x in texts]
    if path not in _PIECES:
        import sentencepiece

        _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in _PIECES[path].encode(texts, num_threads=1)]


def count_distinct(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            t = b.column("text").to_pylist()
            n = [k for at in range(0, len(t), 64) for k in count(t[at : at + 64])]
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def compact(spark: SparkSession, cache: str, path: str) -> None:
    """Rewrites a tokenizer's part of the cache with one row a content, in place of the files of many runs.

    The new files are written beside the old ones before these go; a reader in between meets counts twice, which are equal."""
    version, folder = version_of(path), f"{cache}/version={version_of(path)}"
    old = spark.read.schema("content string, n_tokens long").parquet(folder)
    files = old.inputFiles()
    old.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    for f in files:
        remove(spark, f)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, cache: str | None = None, batches: int = 1) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents(doc_id, text).

    Null text counts as empty. Repeated rows and equal texts give equal counts and are encoded once.
    cache: path of a Parquet table (content, n_tokens) by version on a store that all executors see; a
    version's part is read if present, and the counts of missing contents are appended to it. batches: rows are
    taken in so many lots, by a hash of their ids, each of which looks up what the earlier ones have stored.
    """
    spark, version = docs.sparkSession, version_of(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("content")
    )
    if cache:
        stored = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
        for k in range(batches):
            lot = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k)
            misses = lot.groupBy("content").agg(F.first("text").alias("text"))
            if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
                misses = misses.join(stored().select("content").distinct(), "content", "left_anti")
            fresh = count_distinct(misses, path).select("content", "n_tokens", F.lit(version).alias("version"))
            fresh.write.mode("append").partitionBy("version").parquet(cache)
        # two runs at once may both append a text: their counts are equal
        counts = stored().groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    else:
        counts = count_distinct(rows.groupBy("content").agg(F.first("text").alias("text")), path)
    sizes = rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
