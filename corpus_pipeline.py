"""Corpus pipeline: toxic documents go, documents of no clear language go, one of each group of
near-duplicates stays, and what is left is packed.

Every stage decides each row by itself (or each group by its rows), so rows without an id and rows that
repeat an id are judged by their own texts. Extra columns are kept by all stages but the last; their names
must not be those of predictions. Empty tables give empty tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, minhash, packing, toxicity
from strandline.llm.common import shared_path, table

#: Share of a document's letters that its main language must cover.
LANGUAGE_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, does not call toxic.

    Null and empty texts have no features and stay. Repeated rows share their fate."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, chain, carry=True).where("not toxic").select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language that covers LANGUAGE_SHARE of their letters.

    Null and empty texts and texts without a letter have no language and go. Repeated rows share their fate."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, carry=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (ties: digest of the text).

    Of rows that repeat id and text one stays; texts without words are in no group and stay."""
    return minhash.survivors(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    Null and empty texts are the end id alone; repeated rows are packed as often as they occur."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_language), ("near_dedup", drop_near_copies), ("packing", pack)]
#: Learned models and hashing can't be stated in SQL; a test compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again; what a stage has read is then removed."""
    base, docs, before = shared_path(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{base}/{name}"
    return docs
