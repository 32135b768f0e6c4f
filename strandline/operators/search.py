"""Retrieval and filters over texts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import count_in, fold, once, search_terms


def bm25(docs: DataFrame, question: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Top k rows of docs(doc_id, text) with a positive score; ties go to the smaller id.

    Terms are stems without stop words; documents without a term don't count. A document keeps its length
    and its occurrences of the question's terms only, so nothing is exploded or shuffled; one pass gives the
    corpus statistics (one row), a second one the scores.
    """
    terms = list(dict.fromkeys(docs.sparkSession.range(1).select(search_terms(F.lit(question))).first()[0]))
    tokens = once(docs.select("doc_id", "text"), "t", search_terms(F.col("text")))
    counted = tokens.select("doc_id", F.struct(F.size("t").alias("n"), F.filter("t", lambda w: w.isin(terms)).alias("h")).alias("c"))
    full = counted.where(F.col("c.n") > 0)
    stats = full.agg(F.count("*").alias("n"), F.avg("c.n").alias("mean"), *[F.count_if(F.array_contains("c.h", t)).alias(f"d{i}") for i, t in enumerate(terms)]).first()
    score, mean = F.lit(0.0), stats["mean"] or 1.0
    for i, t in enumerate(terms):
        idf, f = math.log(1 + (stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)), count_in(F.col("c.h"), t)
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("c.n") / mean))
    # the largest scores are positive if any is, so nothing is filtered before the top is taken
    top = counted.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return top.where("score > 0")


def term_stats(docs: DataFrame) -> DataFrame:
    """Documents and occurrences of every term, in one partially aggregated shuffle by term."""
    tokens = once(docs.select("text"), "t", search_terms(F.col("text")))
    one = lambda df, tf: lambda w: F.struct(w.alias("term"), F.lit(df).alias("df"), F.lit(tf).alias("tf"))
    rows = tokens.select(F.explode(F.concat(F.transform(F.array_distinct("t"), one(1, 0)), F.transform("t", one(0, 1)))).alias("r")).select("r.*")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def contains_all(df: DataFrame, columns: list[str], question: str) -> DataFrame:
    """Rows whose joined columns hold every word of the question as a substring, folded."""
    text = fold(F.concat_ws(" ", *columns))
    for w in question.lower().split():
        df = df.where(F.contains(text, fold(F.lit(w))))
    return df


def first_hit(segments: DataFrame, key: str, order: str, text: str, needle: str, width: int = 140) -> DataFrame:
    """The first segment of each key that holds the needle, with a snippet around it."""
    at = F.instr(F.lower(text), needle.lower())
    found = segments.where(at > 0).groupBy(key).agg(F.min(F.struct(F.col(order), F.col(text).alias("t"))).alias("m"))
    at = F.instr(F.lower("m.t"), needle.lower())
    return found.select(key, F.col(f"m.{order}").alias(order), F.expr("m.t").substr(F.greatest(at - 40, F.lit(1)), F.lit(width)).alias("snippet"))


def tag_counts(df: DataFrame, tag: str, order: str) -> DataFrame:
    """Counts by folded tag with its first spelling."""
    return df.where(F.col(tag).isNotNull()).groupBy(fold(F.col(tag)).alias("tag")).agg(F.count("*").alias("n"), F.min_by(tag, order).alias("label"))


def running_lines(lines: DataFrame, doc: str, page: str, place: str, line: str, share: float = 0.4, least: int = 3, most: int = 90) -> DataFrame:
    """First and last lines of pages, at most `most` long, that recur on max(least, ceil(share of pages)) pages of a document; digits dropped.

    lines(doc, page, place, line): blank ones don't count; documents with fewer than `least` pages have none.
    """
    some = lines.where(F.trim(F.coalesce(line, F.lit(""))) != "").groupBy(doc, page).agg(F.min_by(line, place).alias("first"), F.max_by(line, place).alias("last"))
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    edge = some.select(doc, page, F.explode(F.array("first", "last")).alias("line")).where(F.length("line") <= most)
    key = F.trim(F.regexp_replace(F.regexp_replace(fold(F.col("line")), r"[0-9]+", ""), r"\s+", " "))
    seen = edge.select(doc, page, key.alias("line")).where("line <> ''").groupBy(doc, "line").agg(F.countDistinct(page).alias("n"))
    return seen.join(pages, doc).where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select(doc, "line", "n", "pages")
