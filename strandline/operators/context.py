"""Work on a document's parts: context for questions, neighbours, composition, vocabulary, fallible translations, codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.library import short_code
from strandline.functions.text import squeeze
from strandline.operators.chunks import blocks, pieces, tiling
from strandline.operators.search import bm25
from strandline.operators.sequences import scan


def answer_context(docs: DataFrame, key: str, text: str, question: str, size: int = 2000, k: int = 6, most: int = 12_000) -> DataFrame:
    """(key, piece, context) of the k blocks of all texts that answer a question best, in reading order, while they fit `most` characters."""
    cut = pieces(docs, key, text, blocks(size))
    top = bm25(cut.select(F.struct(F.col(key).alias("key"), "piece").alias("doc_id"), "text"), question, k).select(F.col("doc_id.key").alias(key), F.col("doc_id.piece").alias("piece"))
    found = cut.join(top, [key, "piece"]).select(key, "piece", "text")
    # k rows at most, so one window over them is bounded
    run = F.sum(F.length("text")).over(Window.orderBy(key, "piece").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("_run", run).where(F.col("_run") <= most).select(key, "piece", F.col("text").alias("context"))


def with_neighbours(parts: DataFrame, key: str, place: str, text: str, reach: int = 400) -> DataFrame:
    """parts with the last characters of the part before and the first ones of the part behind."""
    w = Window.partitionBy(key).orderBy(place)
    return parts.withColumn("before", F.right(F.coalesce(F.lag(text).over(w), F.lit("")), F.lit(reach))).withColumn("behind", F.left(F.coalesce(F.lead(text).over(w), F.lit("")), F.lit(reach)))


def compose(parts: DataFrame, key: str) -> DataFrame:
    """(key, text) of parts(key, place, start, end, text): joined as they are if they tile their whole, else with blank lines. A book is one row."""
    n = parts.groupBy(key).agg(F.max("end").alias("n"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    whole = tiling(parts, n, key, "n")
    texts = F.transform("p", lambda x: x["text"])
    return n.join(whole, key).select(key, F.when(F.col("tiles"), F.array_join(texts, "")).otherwise(F.array_join(F.transform(texts, lambda t: F.trim(t)), "\n\n")).alias("text"))


def vocabulary(pieces_: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form) of the distinct folded words of three letters or more within pieces, those at a piece's ends left out."""
    inner = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[^\s]*\s?", ""), r"\s?[^\s]*$", "")
    forms = F.regexp_extract_all(F.lower(inner), F.lit(r"\p{L}{3,}"), F.lit(0))
    return pieces_.select(key, F.explode(forms).alias("form")).distinct()


def join_transcripts(heard: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Phrases of overlapping chunks as one transcript: heard(key, chunk, start, end, text), chunks(key, chunk, offset, limit).

    A phrase counts in the chunk that owns its start; one that begins before the last one kept has ended
    (less a quarter of a second) was heard twice.
    """
    w = Window.partitionBy(key).orderBy("chunk")
    owned = chunks.withColumn("until", F.lead("limit").over(w))
    rows = heard.where(squeeze(F.coalesce("text", F.lit(""))) != "").join(owned, [key, "chunk"])
    rows = rows.withColumn("start", F.col("offset") + F.col("start")).withColumn("end", F.greatest(F.col("offset") + F.coalesce("end", F.lit(0.0)), F.col("start") + 0.01))
    rows = rows.where("start >= limit and (until is null or start < until)").select(key, "chunk", "start", "end", "text")

    def step(last, r):
        ok = r["chunk"] == 0 or r["start"] >= last - 0.25
        return (max(last, r["end"]) if ok else last), (ok,)

    kept = scan(rows, key, ["chunk", "start", "end", "text"], lambda: float("-inf"), step, "_ok boolean").where("_ok")
    return kept.select(key, F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def front_coded(words: Column) -> Column:
    """A sorted array of words, each as the length that it shares with the one before and its rest: '3abc'."""
    shared = lambda a, b: F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), lambda n: F.left(a, n) == F.left(b, n)))
    zero = lambda a, b: F.when(F.least(F.length(a), F.length(b)) > 0, shared(a, b)).otherwise(0)
    before = lambda i: F.coalesce(F.get(words, i - 1), F.lit(""))
    return F.transform(words, lambda w, i: F.concat(zero(before(i), w).cast("string"), F.lit(":"), w.substr(zero(before(i), w) + 1, F.length(w))))


def front_decoded(coded: Column) -> Column:
    """The words of front_coded."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(a: Column, c: Column) -> Column:
        w = F.concat(F.left(a["last"], F.split_part(c, F.lit(":"), F.lit(1)).cast("int")), F.split_part(c, F.lit(":"), F.lit(2)))
        return F.struct(F.array_append(a["out"], w).alias("out"), w.alias("last"))

    return F.aggregate(coded, start, step, lambda a: a["out"])


def manifest(lines: DataFrame, line: str, languages: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(samples, faults) of JSON lines: samples with id, audio, language and transcript; faults by reason, too few of a language among them."""
    doc = F.from_json(line, "id string, audio string, language string, transcript string, translation string, context string")
    rows = lines.where(~F.trim(line).startswith("#") & (F.trim(line) != "")).select(doc.alias("d"))
    empty = lambda c: F.trim(F.coalesce(f"d.{c}", F.lit(""))) == ""
    code = short_code(F.col("d.language"))
    fault = F.when(F.col("d").isNull() | (empty("id") & empty("audio") & empty("language") & empty("transcript")), "no_json")
    for c in ("id", "audio", "language", "transcript"):
        fault = fault.when(empty(c), f"no_{c}")
    rows = rows.withColumn("fault", fault.when(~code.isin(languages), "language"))
    good = rows.where("fault is null").select("d.id", "d.audio", code.alias("language"), "d.transcript", "d.translation", "d.context")
    few = good.groupBy("language").count().where(F.col("count") < least).select(F.concat(F.lit("few_"), "language").alias("fault"), "count")
    return good, rows.where("fault is not null").groupBy("fault").count().unionByName(few)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys; of several new ones the largest."""
    rest = [c for c in old.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("m")).select(*keys, "m.*")
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one)


def export_copy(docs: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, copy) with a document and its parts, in order, as JSON."""
    p = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in parts.columns if c != key]))).alias("parts"))
    return docs.join(p, key, "left").select(key, F.to_json(F.struct(*docs.columns, "parts")).alias("copy"))


def import_copy(copies: DataFrame, docs: DataFrame, key: str, schema: str, stamp: str) -> DataFrame:
    """The documents of JSON copies that read as `schema` and are newer than the stored one."""
    got = copies.select(F.from_json("copy", schema).alias("d")).where(F.col(f"d.{key}").isNotNull()).select("d.*")
    there = docs.select(key, F.col(stamp).alias("_there"))
    return got.join(there, key, "left").where(F.col("_there").isNull() | (F.col(stamp) > F.col("_there"))).drop("_there")


#: Marks of a text that is left in English or in Spanish.
LEFT = {
    "es": (["the", "and", "you", "that", "with", "this", "for", "are", "have", "from", "your", "about", "just", "like"], ["el", "la", "de", "que", "y", "en", "los", "las", "un", "una", "es", "por", "con", "para", "del", "se"]),
    "en": (["el", "la", "de", "que", "los", "las", "una", "del", "para"], ["the", "and", "you", "that", "with", "this", "for", "are"]),
}


def incomplete(a: Column, b: Column, target: str) -> Column:
    """Whether a translation into `target` is empty or its source, keeps 45 % of twelve or more long words, speaks the other language, or lost more than half of a long text."""
    o, t = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    long = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-záéíóúñ]{4,}"), F.lit(0)))
    kept = (F.size(long(o)) >= 12) & (F.size(F.array_intersect(long(o), long(t))) >= 0.45 * F.size(long(o)))
    padded = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    count = lambda ws: sum((F.contains(padded, F.lit(f" {w} ")).cast("int") for w in ws), F.lit(0))
    other, own = (count(ws) for ws in LEFT[target])
    return (t == "") | ((o != "") & ((o == t) | kept | ((other >= 4) & (other >= own)) | ((F.length(o) > 400) & (F.length(t) < F.length(o) * 0.45))))


def source_language(wanted: Column, declared: Column, meta: Column, title: Column, title_sure: Column, available: Column) -> Column:
    """struct(lang, source, confidence) by the first of: what a user chose, declared audio, metadata, title, available tracks."""
    codes = F.filter(F.transform(F.coalesce(available, F.array().cast("array<string>")), short_code), lambda c: c != "")
    several = F.size(F.array_distinct(codes)) > 1
    said = lambda lang, source, sure: F.struct(lang.alias("lang"), F.lit(source).alias("source"), F.lit(sure).cast("double").alias("confidence") if not isinstance(sure, Column) else sure.alias("confidence"))
    sure = F.when((title == "es") & several, F.least(title_sure, F.lit(0.45))).otherwise(title_sure)
    first = F.get(codes, F.lit(0))
    return (
        F.when((short_code(wanted) != "") & (short_code(wanted) != "auto"), said(short_code(wanted), "user", 1.0))
        .when(short_code(declared) != "", said(short_code(declared), "youtube", 0.97)).when(short_code(meta) != "", said(short_code(meta), "metadata", 0.75))
        .when(F.coalesce(title, F.lit("")) != "", said(title, "title", sure.cast("double"))).when((F.size(codes) > 0) & ~several, said(first, "available", 0.8))
        .when(F.array_contains(codes, "en"), said(F.lit("en"), "available", 0.55)).when(F.size(codes) > 0, said(first, "available", 0.4)).otherwise(said(F.lit(""), "unknown", 0.0))
    )


def circuit(calls: DataFrame, key: str, order: list[str], failures: int = 3) -> DataFrame:
    """calls(key, ok) with the run of failures up to each call and whether the circuit is open behind it."""

    def step(run, r):
        run = 0 if r["ok"] else run + 1
        return run, (run, run >= failures)

    return scan(calls, key, order, lambda: 0, step, "run int, open boolean")


def proposals_fit(proposals: Column, length: Column, most: int = 80) -> Column:
    """Whether an array of struct(start, end) has valid intervals of `most` at most within a text that don't overlap."""
    p = F.array_sort(proposals)
    inside = F.forall(p, lambda x: (x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] <= length) & (x["end"] - x["start"] <= most))
    apart = F.forall(F.transform(p, lambda x, i: (i == 0) | (x["start"] >= F.get(p, i - 1)["end"])), lambda ok: F.coalesce(ok, F.lit(True)))
    return inside & apart
