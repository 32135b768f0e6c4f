"""Evidence for the language of a text, its fusion, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.library import short_code
from strandline.functions.text import ACCENTED, PLAIN, once

#: Very frequent words of the two languages that are told apart by words.
ENGLISH = (
    "the of and to in is that it for you was with on as are this have be at they "
    "but not from or by we can what all your there their has will would about when "
    "been if more which who them then than could should into our out how did does "
    "because were his her him she he"
).split()
SPANISH = (
    "de la que el en los se del las un por con no una su para es al lo como más pero "
    "sus le ya este cuando muy sin sobre también me hasta hay donde quien desde todo "
    "nos durante todos uno les ni contra otros ese eso ante ellos esto mí antes algunos "
    "qué unos yo otro otras otra tanto esa estos mucho quienes nada muchos cual sea "
    "poco ella estar estas algunas algo nosotros"
).split()
#: Languages by script in the order that decides, weights of sources, languages that can be dubbed.
SCRIPTS = {"ar": "؀-ۿ", "ru": "Ѐ-ӿ", "hi": "ऀ-ॿ", "ko": "가-힯ᄀ-ᇿ", "ja": "぀-ヿ", "zh": "一-鿿", "he": "֐-׿", "el": "Ͱ-Ͽ", "th": "฀-๿"}
WEIGHTS = {"declared_audio": 0.97, "generated_track": 0.92, "spoken_words": 0.90, "words": 0.72, "manual_track": 0.55, "provider": 0.62, "script": 0.95}
DUBBED, TARGET, SURE = ["en", "pt", "fr", "de", "it"], "es", 0.7
#: Characters of a text that script and words are read from (a parameter of the reference's own operators).
SCRIPT_CHARS, WORD_CHARS = 4000, 6000


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def script_language(text: Column, least: float = 0.3, chars: int = SCRIPT_CHARS) -> Column:
    """struct(lang, confidence): the first script that makes `least` of the letters; empty for Latin text."""
    letters = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, chars), r"[^\p{L}]", "")
    n = F.length(letters)
    out = F.struct(F.lit("").alias("lang"), F.lit(0.0).alias("confidence"))
    for lang, chars_ in reversed(SCRIPTS.items()):
        share = F.length(F.regexp_replace(letters, f"[^{chars_}]", "")) / n
        found = F.struct(F.lit(lang).alias("lang"), F.round(F.least(F.lit(0.95), 0.6 + share * 0.35), 3).alias("confidence"))
        out = F.when((n > 0) & (share >= least), found).otherwise(out)
    return out


def word_evidence(df: DataFrame, text: str, chars: int = WORD_CHARS) -> DataFrame:
    """df with lang, confidence, words and density: frequent words and marks of English against those of Spanish.

    Marks that only one language writes count as three words each, up to twelve. Ties have no language.
    """
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars)
    df = once(df.withColumn("_h", head), "_t", F.regexp_extract_all(F.lower("_h"), F.lit("[a-záéíóúüñ]+"), F.lit(0)))
    fold = lambda ws: [w.translate(str.maketrans(ACCENTED, PLAIN)) for w in ws]
    plain = F.transform("_t", lambda w: F.translate(w, ACCENTED, PLAIN))
    # as in the reference, words of the text lose their accents and listed ones keep theirs
    hits = lambda ws: F.size(F.filter(plain, lambda w: w.isin([x for x in ws if x == fold([x])[0]])))
    marks = lambda p: F.least(F.lit(12), F.regexp_count(F.col("_h"), F.lit(p)) * 3)
    df = df.withColumn("_en", hits(ENGLISH) + marks(r"(?i)(?<![\p{L}\p{N}_])[\p{L}\p{N}_]+'(?:s|t|re|ve|ll|d|m)(?![\p{L}\p{N}_])"))
    df = df.withColumn("_es", hits(SPANISH) + marks(r"(?iu)[ñ¿¡]|(?<=[a-z])[áéíóú]"))
    n, most, rest = F.size("_t"), F.greatest("_en", "_es"), F.least("_en", "_es")
    tie = (F.col("_en") == F.col("_es")) | (n == 0)
    sure = (most - rest) / (most + rest) * F.least(F.lit(1.0), most / n / 0.12) * F.least(F.lit(1.0), n / 80)
    return df.select(
        *[c for c in df.columns if c[0] != "_"], F.when(tie, "").when(F.col("_en") > F.col("_es"), "en").otherwise("es").alias("lang"),
        F.when(tie, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.round(sure, 3)))).alias("confidence"), n.alias("words"),
        F.when(tie, 0.0).otherwise(F.round(most / n, 3)).alias("density"),
    )


def signal(source: Column, lang: Column, confidence: Column) -> Column:
    """struct(source, lang, confidence), the confidence at most the source's weight; null without a language."""
    base = F.coalesce(*[F.when(source == k, v) for k, v in WEIGHTS.items()], F.lit(0.5))
    value = F.round(F.when(confidence.isNull(), base).otherwise(F.least(base, F.greatest(F.lit(0.0), confidence))), 3)
    return F.when(short_code(lang) != "", F.struct(source.alias("source"), short_code(lang).alias("lang"), value.alias("confidence")))


def fuse(df: DataFrame, signals: str) -> DataFrame:
    """df with lang, confidence and conflict of an array of signals.

    The strongest signal (the first of equals) names the language. Each further one that agrees takes
    away 0.45 of its share of the doubt left, in order of strength; the strongest that disagrees costs 0.6 of itself.
    """
    kept = F.filter(F.coalesce(F.col(signals), F.array()), lambda s: s.isNotNull())
    df = df.withColumn("_s", kept).withColumn("_top", F.array_max(F.transform("_s", lambda s: s["confidence"])))
    df = df.withColumn("_lang", F.get(F.filter("_s", lambda s: s["confidence"] == F.col("_top")), F.lit(0))["lang"])
    same = F.sort_array(F.transform(F.filter("_s", lambda s: s["lang"] == F.col("_lang")), lambda s: s["confidence"]), asc=False)
    more = F.slice(same, 2, F.greatest(F.size(same), F.lit(1)))
    sure = F.aggregate(more, F.col("_top"), lambda c, x: c + (1.0 - c) * x * 0.45)
    against = F.array_max(F.transform(F.filter("_s", lambda s: s["lang"] != F.col("_lang")), lambda s: s["confidence"]))
    total = F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.round(sure - F.coalesce(against, F.lit(0.0)) * 0.6, 3)))
    return df.select(
        *[c for c in df.columns if c[0] != "_"], F.coalesce("_lang", F.lit("")).alias("lang"), F.coalesce(total, F.lit(0.0)).alias("confidence"), against.isNotNull().alias("conflict"),
    )


def dubbing(lang: Column, confidence: Column, source: Column, conflict: Column) -> Column:
    """ask, none, unsupported or dub."""
    code = short_code(lang)
    firm = source.isin("user", "youtube") | (confidence >= SURE)
    return F.when(code == "", "ask").when(conflict | ~firm, "ask").when(code == TARGET, "none").when(~code.isin(DUBBED), "unsupported").otherwise("dub")
