"""Language evidence and checks of transformed texts and recognised speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import once, words

#: Frequent words of titles by language.
FREQUENT = {
    "en": "the a an of and to in is it you your how what why with for on this that are be can will from my we our new all about when".split(),
    "es": "el la los las de del y en que un una por para con cómo como qué es tu mi más sin sobre este esta nuevo nueva".split(),
    "pt": "o a os as de do da dos das e em que um uma por para com como é você seu sua mais sem sobre este esta novo nova não".split(),
    "fr": "le la les de des du et en un une pour avec comment est vous votre plus sans sur ce cette nouveau nouvelle pas qui".split(),
    "de": "der die das und ist ein eine zu mit für wie was nicht auf von den dem des ich du sie wir neue neuen".split(),
    "it": "il lo la gli le di del della e in un una per con come è tuo tua più senza su questo questa nuovo nuova non che".split(),
}
TITLE_WORD = "[a-záéíóúüñàâçèêëïîôûùäöß'ãõ]+"


def script_share(text: Column, script: str, chars: int = 4000) -> Column:
    """Share of a script among the letters of the first `chars` characters; null without letters."""
    head = F.substring(text, 1, chars)
    letters = F.length(F.regexp_replace(head, r"[^\p{L}]", ""))
    return F.try_divide(F.length(F.regexp_replace(head, rf"[^\p{{{script}}}]", "")), letters)


def title_language(df: DataFrame, text: str) -> DataFrame:
    """df with a count of frequent words for each language, lang and confidence; no language without any or on a tie."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TITLE_WORD), F.lit(0))
    known = sorted({w for ws in FREQUENT.values() for w in ws})
    df = once(df, "_t", F.filter(tokens, lambda w: w.isin(known)))
    for k, ws in FREQUENT.items():
        df = df.withColumn(k, F.size(F.filter("_t", _is_in(ws))).cast("long"))
    top = F.sort_array(F.array(*FREQUENT), asc=False)
    a, b = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    clear = (a > 0) & (a > b)
    best = F.coalesce(*[F.when(F.col(k) == a, k) for k in FREQUENT])
    sure = F.round(F.least(F.lit(0.8), 0.35 + 0.5 * (a - b) / a * F.least(F.lit(1.0), a / 4)), 3)
    return df.drop("_t").withColumn("lang", F.when(clear, best).otherwise("")).withColumn("confidence", F.when(clear, sure).otherwise(0.0))


def _is_in(ws: list[str]):
    return lambda w: w.isin(ws)


#: What recognisers say over silence.
INVENTED = r"(?i)subt[íi]tulos?.*amara\.org|subtitles?.*amara\.org|subt[íi]tulos? (?:realizados|creados) por|gracias por ver (?:el|este) v[íi]deo"


def asr_class(text: Column, logprob: Column, silence: Column, compression: Column) -> Column:
    """empty, pattern (a phrase that is invented over silence), metric (unlikely to be speech) or ok."""
    t = F.trim(F.coalesce(text, F.lit("")))
    odd = ((silence > 0.72) & (logprob < -1.0)) | ((compression > 2.6) & (logprob < -0.7))
    return F.when(t == "", "empty").when(t.rlike(INVENTED), "pattern").when(F.coalesce(odd, F.lit(False)), "metric").otherwise("ok")


def asr_suspect(logprob: Column, silence: Column, compression: Column) -> Column:
    """drop, doubtful or fine by the stricter limits of a local recogniser."""
    drop = ((silence > 0.55) & (logprob < -1.0)) | ((compression > 2.4) & (logprob < -0.5)) | ((logprob < -1.2) & (compression > 1.8))
    grey = ((logprob < -0.6) & (silence > 0.3)) | ((logprob < -0.9) & (compression > 1.5))
    return F.when(drop, "drop").when(grey, "doubtful").otherwise("fine")


def asr_report(segments: DataFrame, key: str) -> DataFrame:
    """segments(key, place, text, logprob, silence, compression) by key: counts by class, doubtful ones, and whether to review.

    The joined text of a key is not part of it, so that nothing unbounded is gathered.
    """
    sure = confidence(F.coalesce("logprob", F.lit(-0.3)))
    kind = asr_class(F.col("text"), F.col("logprob"), F.col("silence"), F.col("compression"))
    s = segments.select(key, kind.alias("class"), ((sure < 0.42) | (F.col("silence") > 0.48) | (F.col("compression") > 2.35)).alias("grey"))
    n = s.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("class") == "ok").alias("kept"), F.count_if(F.col("class") == "empty").alias("empty"),
        F.count_if(F.col("class").isin("pattern", "metric")).alias("removed"), F.count_if(F.col("class") == "pattern").alias("patterns"),
        F.count_if((F.col("class") == "ok") & F.col("grey")).alias("doubtful"),
    )
    removed, doubtful = F.col("removed") / F.col("n"), F.coalesce(F.try_divide("doubtful", "kept"), F.lit(0.0))
    lost = (F.col("kept") == 0) & (F.col("removed") > 0)
    review = (F.col("patterns") > 0) | lost | (removed > 0.15) | (doubtful > 0.25)
    return n.withColumn("review", review).withColumn("confirm", (F.col("patterns") > 0) | (removed > 0.25) | (doubtful > 0.35))


def confidence(logprob: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (logprob + 1.5) / 1.4)), 3)


def numbers(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def containment(a: Column, b: Column) -> Column:
    """Share of the tokens of a (repeats kept) that occur in b."""
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.filter(x, lambda t: F.array_contains(y, t))), F.size(x)), F.lit(0.0))
