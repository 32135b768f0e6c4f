"""Checks that a transformed text kept what it must: numbers, links, terms, length, words."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import once

#: Patterns of numbers, links, addresses and technical terms; length ratios by kind of change.
NUMBER = r"(?=[+\-\d])(?<![\p{L}\p{N}_])[+-]?\d[\d.,]*\s?%?(?![\p{L}\p{N}_])"
LINK = r"(?i)https?://[^\s<>\"]+|www\.[^\s<>\"]+"
MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
TERM = r"(?=[A-Za-zÁÉÍÓÚÑáéíóúñ])(?<![\p{L}\p{N}_])(?:[A-ZÁÉÍÓÚÑ]{2,}[A-ZÁÉÍÓÚÑ0-9.-]*|[A-Za-zÁÉÍÓÚÑáéíóúñ]+(?:\.[A-Za-z0-9]+)+|[A-Za-zÁÉÍÓÚÑáéíóúñ]+[A-Z][A-Za-z0-9]*)(?![\p{L}\p{N}_])"
RATIOS = {"translation": (0.48, 0.62, 1.75, 2.15), "polish": (0.55, 0.72, 1.30, 1.60), "correction": (0.78, 0.90, 1.12, 1.35)}
#: Numbers said in words, and abbreviations that a translation replaces.
SAID = {
    "0": "zero, cero", "1": "one, uno, una, un", "2": "two, dos", "3": "three, tres", "4": "four, cuatro", "5": "five, cinco", "6": "six, seis", "7": "seven, siete",
    "8": "eight, ocho", "9": "nine, nueve", "10": "ten, diez", "11": "eleven, once", "12": "twelve, doce", "13": "thirteen, trece", "14": "fourteen, catorce",
    "15": "fifteen, quince", "16": "sixteen, dieciséis, dieciseis", "17": "seventeen, diecisiete", "18": "eighteen, dieciocho", "19": "nineteen, diecinueve",
    "20": "twenty, veinte", "30": "thirty, treinta", "40": "forty, cuarenta", "50": "fifty, cincuenta", "60": "sixty, sesenta", "70": "seventy, setenta",
    "80": "eighty, ochenta", "90": "ninety, noventa", "100": "hundred, cien, ciento", "200": "two hundred, doscientos, doscientas", "300": "three hundred, trescientos, trescientas",
    "400": "four hundred, cuatrocientos, cuatrocientas", "500": "five hundred, quinientos, quinientas", "600": "six hundred, seiscientos, seiscientas",
    "700": "seven hundred, setecientos, setecientas", "800": "eight hundred, ochocientos, ochocientas", "900": "nine hundred, novecientos, novecientas",
    "1000": "thousand, mil", "1000000": "million, millón, millon, millones",
}
SAME = {
    "adhd": "tdah", "tdah": "adhd", "us": "eeuu, ee.uu, ee.uu., eua", "usa": "eeuu, ee.uu, ee.uu., eua", "un": "onu", "onu": "un", "who": "oms", "oms": "who", "hiv": "vih", "vih": "hiv",
    "ai": "ia", "ia": "ai", "eu": "ue", "ue": "eu", "nato": "otan", "otan": "nato", "ceo": "director, consejero", "phd": "doctorado, doctor", "ui": "interfaz", "uis": "interfaces, interfaz",
    "id": "identificacion, identificador",
}
SHORT_TERM = 3


def none() -> Column:
    return F.array().cast("array<string>")


def matches(text: Column, pattern: str) -> Column:
    """Lower-cased matches without stops at their end."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), none())
    return F.transform(found, lambda m: F.lower(F.rtrim(m, F.lit(".,;:!?"))))


def mails(text: Column) -> Column:
    """Addresses; a text without their sign isn't searched."""
    return F.when(F.contains(text, F.lit("@")), matches(text, MAIL)).otherwise(none())


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with a value that is computed once, however often it is used, also for the elements of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def numbers(text: Column) -> Column:
    return F.transform(matches(text, NUMBER), lambda m: F.regexp_replace(m, r"[\s.,]", ""))


def occurrences(items: Column) -> Column:
    """Items with the number of their occurrence ahead of them ("1:x", "2:x"), so that those of two arrays can be compared as sets."""

    def numbered(s: Column) -> Column:
        runs = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda runs, at, j: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(runs, j + 1), F.size(s)) - at), lambda k: F.concat(k.cast("string"), F.lit(":"), F.get(s, at)))
        return held(runs, lambda r: F.flatten(F.transform(r, lambda at, j: run(r, at, j))))

    return held(F.sort_array(items), lambda s: F.when(F.size(s) > 0, numbered(s)).otherwise(s))


def lost(a: Column, b: Column) -> Column:
    """Distinct items that a has more of than b, in a's order."""
    more = lambda a, b: F.array_intersect(F.array_distinct(a), F.transform(F.array_except(occurrences(a), occurrences(b)), lambda t: F.regexp_extract(t, r"(?s)^\d+:(.*)", 1)))
    return held(a, lambda a: held(b, lambda b: F.when(a == b, none()).otherwise(more(a, b))))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]+", "")


def unbacked(candidates: Column, other_digits: Column) -> Column:
    """Numbers whose digits don't occur in a row on the other side."""
    gone = lambda c: held(other_digits, lambda d: F.filter(c, lambda x: ~F.contains(d, digits(x))))
    return held(candidates, lambda c: F.when(F.size(c) > 0, gone(c)).otherwise(c))


def really_lost(candidates: Column, other_digits: Column, other: Column) -> Column:
    """unbacked, without numbers that the other side says in words."""
    words = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(other, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")
    words = F.concat(F.lit(" "), words, F.lit(" "))
    said = lambda x, words: F.exists(_options(SAID, x), lambda w: F.contains(words, F.concat(F.lit(" "), w, F.lit(" "))))
    unsaid = lambda c: held(words, lambda w: F.filter(c, lambda x: ~said(x, w)))
    return held(unbacked(candidates, other_digits), lambda c: F.when(F.size(c) > 0, unsaid(c)).otherwise(c))


def _options(table: dict[str, str], key: Column) -> Column:
    """The entries of a fixed table under a key; none where it has none."""
    return F.coalesce(F.split(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), ", "), none())


def lost_terms(a: Column, b: Column) -> Column:
    """Technical terms of a that b no longer holds in any form: not short ones, nor ones with an equivalent there."""
    gone = F.array_except(F.array_distinct(matches(a, TERM)), F.array_distinct(matches(b, TERM)))
    bare = lambda t: F.btrim(t, F.lit("."))
    long = lambda t: F.length(F.replace(t, F.lit("."), F.lit(""))) >= SHORT_TERM
    other = lambda t, there: F.exists(_options(SAME, bare(t)), lambda w: F.contains(there, w))
    left = lambda g: held(F.lower(F.coalesce(b, F.lit(""))), lambda there: F.sort_array(F.filter(g, lambda t: long(t) & ~F.contains(there, bare(t)) & ~other(t, there))))
    return held(gone, lambda g: F.when(F.size(g) > 0, left(g)).otherwise(g))


def listed(items: Column, most: int = 3) -> Column:
    """The first `most` distinct items and how many more."""
    d = F.array_distinct(items)
    more = F.concat(F.lit(" and "), (F.size(d) - most).cast("string"), F.lit(" more"))
    return F.concat(F.array_join(F.slice(d, 1, most), ", "), F.when(F.size(d) > most, more).otherwise(""))


def check(df: DataFrame, source: str, result: str, kind: str = "translation", other_language: bool = True) -> DataFrame:
    """df with issues (array of struct(code, critical)), score and status (ok, warning, alert).

    Length is compared for sources of eight words or more; the score loses 35 for each critical issue and 12 for each other.
    """
    low, low_fine, high_fine, high = RATIOS[kind]
    df = once(df, "_t", F.struct(F.trim(F.coalesce(source, F.lit(""))).alias("a"), F.trim(F.coalesce(result, F.lit(""))).alias("b")))
    word = F.lit(r"[\p{L}\p{N}_'-]+")
    paragraphs = lambda t: F.filter(F.split(t, r"\n\s*\n"), lambda p: F.trim(p) != "")
    found = {"n": lambda t: F.regexp_count(t, word), "numbers": numbers, "links": lambda t: matches(t, LINK), "mails": mails, "p": lambda t: F.size(paragraphs(t))}
    df = once(df, "_f", F.struct(*[F.struct(*[f(F.col(f"_t.{side}")).alias(k) for k, f in found.items()]).alias(side) for side in "ab"]))
    a, b, na, nb = F.col("_t.a"), F.col("_t.b"), F.col("_f.a.n"), F.col("_f.b.n")
    ratio = nb / F.greatest(F.lit(1), na)
    both = lambda k: (F.col(f"_f.a.{k}"), F.col(f"_f.b.{k}"))
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", ""))
    some = lambda c: F.size(c) > 0
    fewer = lambda k: some(lost(*both(k)))
    more = lambda k: some(lost(*both(k)[::-1]))
    long = na >= 8
    tests = [
        ("empty", True, b == ""), ("omission", True, long & (ratio < low)), ("invention", True, long & (ratio > high)),
        ("length", False, long & ~(ratio < low) & ~(ratio > high) & ~ratio.between(low_fine, high_fine)),
        ("unchanged", True, F.lit(kind == "translation" and other_language) & (na >= 5) & ((a == b) | (bare(a) == bare(b)))),
        ("missing_numbers", True, some(really_lost(lost(*both("numbers")), digits(b), b))),
        ("invented_numbers", True, some(really_lost(lost(*both("numbers")[::-1]), digits(a), a))),
        ("missing_links", True, fewer("links")), ("invented_links", True, more("links")), ("missing_mails", True, fewer("mails")), ("invented_mails", True, more("mails")),
        ("terms", False, F.when(a != b, some(lost_terms(a, b))).otherwise(False)), ("paragraphs", False, (F.col("_f.a.p") > 3) & (F.col("_f.b.p") * 2 <= F.col("_f.a.p"))),
    ]
    issues = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(k).alias("critical"))) for c, k, t in tests]))
    df = once(df, "_issues", issues)
    bad = F.size(F.filter("_issues", lambda i: i["critical"]))
    mild = F.size("_issues") - bad
    status = F.when(bad > 0, "alert").when(mild > 0, "warning").otherwise("ok")
    return df.select(*[c for c in df.columns if c[0] != "_"], F.col("_issues").alias("issues"), F.greatest(F.lit(0), 100 - bad * 35 - mild * 12).alias("score"), status.alias("status"))


def words_kept(a: Column, b: Column) -> Column:
    """Whether both texts are the same words in the same order, punctuation at their edges aside."""
    bare = lambda c: F.filter(F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    return bare(a) == bare(b)


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9áéíóúüñ]+"), F.lit(0)), none())


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences by bit-parallel columns: a column of differences is two integers of len(a) bits."""
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        level = (((same & up) + up) ^ up) | same | down
        rises, falls = (down | ~(level | up)) & full, up & level
        score += bool(rises & top) - bool(falls & top)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = (falls | ~(level | rises)) & full, rises & level
    return score


def edits(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words; null where either is."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


def word_error_rate(reference: Column, heard: Column) -> Column:
    a = tokens(reference)
    return edits(a, tokens(heard)) / F.greatest(F.lit(1), F.size(a))
