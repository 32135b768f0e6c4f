"""Column functions that turn names into codes and numbers into words, and measure characters as readers see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language codes by English name.
CODE_BY_NAME = {
    "afrikaans": "af", "albanian": "sq", "amharic": "am", "arabic": "ar", "armenian": "hy", "assamese": "as", "azerbaijani": "az", "bashkir": "ba", "basque": "eu", "belarusian": "be",
    "bengali": "bn", "bosnian": "bs", "breton": "br", "bulgarian": "bg", "burmese": "my", "myanmar": "my", "catalan": "ca", "chinese": "zh", "mandarin": "zh", "cantonese": "yue",
    "croatian": "hr", "czech": "cs", "danish": "da", "dutch": "nl", "flemish": "nl", "english": "en", "estonian": "et", "finnish": "fi", "french": "fr", "fulah": "ff",
    "pulaar": "ff", "galician": "gl", "georgian": "ka", "german": "de", "greek": "el", "gujarati": "gu", "hausa": "ha", "hawaiian": "haw", "hebrew": "he", "hindi": "hi",
    "hungarian": "hu", "icelandic": "is", "indonesian": "id", "italian": "it", "japanese": "ja", "javanese": "jv", "kannada": "kn", "kazakh": "kk", "khmer": "km",
    "cambodian": "km", "korean": "ko", "lao": "lo", "latin": "la", "latvian": "lv", "lingala": "ln", "lithuanian": "lt", "luxembourgish": "lb", "macedonian": "mk",
    "malagasy": "mg", "malay": "ms", "malayalam": "ml", "maltese": "mt", "maori": "mi", "marathi": "mr", "mongolian": "mn", "nynorsk": "nn", "norwegian": "no", "occitan": "oc",
    "pashto": "ps", "pushto": "ps", "punjabi": "pa", "panjabi": "pa", "persian": "fa", "farsi": "fa", "polish": "pl", "portuguese": "pt", "romanian": "ro", "russian": "ru",
    "sanskrit": "sa", "serbian": "sr", "shona": "sn", "sindhi": "sd", "sinhala": "si", "sinhalese": "si", "slovak": "sk", "slovenian": "sl", "somali": "so", "spanish": "es",
    "castilian": "es", "swahili": "sw", "swedish": "sv", "tajik": "tg", "tamil": "ta", "tatar": "tt", "telugu": "te", "thai": "th", "tibetan": "bo", "turkish": "tr",
    "turkmen": "tk", "ukrainian": "uk", "urdu": "ur", "uzbek": "uz", "vietnamese": "vi", "welsh": "cy", "wolof": "wo", "yiddish": "yi", "yoruba": "yo",
}
#: Spanish number words; categories and kinds of grammar findings.
ONES = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
STYLE_ONLY = ["STYLE", "REDUNDANCY", "COLLOQUIALISMS", "PLAIN_ENGLISH", "WORDINESS", "CREATIVE_WRITING", "SEMANTICS", "MISC", "TYPOGRAPHY_STYLE"]
SAFE_KINDS = ["misspelling", "typographical", "grammar", "duplication", "whitespace"]


def language_code(c: Column) -> Column:
    """Two letters of a code (en-US, en_us) or of an English name; empty for anything else."""
    first = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^[^-_]*", 0)
    table = F.create_map(*[F.lit(x) for kv in CODE_BY_NAME.items() for x in kv])
    return F.when(first.rlike("^[a-z]{2}$"), first).otherwise(F.coalesce(F.element_at(table, first), F.lit("")))


def spanish_number(n: Column) -> Column:
    """0 to 9999 in words; other numbers as digits."""
    word = lambda ws, i: F.get(F.array(*map(F.lit, ws)), i.cast("int"))
    t, h, r = F.floor(n / 1000), F.floor(n / 100) % 10, n % 100
    tens = F.concat(word(TENS, F.floor(r / 10) - 3), F.when(r % 10 > 0, F.concat(F.lit(" y "), word(ONES, r % 10 - 1))).otherwise(""))
    low = F.when(r == 0, None).when(r < 30, word(ONES, r - 1)).otherwise(tens)
    mid = F.when((h == 1) & (r == 0), "cien").when(h > 0, word(HUNDREDS, h - 1))
    high = F.when(t == 1, "mil").when(t > 1, F.concat(word(ONES, t - 1), F.lit(" mil")))
    return F.when(n == 0, "cero").when((n < 0) | (n > 9999) | n.isNull(), n.cast("string")).otherwise(F.concat_ws(" ", high, mid, low))


def graphemes(c: Column) -> Column:
    """The characters that a reader sees, marks and joined signs together."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0)), F.array().cast("array<string>"))


def hash31(c: Column) -> Column:
    """Rolling hash of the lower-cased text by 31 in 32 bits, of characters below 65536, as an unsigned number."""
    step = lambda h, x: (h * 31 + F.ascii(x).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    units = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), ""), lambda x: x != "")
    return F.aggregate(units, F.lit(0).cast("long"), step)


def glossary(c: Column, budget: int, most: int = 60) -> Column:
    """Terms of a list, the first spelling of equal ones, in order while they fit the budget (two characters between them)."""
    terms = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n,;]+"), lambda t: F.trim(t)), lambda t: t != "")
    low = F.transform(terms, lambda t: F.lower(t))
    firsts = F.slice(F.filter(terms, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, most)
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(a: Column, t: Column) -> Column:
        size = F.length(t) + F.when(F.size(a["out"]) > 0, 2).otherwise(0)
        fits = ~a["full"] & (a["used"] + size <= budget)
        return F.struct(F.when(fits, F.array_append(a["out"], t)).otherwise(a["out"]).alias("out"), F.when(fits, a["used"] + size).otherwise(a["used"]).alias("used"), (~fits).alias("full"))

    return F.aggregate(firsts, empty, step, lambda a: a["out"])


def sure_finding(first: Column, choices: Column, category: Column, kind: Column) -> Column:
    """Whether a grammar finding may be applied: a safe kind, no matter of style, one to three choices, a first one that isn't empty."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    style = F.upper(F.coalesce(category, F.lit(""))).isin(STYLE_ONLY)
    return choices.between(1, 3) & ~style & ((low == "") | low.isin(SAFE_KINDS)) & (F.trim(F.coalesce(first, F.lit(""))) != "")


def separator(decision: Column) -> Column:
    """What stands between two pieces by what was decided on them."""
    return F.when(decision.isNull() | (decision == "join"), "").when(decision == "paragraph", "\n\n").otherwise(" ")
