"""Column functions that clean, mark and classify short texts: fragments, speech, answers, blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import fold, squeeze

#: Ligatures, odd spaces, invisible characters, what opens and closes.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SPACES = "   "
INVISIBLE = "­​‌‍﻿⁠᠎"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
HYPHENS = "-­‐‑‒"
ROMAN_PAGE = r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
NO_PAGE = ["mi", "di", "vi", "mil", "mix", "civil", "lid", "dim", "li", "mid"]
#: Sounds in brackets, words of images and of videos in a prompt, days, months and tongues, accents no longer written.
SOUNDS = (
    r"(?i)^(?:music|m[uú]sica|applause|aplausos?|laughter|laughs?|risas?|cheering|cheers|silence|silencio|inaudible|snorts?|sighs?|coughs?|clears throat|noise|ruido|sound|sonido|gasps?|groans?|screams?|suspira|tose)(?:[^\p{L}\p{N}_]|$)"
)
LOWERED = "Lunes Martes Miércoles Jueves Viernes Sábado Domingo Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Setiembre Octubre Noviembre Diciembre Español Inglés Francés Alemán Italiano Portugués".split()
UNACCENTED = {"sólo": "solo", "éste": "este", "ésta": "esta", "éstos": "estos", "éstas": "estas", "ése": "ese", "ésa": "esa", "ésos": "esos", "ésas": "esas", "aquél": "aquel", "aquélla": "aquella", "aquéllos": "aquellos", "aquéllas": "aquellas"}
TERMS = [
    "JavaScript", "TypeScript", "Node.js", "Next.js", "React", "Angular", "Vue", "Express", "Bootstrap", "Tailwind", "jQuery", "MongoDB", "PostgreSQL", "MySQL",
    "GitHub", "Git", "npm", "HTML", "CSS", "SQL", "JSON", "DOM", "HTTP", "HTTPS", "REST API", "API", "AJAX", "CRUD", "JWT", "OAuth", "WebSocket", "Docker",
    "full stack", "full-stack", "front end", "front-end", "frontend", "back end", "back-end", "backend", "framework", "frameworks", "middleware", "endpoint", "endpoints",
    "callback", "callbacks", "promise", "promises", "async", "await", "hooks", "hook", "props", "array", "arrays", "string", "strings", "boolean", "booleans",
    "pull request", "commit", "commits", "branch", "branches",
]
IN_WORD = r"\p{L}\p{N}_"


def atom_text(c: Column) -> Column:
    """Ligatures as letters, odd spaces as spaces, controls gone."""
    c = F.coalesce(c, F.lit(""))
    for k, v in LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(F.translate(c, SPACES, "   "), CONTROLS, "")


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("­"), F.lit("")), r"\s+", "")


def last_fragment(c: Column) -> Column:
    """The word at the end, empty where there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\p{L}[\p{L}\p{M}'’-]*+)\s*+$", 1)


def first_fragment(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\p{L}[\p{L}\p{M}'’-]*)", 1)


def long_token(c: Column) -> Column:
    """A link, an address, a formula of over 12 signs, or over 80 characters without a blank."""
    c = F.coalesce(c, F.lit(""))
    formula = c.rlike(r"^[\d.,+\-*/^=()\[\]{}\\]+$") & (F.length(c) > 12)
    return c.rlike(r"(?i)^https?://\S+") | c.rlike(r"(?i)^www\.\S+") | c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") | formula | ((F.length(c) > 80) & ~c.rlike(r"\s"))


def line_key(c: Column) -> Column:
    """Folded, without digits, squeezed: equal for a running head on different pages."""
    return squeeze(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[0-9]+", ""))


def spoken(c: Column) -> Column:
    """Without [sounds], sounds in round brackets, sung lines, notes and marks of a new speaker."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]*\]", " "), "[♪♫♬][^♪♫♬]*[♪♫♬]", " ")
    # pieces before, within and after each short bracket
    parts = F.split(F.regexp_replace(c, r"(\([^()]{0,40}\))", "\u001e$1\u001e"), "\u001e")

    def sound(p: Column) -> Column:
        inside = F.trim(F.regexp_extract(p, r"^\(([^()]*)\)$", 1))
        loud = inside.rlike(r"\p{L}") & (inside == F.upper(inside))
        return p.rlike(r"^\([^()]{0,40}\)$") & ((inside == "") | inside.rlike(SOUNDS) | inside.rlike(r"(\p{L})\1{3,}") | loud)

    c = F.array_join(F.transform(parts, lambda p: F.when(sound(p), " ").otherwise(p)), "")
    return squeeze(F.regexp_replace(F.regexp_replace(c, "[♪♫♬]+", " "), r"(^|\s)(?:>>|&gt;&gt;)+\s*", "$1"))


def only_sound(c: Column) -> Column:
    return ~spoken(c).rlike(r"[\p{L}\p{N}]")


def is_sha(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-fA-F0-9]{64}$"), F.lit(False))


def voice_text(c: Column) -> Column:
    """Without invisible characters and controls, words cut by a hyphen at a line's end joined. Characters are taken as composed."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{INVISIBLE}]", ""), CONTROLS[:-1] + r"\x7f]", "")
    return F.regexp_replace(c, r"(\p{L})-\s*\n\s*(\p{L})", "$1$2")


def say_numerals(c: Column, word: str = "número") -> Column:
    """#1 said as a number, #tag as a hashtag, a lone # as the word."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[#＃﹟]\s*(\d[\d.,]*)", f" {word} $1")
    return F.regexp_replace(F.regexp_replace(c, r"[#＃﹟](\p{L}[\p{L}\p{N}_]*)", " hashtag $1"), "[#＃﹟]", f" {word} ")


def unsay_numerals(c: Column) -> Column:
    """Without the words that say_numerals puts in."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)(^|[^{IN_WORD}])(?:n[uú]mero|number)\s+(\d)", "$1$2")
    return F.regexp_replace(c, rf"(?i)(^|[^{IN_WORD}])hashtag\s+", "$1")


def plain_emphasis(c: Column) -> Column:
    """*Emphasis* and **strong emphasis** of up to 80 characters within a line without the stars."""
    return F.regexp_replace(c, rf"(^|[^{IN_WORD}*])\*{{1,2}}([^*\n]{{1,80}})\*{{1,2}}($|[^{IN_WORD}*])", "$1$2$3")


def answer_text(c: Column) -> Column:
    """The inside of a fenced block, if there is one, without outer blanks and backticks."""
    c = F.coalesce(c, F.lit(""))
    inside = F.regexp_extract(c, r"(?s)```[a-zA-Z0-9_+-]*[ \t]*\n(.*?)```", 1)
    return F.regexp_replace(F.when(F.trim(F.regexp_replace(inside, r"\s", "")) != "", inside).otherwise(c), r"^[\s`]+|[\s`]+$", "")


def marker(name: str = "SEG") -> str:
    """Pattern of the numbered marks that stand before a text's segments."""
    return rf"\[\[{name}_\d{{6}}\]\]"


def markers_kept(a: Column, b: Column, name: str = "SEG") -> Column:
    """Whether an answer has its source's markers in the same order; those of a source without any don't count."""
    m = lambda c: F.coalesce(F.regexp_extract_all(c, F.lit(marker(name)), F.lit(0)), F.array().cast("array<string>"))
    return (F.size(m(a)) == 0) | (m(a) == m(b))


def drop_markers(c: Column, name: str = "SEG") -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"\s*{marker(name)}\s*", " "))


def spanish_norms(c: Column) -> Column:
    """Days, months and tongues in small letters within a sentence; accents that are no longer written dropped."""
    for w in LOWERED:
        c = F.regexp_replace(c, rf"([\p{{L}}\p{{N}},;:)»] ){w}($|[^{IN_WORD}])", f"$1{w.lower()}$2")
    for a, b in UNACCENTED.items():
        for x, y in ((a, b), (a.capitalize(), b.capitalize())):
            c = F.regexp_replace(c, rf"(^|[^{IN_WORD}]){x}($|[^{IN_WORD}])", f"$1{y}$2")
    return c


def opening_marks(sentences: Column) -> Column:
    """Sentences with ¿ or ¡ put before those that end in ? or ! without one, joined by blanks."""
    def one(s: Column) -> Column:
        ask = s.endswith("?") & ~F.contains(s, F.lit("¿"))
        shout = s.endswith("!") & ~F.contains(s, F.lit("¡"))
        return F.when(ask, F.concat(F.lit("¿"), s)).when(shout, F.concat(F.lit("¡"), s)).otherwise(s)

    return F.array_join(F.transform(sentences, one), " ")


def mark_terms(c: Column) -> Column:
    """Technical terms in backticks, the longest first; those marked already stay."""
    any_ = "|".join(t.replace(".", r"\.") for t in sorted(TERMS, key=len, reverse=True))
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?iu)(?<![{IN_WORD}`])(?:{any_})(?![{IN_WORD}`])", "`$0`")


def unmark_terms(c: Column) -> Column:
    """Without backticks; blanks beside one become one."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+`[ \t]*|`[ \t]+", " ")
    return F.replace(c, F.lit("`"), F.lit(""))


def escape_html(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rate_of(c: Column) -> Column:
    """A written rate with a point or a comma, within 0.25 and 2, to two digits; 1 where it is none."""
    v = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v.isNull(), 1.0).otherwise(F.floor(F.least(F.lit(2.0), F.greatest(F.lit(0.25), v)) * 100 + 0.5) / 100)


def control_rate(c: Column) -> Column:
    """rate_of on the grid of 0.05 within 0.5 and 2."""
    return F.floor(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.floor(rate_of(c) / 0.05 + 0.5) * 0.05)) * 100 + 0.5) / 100


def prosody(rate: Column, tone: Column) -> Column:
    """Percent by which a voice is sped up, shifted by its tone and kept within -25 and 100."""
    base = F.bround((F.least(F.lit(2.0), F.greatest(F.lit(0.75), F.coalesce(rate, F.lit(1.0)))) - 1) * 100).cast("int")
    t = F.lower(F.trim(F.coalesce(tone, F.lit(""))))
    n = base + F.when(t == "warm", -3).when(t == "energetic", 3).otherwise(0)
    return F.format_string("%+d%%", F.greatest(F.lit(-25), F.least(F.lit(100), n)))


def untranslated(a: Column, b: Column) -> Column:
    """Whether a translation is empty, equal to its source, or one holds the other at nearly its length."""
    o, t = (F.lower(squeeze(F.coalesce(c, F.lit("")))) for c in (a, b))
    echo = (F.length(o) >= 12) & (F.contains(t, o) | F.contains(o, t)) & (F.abs(F.length(o) - F.length(t)) < F.greatest(F.lit(8.0), F.length(o) * 0.12))
    return (t == "") | (o == t) | echo


def block_kind(c: Column) -> Column:
    """h3, ul, ol, blockquote, table or p."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    many = F.size(lines) > 1
    every = lambda p: many & F.forall(lines, lambda x: x.rlike(p))
    cells = F.transform(lines, lambda x: F.size(F.filter(F.split(x, r"\|"), lambda y: F.trim(y) != "")))
    table = c.rlike(r"\|.*\|") & many & (F.array_min(cells) == F.array_max(cells))
    loud = (c == F.upper(c)) & c.rlike("[A-ZÁÉÍÓÚÑ]{2,}")
    named = c.rlike("(?i)^(capítulo|capitulo|parte|prólogo|prologo|epílogo|anexo|introducción)")
    title = (F.length(c) <= 90) & ~c.rlike("[.!?…:]$") & (loud | named)
    return (
        F.when(c.rlike(r"^#{1,3}\s+\S"), "h3").when(every(r"^[-•●]\s+\S"), "ul").when(every(r"^\d+\.\s+\S"), "ol")
        .when(c.startswith(">") | every('^["“«]'), "blockquote").when(table, "table").when(title, "h3").otherwise("p")
    )


def hyphen_kind(left: Column, right: Column) -> Column:
    """dialogue, unbreakable, split, compound or none, by what stands beside a line's end."""
    end, begin = F.regexp_replace(left, r"\s+$", ""), F.regexp_replace(right, r"^\s+", "")
    talk = end.rlike("[—–]$") | begin.rlike("^[—–]")
    return (
        F.when(talk, "dialogue").when(end.endswith("‑"), "unbreakable").when(end.endswith("­"), "split").when(~end.rlike(f"[{HYPHENS}]$"), "none")
        .when(begin.rlike(r"^\p{Lu}") | end.rlike(rf"(?i)\d+(st|nd|rd|th)[{HYPHENS}]$"), "compound").otherwise("split")
    )


def page_number(c: Column) -> Column:
    """Up to three digits or a roman numeral, marks around it aside; words that look like numerals aren't."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    core = F.lower(F.regexp_replace(raw, r"^[\s\-–—·•|*\[\](){}<>.\"']+|[\s\-–—·•|*\[\](){}<>.\"']+$", ""))
    return (raw != "") & (F.length(raw) <= 24) & (core != "") & (core.rlike(r"^\d{1,3}$") | (core.rlike(ROMAN_PAGE) & ~core.isin(NO_PAGE)))


def split_acronym(a: Column, b: Column) -> Column:
    """Two runs of one to four capitals, eight together at most."""
    return a.rlike(r"^\p{Lu}{1,4}$") & b.rlike(r"^\p{Lu}{1,4}$") & (F.length(a) + F.length(b) <= 8)


STAMP = r"\[?(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\]?"


def raw_transcript(c: Column) -> Column:
    """A pasted transcript without times, cue marks and equal neighbours; texts without signs of one stay as they are."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit(""))
    signs = t.rlike(r"(?m)^\s*\d{1,2}:\d{2}($|[^\p{L}\p{N}_])") | F.contains(t, F.lit("-->")) | F.contains(F.upper(t), F.lit("WEBVTT"))
    signs = signs | (F.regexp_count(t, F.lit(r"\d{1,2}:\d{2}")) >= 3)
    noise = rf"(?i)^WEBVTT|-->|^\d+$|^(?:Kind|Language|NOTE)\s*:|^{STAMP}$"
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(noise))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), rf"^{STAMP}\s*[-–—]?\s*", ""), rf"(^|\s){STAMP}(\s|$)", "$1 $2")
    clean = F.filter(F.transform(lines, lambda x: squeeze(bare(x))), lambda x: x != "")
    once = F.array_join(F.filter(clean, lambda x, i: (i == 0) | (x != F.get(clean, i - 1))), " ")
    return F.when(signs & (once != ""), once).otherwise(F.trim(F.coalesce(c, F.lit(""))))
