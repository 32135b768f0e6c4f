"""Chunks of texts: sentences, reading units, exact blocks, packed paragraphs, captions.

Sentences, blank-line blocks and cores are expressions. The other rules look back at what they have
cut so far, so a text is cut by a small helper within Arrow batches; texts are independent rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"
UNIT, HARD, CLAUSE = 240, 300, 60
#: What closes and opens beside a sentence; titles and abbreviations that don't end one.
CLOSE, OPEN = "»”’\"')\\]}›", "«“‘\"'(\\[{¿¡"
TITLES = (
    "sr sra srta sres dr dra dres prof profa lic ing arq gral cnel sgto cap mr mrs ms st fr sta sto dña excmo ilmo rvdo"
).split()
BEFORE_NUMBER = "pág págs pp núm nº vol vols caps fig figs art arts ed eds no tel cf vs".split()
#: Words that must not end a caption.
DANGLING = "de del la el los las un una unos unas y e o u ni que en a al con por para se su sus mi mis tu tus lo le no sin como más".split()

_STOP = re.compile(rf"[.!?…]+[{CLOSE}]*(?=[ \t\n\r\f\v])")
_LAST_WORD = re.compile(r"[^\W_]+$")
_LIST = re.compile(r"(?:[-•●▪*]|\d{1,3}[.)])\s+\S")
_PHRASE = re.compile(rf"[\s{OPEN}—–-]*(\S)?")


def sentences(text: Column) -> Column:
    """Array of sentences: stops with their closing marks, then blanks, then anything but a small letter."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"([.!?…]+[{CLOSE}]*)\s+([{OPEN}]*[^\p{{Ll}}\s])", "$1\u001e$2")
    return F.filter(F.transform(F.split(marked, "\u001e"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def blank_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, text) of the blocks between blank lines, without outer blanks; offsets are in characters."""
    whole = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\n{2,})", "\u001e$1\u001e"), "\u001e")
    starts = F.aggregate(F.transform("_w", lambda x: F.length(x)), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    rows = df.select(key, whole.alias("_w")).select(key, F.explode(F.arrays_zip(F.slice(starts, 1, F.size("_w")).alias("s"), F.col("_w").alias("t"))).alias("p")).select(key, "p.*")
    left = F.length("t") - F.length(F.regexp_replace("t", r"^\s+", ""))
    inner = F.regexp_replace("t", r"^\s+|\s+$", "")
    return rows.select(key, (F.col("s") + left).alias("start"), (F.col("s") + left + F.length(inner)).alias("end"), inner.alias("text")).where("text <> ''")


def core(text: Column) -> Column:
    """struct(before, core, after): the text without outer blanks, and these; a text of blanks is all core."""
    t = F.coalesce(text, F.lit(""))
    inner = F.regexp_replace(t, r"^\s+|\s+$", "")
    blank = inner == ""
    return F.struct(
        F.when(blank, "").otherwise(F.regexp_extract(t, r"^\s*", 0)).alias("before"), F.when(blank, t).otherwise(inner).alias("core"),
        F.when(blank, "").otherwise(F.regexp_extract(t, r"\s*$", 0)).alias("after"),
    )


def pieces(df: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple[int, int, str]]]) -> DataFrame:
    """(key, piece, start, end, text) of every row's pieces by cut(text); null texts have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), ([], [], [], [], [])
                for k, t in zip(part.column(0), part.column(1).to_pylist()):
                    for n, piece in enumerate(cut(t or "")):
                        for col, v in zip(out, (k, n, *piece)):
                            col.append(v)
                cols = [pa.array([k.as_py() for k in out[0]], part.column(0).type), *(pa.array(c, t) for c, t in zip(out[1:], (pa.int64(), pa.int64(), pa.int64(), pa.string())))]
                yield pa.RecordBatch.from_arrays(cols, [key, "piece", "start", "end", "text"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, piece long, start long, end long, text string")


def tiling(found: DataFrame, totals: DataFrame, key: str, length: str) -> DataFrame:
    """(key, tiles): whether the pieces (key, start, end) of a key cover 0..length once, without gaps.

    Where every end lies behind its start, that is so if the starts and the length are the ends and 0,
    each as often: sums that are combined before the shuffle, so no key's pieces are sorted or gathered.
    """
    h = lambda c: F.sum(F.xxhash64(c).cast("decimal(38,0)"))
    got = found.groupBy(key).agg(h(F.col("start").cast("long")).alias("s"), h(F.col("end").cast("long")).alias("e"), F.min((F.col("end") > F.col("start")).cast("int")).alias("right"))
    one = lambda c: F.xxhash64(c.cast("long")).cast("decimal(38,0)")
    all_ = totals.select(key, F.col(length).alias("n")).join(got, key, "left")
    exact = (F.col("right") == 1) & (F.col("s") + one(F.col("n")) == F.col("e") + one(F.lit(0)))
    return all_.select(key, F.when(F.col("n") == 0, F.col("s").isNull()).otherwise(F.coalesce(exact, F.lit(False))).alias("tiles"))


def _span(t: str, a: int, b: int) -> tuple[int, int]:
    """a..b without blanks at its ends."""
    inner = t[a:b]
    left = len(inner) - len(inner.lstrip(BLANKS))
    return a + left, a + left + len(inner.strip(BLANKS))


def _lines(t: str) -> list[tuple[int, int]]:
    """Runs of lines that belong together: a break holds between paragraphs, before list items, after closing marks, and after short lines before a new phrase."""
    runs: list[list[int]] = []
    open_, last = False, ""
    for m in re.finditer(r"[^\n]*", t):
        a, b = _span(t, *m.span())
        if a == b:
            open_ = open_ and m.start() == m.end() and not (m.start() == 0 or t[m.start() - 1] == "\n")
            continue
        line = t[a:b]
        first = _PHRASE.match(line)[1]
        phrase = first is not None and not first.islower()
        apart = _LIST.match(line) or last.endswith(tuple(".!?…:»”\"")) or phrase and (last.endswith(")") or len(last) <= 90 and not last.endswith((",", ";")))
        if open_ and not apart:
            runs[-1][1] = b
        else:
            runs.append([a, b])
        open_, last = True, line
    return [(a, b) for a, b in runs]


def _ends(t: str, begin: int, m: re.Match, b: int) -> bool:
    """Whether the stop ends a sentence, by what follows and what stands before a lone point."""
    after = re.compile(rf"[ \t\n\r\f\v]+(?:([—–])[ \t\n\r\f\v]*|[{OPEN}]*)(\S)?").match(t, m.end(), b)
    first = after[2] if after else None
    if first is None:
        return True
    if first.islower():
        return False
    if after[1] or not re.fullmatch(rf"\.[{CLOSE}]*", m[0]):
        return True
    word = _LAST_WORD.search(t, begin, m.start())
    said = word[0] if word else ""
    if re.fullmatch(r"\d{1,3}", t[begin : m.start()].strip(BLANKS)) or said.lower() in TITLES or said.lower() in BEFORE_NUMBER and first.isdigit():
        return False
    if said.lower() == "ee" and t.startswith("UU", after.start(2)):
        return False
    if len(said) == 1 and said.isalpha():
        before = re.search(r"([^\W\d_]+)\s+$", t[begin : word.start()])
        initial = re.match(r"[^\W\d_]\.", t[after.start(2) : after.start(2) + 2])
        return not (said.islower() or first.isupper() and (initial or not before or before[1][0].isupper()))
    return True


def _clauses(t: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A long sentence cut next to its middle by ; : dashes or commas, else at blanks within HARD."""
    if b - a <= UNIT:
        yield a, b
        return
    for signs in (";", ":", "—–", ","):
        cuts = [m.end() for m in re.finditer(rf"[{signs}][{CLOSE}]*(?=\s)", t[a:b])]
        fit = [_span(t, a, a + c) + _span(t, a + c, b) for c in cuts]
        fit = [f for f in fit if f[1] - f[0] >= CLAUSE and f[3] - f[2] >= CLAUSE]
        if fit:
            best = min(fit, key=lambda f: abs(f[1] - (a + b) / 2))
            yield from _clauses(t, best[0], best[1])
            yield from _clauses(t, best[2], best[3])
            return
    while b - a > HARD:
        at = max((m.start() for m in re.finditer(r"\s", t[a + CLAUSE : a + HARD + 1])), default=HARD - CLAUSE) + a + CLAUSE
        yield _span(t, a, at)
        a = _span(t, at, b)[0]
    if a < b:
        yield a, b


def units(t: str) -> list[tuple[int, int, str]]:
    """Reading units: sentences, those over UNIT cut into clauses; none is empty or has blanks at its ends."""
    out = []
    for a, b in _lines(t):
        begin = a
        for m in _STOP.finditer(t, a, b):
            if m.start() >= begin and _ends(t, begin, m, b):
                out += _clauses(t, *_span(t, begin, m.end()))
                begin = _span(t, m.end(), b)[0]
        if begin < b:
            out += _clauses(t, *_span(t, begin, b))
    return [(a, b, t[a:b]) for a, b in out if b > a]


def _cut(t: str, a: int, b: int) -> int:
    """Where to cut before b: a paragraph, a sentence or a blank in the later half, else the next blank."""
    if b >= len(t):
        return len(t)
    half = a + (b - a) // 2
    if (at := t.rfind("\n\n", half + 1, b + 2)) > half:
        return at
    stops = [m.end() for m in re.finditer(r"[.!?…](?=\s|$)", t[half + 1 : b + 2])]
    if stops:
        return half + 1 + stops[-1]
    blanks = [m.start() for m in re.finditer(r"\s", t[half + 1 : b + 1])]
    if blanks:
        return half + 1 + blanks[-1]
    later = re.compile(r"\s").search(t, b)
    return later.start() if later else len(t)


def blocks(size: int) -> Callable[[str], list[tuple[int, int, str]]]:
    """Cutter into blocks of about `size` that tile the text exactly; a longer word stays whole."""

    def cut(t: str) -> list[tuple[int, int, str]]:
        out, a = [], 0
        while a < len(t):
            b = max(_cut(t, a, min(a + size, len(t))), a + 1)
            out.append((a, b, t[a:b]))
            a = b
        return out

    return cut


def _pack(parts: list[str], limit: int, glue: str) -> Iterator[str]:
    held = ""
    for p in parts:
        if held and len(held) + len(glue) + len(p) > limit:
            yield held
            held = p
        else:
            held = f"{held}{glue}{p}" if held else p
    if held:
        yield held


def paragraphs(limit: int = 3500) -> Callable[[str], list[tuple[int, int, str]]]:
    """Cutter that packs paragraphs up to the limit; a longer one is packed by sentences, which stay whole."""

    def cut(t: str) -> list[tuple[int, int, str]]:
        out, held = [], []
        for p in (p.strip("\n") for p in re.split(r"\n\s*\n", t.strip(BLANKS))):
            if len(p) > limit:
                out += [*_pack(held, limit, "\n\n"), *_pack([s.strip(BLANKS) for s in re.split(r"(?<=[.!?…])\s+", p)], limit, " ")]
                held = []
            elif p.strip(BLANKS):
                held.append(p)
        out += _pack(held, limit, "\n\n")
        return [(0, len(p), p) for p in out if p]

    return cut


def short(t: str, limit: int = 450, words: int = 400) -> list[tuple[int, int, str]]:
    """Sentences; those over the limit packed by words. Texts within the limit stay whole."""
    t = t.strip(BLANKS)
    parts = [t] if len(t) <= limit else [s for s in re.split(r"(?<=[.!?…])\s+", t)]
    out = [x for p in parts for x in ([p] if len(p) <= limit else _pack(p.split(), words, " "))]
    return [(0, len(p), p) for p in out if p]


def wrapped_lines(words: list[str], width: int) -> int:
    """Lines that the words take, wrapped one by one; a word wider than a line takes as many as it needs."""
    lines, at = (1, 0) if words else (0, 0)
    for w in words:
        if at and at + 1 + len(w) <= width or not at and len(w) <= width:
            at += len(w) + bool(at)
            continue
        lines += bool(at)
        lines, at = (lines + -(-len(w) // width) - 1, 0) if len(w) > width else (lines, len(w))
    return lines


def captions(width: int = 42, lines: int = 2) -> Callable[[str], list[tuple[int, int, str]]]:
    """Cutter into captions of at most `lines` lines: after a sentence in the later half, a clause in the
    later 40 %, else where it is full, without a dangling word at its end or a lone word left over."""
    stop, soft = re.compile(r"[.!?…][\"'”’)\]»]*$"), re.compile(r"[,;:–—][\"'”’)\]»]*$")
    loose = lambda w: not stop.search(w) and not soft.search(w) and re.sub(r"^[^\w]+|[^\w]+$", "", w.lower()) in DANGLING

    def cut(t: str) -> list[tuple[int, int, str]]:
        words, out, i = t.split(), [], 0
        while i < len(words):
            n = 1
            while i + n < len(words) and wrapped_lines(words[i : i + n + 1], width) <= lines:
                n += 1
            j = i + n - 1
            if j < len(words) - 1:
                late = lambda share: range(j, i + -(-int(n * share * 10) // 10) - 2, -1)  # noqa: B023, E731
                ends = [k for k in late(0.5) if k >= i and stop.search(words[k])] or [k for k in late(0.6) if k >= i and soft.search(words[k])]
                at = ends[0] if ends else j
                at -= len(words) - 1 - at == 1 and at > i
                if loose(words[at]):
                    back = next((k for k in range(at, i - 1, -1) if not loose(words[k])), None)
                    if back is not None and len(" ".join(words[i : back + 1])) >= 0.4 * width:
                        at = back
                j = at
            out.append(" ".join(words[i : j + 1]))
            i = j + 1
        return [(0, len(c), c) for c in out]

    return cut
