"""Language spans of mixed-language text.

Scripts narrow the candidates of a word to the languages seen with that script. A word's score in a
language is the mean log probability of its hashed character n-grams (and of the whole word) under
that language. Viterbi with a penalty for switching labels the words; runs of a label are the spans.
The model holds counts of LANGS x 2^BITS cells at most, so it can be broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import carried
from strandline.llm.minhash import mix

#: log2 of the n-gram cells of each language.
BITS = 16
#: Labelled documents the model is fitted on, at most (about; chosen by hash).
SAMPLE = 20_000
#: Languages that are learned, at most: their tables are what the driver and every worker hold.
LANGS = 200
#: Log-probability units that a change of language between two words costs.
SWITCH = 6.0
#: Letters of a word that count as evidence at most, so that one long string can't outvote its surroundings.
WORD_WEIGHT = 12
#: What a language loses in a word of a script that it was not seen with.
FOREIGN = 40.0
#: Words that a worker remembers before it starts anew.
MEMO = 300_000
#: Unicode script names that are told apart.
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Telugu", "Thai", "Hangul", "Hiragana", "Katakana", "Han", "Armenian", "Georgian", "Ethiopic", "Khmer"]
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SCRIPT = regex.compile("|".join(rf"(\p{{Script={s}}})" for s in SCRIPTS))
PREDICTED = "doc_id long, lang_pred string, score double, n_words long"
SPANS = "spans array<struct<start:int,end:int,lang:string>>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def cells_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, first): cells of the 2- to 4-grams (of UTF-16 units) of each padded word and of the whole
    word, one word after another; first is where each word's cells begin."""
    units = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-16-le"), "<u2").astype(np.uint64)
    size = np.array([len(w.encode("utf-16-le")) // 2 + 2 for w in words])
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(units))  # units from here to the word's end
    word = np.repeat(np.arange(len(words)), size)
    h, got, owner = np.zeros(len(units), np.uint64), [], []
    for n in (1, 2, 3, 4):
        h[: len(units) - n + 1] = (h[: len(units) - n + 1] + units[n - 1 :]) * _FACTOR + np.uint64(n)
        if n > 1:
            at = np.flatnonzero(left >= n)
            got.append(h[at])
            owner.append(word[at])
    place = (np.arange(len(units)) - np.repeat(end - size, size)).astype(np.uint64)
    got.append(np.add.reduceat(mix(units + place * _FACTOR), end - size))
    owner.append(np.arange(len(words)))
    cells, owner = mix(np.concatenate(got)) & np.uint64((1 << BITS) - 1), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return cells[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


def script_of(word: str) -> int:
    m = SCRIPT.match(word)
    return m.lastindex if m else 0


def viterbi(emit: np.ndarray) -> np.ndarray:
    """The best path's column in each row, a change of column costing SWITCH; ties stay, then take the first."""
    rows, score, came = emit.tolist(), emit[0].tolist(), []
    for e in rows[1:]:
        top = max(score)
        at, jump = score.index(top), top - SWITCH
        came.append([at if jump > s else j for j, s in enumerate(score)])
        score = [(jump if jump > s else s) + x for s, x in zip(score, e)]
    path = [score.index(max(score))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return np.array(path[::-1])


def best_path(emit: np.ndarray) -> np.ndarray:
    """viterbi(emit); at once where leaving the column with the largest sum cannot pay.

    Let a run's gain be what one other column adds to that column's sum over it. If no run gains
    SWITCH, a stay in other columns between or before rows of that column loses. A path that never
    visits it begins with one run at the text's start and ends with another at its end, so it loses too
    if these two gain less than SWITCH together.
    """
    one = int(emit.sum(axis=0).argmax())
    c = np.zeros((len(emit) + 1, emit.shape[1]))
    np.cumsum(emit - emit[:, one : one + 1], axis=0, out=c[1:])
    run = (c[1:] - np.minimum.accumulate(c[:-1], axis=0)).max()
    ends = c.max() + (c[-1] - c.min(axis=0)).max()
    if run < SWITCH and ends < SWITCH:
        return np.full(len(emit), one)
    return viterbi(emit)


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, scripts: np.ndarray):
        """logp: cells x languages; scripts: whether a language was seen with a script."""
        self.langs, self.logp, self.scripts = langs, logp, scripts
        self.narrow = [a.any() and not a.all() for a in scripts]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = 0
        self.emit = np.zeros((1024, len(self.langs)))
        self.size = np.zeros(1024)

    def learn(self, words: list[str]) -> None:
        """Scores of words not seen before, at most 0: mean log probability of their cells times their length."""
        cells, first = cells_of(words)
        size = np.array([len(w) for w in words], dtype=float)
        count = np.diff(np.r_[first, len(cells)])
        s = np.add.reduceat(self.logp.take(cells, axis=0), first, axis=0) * (np.minimum(size, WORD_WEIGHT) / count)[:, None]
        for k, w in enumerate(words):
            script = script_of(w) if ord(w[0]) > 591 else 1  # Latin letters lie below
            if self.narrow[script]:
                s[k] = np.where(self.scripts[script], s[k], s[k].max() - FOREIGN)
        s -= s.max(axis=1)[:, None]
        need = self.known + len(words)
        if need > len(self.size):
            more = max(need, 2 * len(self.size)) - len(self.size)
            self.emit, self.size = np.vstack([self.emit, np.zeros((more, len(self.langs)))]), np.r_[self.size, np.zeros(more)]
        self.emit[self.known : need], self.size[self.known : need] = s, size
        self.place.update(zip(words, range(self.known, need)))
        self.known = need

    def predict(self, texts: list[str | None], spans: bool = False) -> list[tuple]:
        """(language, share of letters, words[, spans]) of each text."""
        if self.known > MEMO:
            self._forget()
        low = [t.lower() if t and self.langs else "" for t in texts]
        found = [WORD.findall(t) for t in low]
        place = self.place
        if new := [w for w in dict.fromkeys(w for ws in found for w in ws) if w not in place]:
            self.learn(new)
        out = []
        for text, words in zip(low, found):
            if not words:
                out.append(("und", 0.0, 0, []) if spans else ("und", 0.0, 0))
                continue
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            path, size = best_path(self.emit[at]), self.size[at]
            letters = np.bincount(path, weights=size, minlength=len(self.langs))
            top = int(letters.argmax())
            row = self.langs[top], float(letters[top] / letters.sum()), len(words)
            out.append((*row, self._spans(text, path)) if spans else row)
        return out

    def _spans(self, text: str, path: np.ndarray) -> list[dict]:
        found = list(WORD.finditer(text))
        edge = np.flatnonzero(np.diff(path)) + 1
        ends = zip([0, *edge], [*edge, len(found)])
        return [{"start": found[a].start(), "end": found[b - 1].end(), "lang": self.langs[path[a]]} for a, b in ends]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on text and non-null lang of docs; at most about `sample` documents, taken by hash, and the LANGS most frequent languages of these."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = docs.where("lang is not null").count()
    if n > sample:
        share = int(sample / n * 1_000_000)
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    some = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()]
    known = known.where(F.col("lang").isin(some))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            for lang, found in words.items():
                c, s = seen.setdefault(lang, np.zeros(1 << BITS)), scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 1))
                if found:
                    cells, first = cells_of(list(found))
                    times = np.array(list(found.values()), dtype=float)
                    c += np.bincount(cells, weights=np.repeat(times, np.diff(np.r_[first, len(cells)])), minlength=1 << BITS)
                    s += np.bincount([script_of(w) for w in found], weights=times, minlength=len(SCRIPTS) + 1)
        for lang, c in seen.items():
            full = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(c[full])], ["lang", "cell", "n"]
            )
            s = np.flatnonzero(scripts[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(s), pa.string()), pa.array((-1 - s).astype(np.int32)), pa.array(scripts[lang][s])], ["lang", "cell", "n"]
            )

    got = known.mapInArrow(count, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((1 << BITS, len(langs)))
    scripts = np.zeros((len(SCRIPTS) + 1, len(langs)))
    for j, lang in enumerate(langs):
        g = got[got["lang"] == lang]
        pos = g["cell"] >= 0
        counts[g["cell"][pos], j] = g["n"][pos]
        scripts[-1 - g["cell"][~pos], j] = g["n"][~pos]
    p = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * (1 << BITS)) if langs else counts
    # a script counts for a language if it makes a thousandth of its words
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, np.log(p).astype(np.float32) if langs else p, share > 0.001)


def predict(docs: DataFrame, model: Model, spans: bool = False, carry: bool = False) -> DataFrame:
    """PREDICTED of every row: score is the share of letters in spans of lang_pred; with spans, SPANS too
    (character offsets in the lower-cased text). carry: the columns of docs come first, in place of doc_id.

    Null texts and texts without a letter are `und` with score 0, as is everything if no language was
    learned. Rows are independent, so repeated rows get equal values; very long texts are read whole;
    an empty table gives no rows; other columns are ignored unless carried.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.langs, model.logp, model.scripts))
    new = PREDICTED.split(", ", 1)[1] + (", " + SPANS if spans else "")
    names = [x.split()[0] for x in new.split(", ")]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                got = list(zip(*m.predict(texts[at : at + 512], spans)))
                part = b.slice(at, 512)
                old = [(n, part.column(n)) for n in (part.schema.names if carry else ["doc_id"])]
                made = [*zip(names, (pa.array(c, k) for c, k in zip(got, kinds)))]
                yield pa.RecordBatch.from_arrays([c for _, c in [*old, *made]], [n for n, _ in [*old, *made]])

    if carry:
        carried(docs, names)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, f"{fields}, {new}")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {new}")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
