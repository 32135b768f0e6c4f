"""Packing into as few sequences as possible by the configuration linear program.

A configuration is a set of piece lengths that fit one sequence. The program asks for the fewest sequences,
fractions allowed, whose configurations cover the histogram of lengths. It is solved by multiplicative weights: a
length's weight falls exponentially with the share of its pieces that is covered, a knapsack over the capacity
(dynamic programming) prices the best configuration through every length, and those through the least covered
lengths are raised. The fractional solution is then
rounded to whole sequences. The few pieces that rounding leaves, and pieces shorter than a 128th of a sequence, which
fit anywhere, are packed by best fit over the histogram into the room left and further sequences.

Only the histogram, one count for each length up to the capacity, reaches the driver, and the work there depends
on the capacity alone. Pieces are numbered in order of length by a range sort; a configuration's pieces are ranges
of these numbers, so a piece finds its sequence by its number.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, numbered, texts_of
from strandline.llm.packing import tokenizer

SIZE = 4096
#: How fast a length's weight falls with its coverage, and rounds of pricing at most.
RATE, PRICINGS = 1.0, 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def price(lengths: np.ndarray, weights: np.ndarray, size: int, jitter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over the lengths of positive weight, ascending: the best filling of every capacity, and the length
    (by index) that completes a total. Totals below the shortest length ahead depend on those before, so a block is done at once.
    jitter, which weighs less than a token, lets totals of equal weight be completed by different lengths."""
    use = np.flatnonzero(weights > 0)
    at, w = lengths[use], weights[use]
    exact, last = np.full(2 * size + 1, -np.inf), np.full(size + 1, -1)  # the first `size` stand for totals below 0
    exact[size] = 0
    if len(use):
        jitter = np.lib.stride_tricks.sliding_window_view(jitter, len(use))
        for c in range(int(at[0]), size + 1, int(at[0])):
            block = np.arange(c, min(c + int(at[0]), size + 1))
            k = np.searchsorted(at, block[-1], side="right")
            got = exact[size + block[:, None] - at[:k]] + (w[:k] + jitter[block, :k])
            j = got.argmax(1)
            exact[size + block], last[block] = got[np.arange(len(block)), j], use[j]
    exact = exact[size:]
    top = np.maximum.accumulate(exact)
    return np.maximum.accumulate(np.where(exact == top, np.arange(size + 1), 0)), last


def fractional(lengths: np.ndarray, counts: np.ndarray, size: int) -> dict[tuple, float]:
    """Configurations, as ((index, copies), ...), with the fractional number of sequences of each.

    A configuration is raised until one of its lengths is covered. The fullest come first; what leaves more room is
    let in when nothing else is left. If PRICINGS rounds don't cover all, best fit packs the rest."""
    covered, solution = np.zeros(len(lengths)), {}
    rng, room = np.random.default_rng(size), size // 1024
    for _ in range(PRICINGS):
        if not len(behind := np.flatnonzero(covered < 1 - 1e-9)):
            break
        weights = np.where((covered < 1 - 1e-9) & (lengths <= size // 2), lengths * np.exp(-RATE * covered), 0)
        filled, last = price(lengths, weights, size, rng.random(2 * size + 1))
        empty, used = size - lengths[behind] - filled[size - lengths[behind]], 0
        for i in behind[np.lexsort((-lengths[behind], empty))][: int((empty <= room).sum())].tolist():
            made, c = {i: 1}, int(filled[size - lengths[i]])
            while c > 0:
                j = int(last[c])
                made[j] = made.get(j, 0) + 1
                c -= int(lengths[j])
            if (by := min((1 - covered[j]) * counts[j] / a for j, a in made.items())) <= 1e-9:
                continue
            for j, a in made.items():
                covered[j] += by * a / counts[j]
            key = tuple(sorted(made.items()))
            solution[key] = solution.get(key, 0.0) + by
            used += 1
        if not used:
            room = 2 * room + 1
    return solution


def rounded(solution: dict[tuple, float], counts: np.ndarray) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Whole numbers of sequences, fractions handed on from one configuration to the next, and the counts that are left."""
    left, taken, carry = counts.copy(), [], 0.0
    for made, x in sorted(solution.items(), key=lambda s: -s[1]):
        want = x + carry
        n = min(int(want + 1e-9), *(int(left[j] // a) for j, a in made))
        carry = min(want - n, 1.0)
        if n:
            taken.append((made, n))
            for j, a in made:
                left[j] -= n * a
    return taken, left


def best_fit(lengths: np.ndarray, counts: np.ndarray, size: int, taken: list[tuple[tuple, int]]) -> list[tuple[tuple, int]]:
    """Best fit decreasing over a histogram: windows of equal contents are one entry. Room in the sequences of taken is used first."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    for made, n in taken:
        open_.setdefault(size - sum(int(lengths[j]) * a for j, a in made), []).append((made, n))
    rooms = sorted(open_)

    def put(room: int, made: tuple, n: int) -> None:
        if n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((made, n))

    for j in np.argsort(-lengths, kind="stable"):
        n, size_j = int(counts[j]), int(lengths[j])
        while n:
            at = bisect_left(rooms, size_j)
            room, made, windows = size, (), -(-n // (size // size_j))
            if at < len(rooms):
                room = rooms[at]
                made, windows = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            fit = room // size_j
            full = min(windows, n // fit)
            put(room - fit * size_j, (*made, (int(j), fit)), full)
            n, windows = n - full * fit, windows - full
            if n and windows:
                put(room - n * size_j, (*made, (int(j), n)), 1)
                n, windows = 0, windows - 1
            put(room, made, windows if made else 0)
    return [w for group in open_.values() for w in group]


def plan(histogram: dict[int, int], size: int = SIZE) -> dict[str, np.ndarray]:
    """Ranges of piece numbers, counted from the longest piece on: first number, first sequence, copies in a sequence, length, offset."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.int64)
    sand = int(np.searchsorted(lengths, size // 128))
    taken, left = rounded({tuple((j + sand, a) for j, a in made): x for made, x in fractional(lengths[sand:], counts[sand:], size).items()}, counts)
    next_ = dict(zip(range(len(lengths)), (counts.sum() - np.cumsum(counts)).tolist()))
    rows, sequence = [], 0
    for made, n in best_fit(lengths, left, size, taken):
        offset = 0
        for j, a in made:
            rows.append((next_[j], sequence, a, int(lengths[j]), offset))
            next_[j] += n * a
            offset += a * int(lengths[j])
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("first", "sequence", "copies", "length", "offset"), table.T))


#: White space by which a text is split before encoding; letters of a word that is kept with its ids, and words kept.
BLANK, KEPT_CHARS, KEPT = re.compile("[ \t\r\n]+"), 64, 200_000
#: The pattern of such a tokenizer, here without what its first alternatives are in plain words, and the words it is used for:
#: ASCII and the composed letters of two Latin blocks, for which composing, lower case and white space are the same everywhere.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LATIN = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = re.compile("[\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u012f\u0131-\u017f]*")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\t-\r 0-9{LATIN}]+")


def vocabulary(ids: dict[str, int]) -> dict[bytes, int]:
    """Tokens as bytes: byte-level letters decoded, the end of a word written b"\xff"."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ended = {t: t.endswith("</w>") and len(t) > 4 for t in ids}
    return {bytes(letter[c] for c in (t[:-4] if end else t)) + b"\xff" * end: ids[t] for t, end in ended.items() if all(c in letter for c in t)}


def word_ranks(spec: dict) -> dict[bytes, int] | None:
    """Merge ranks, keyed by bytes, of a tokenizer that lower-cases, drops white space and marks the ends of words; else None.

    A word's last byte and the mark b"\xff" merge first, which gives the alphabet of word ends."""
    model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if kinds != ["NFC", "Replace", "Lowercase"] or split[0].get("pattern") != {"Regex": SPLIT} or model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>":
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [a + b for a, b in pairs]
    if len(set(made)) < len(made):
        return None
    merged = {t: raw for raw, t in zip(vocabulary(dict.fromkeys(made, 0)), made)}
    tokens = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(255)] + [merged[t] for t in made]
    return {t: k for k, t in enumerate(tokens)} if len(set(tokens)) == len(tokens) else None


def word_encoder(path: str):
    """Function from a text to its ids (an array), equal to the tokenizers library's, for a tokenizer that drops white space
    and whose tokens don't reach over it.

    Each distinct run without white space is encoded once: those of up to KEPT_CHARS letters are remembered, KEPT at a time.
    Plain words are merged by tiktoken from the file's ranks; all others are left to the tokenizers library."""
    t = tokenizer(path)
    ranks, merge, ids = word_ranks(json.loads(t.to_str())), None, np.arange(t.get_vocab_size(), dtype="<u4")
    code = {i: i for i in range(len(ids))}  # what is remembered for an id: a rank where there are ranks
    if ranks:
        import tiktoken

        merge = tiktoken.Encoding(path, pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        of = {ranks[raw]: i for raw, i in vocabulary(t.get_vocab()).items() if raw in ranks}
        rest = sorted(set(range(len(ids))) - set(of.values()))
        ids = np.array([*(of.get(k, 0) for k in range(len(ranks))), *rest], dtype="<u4")
        code = {i: k for k, i in of.items()} | {i: len(ranks) + k for k, i in enumerate(rest)}

    def library(words: list[str]) -> list[bytes]:
        return [array("I", [code[i] for i in e.ids]).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False)]

    class Known(dict):
        """What plain words are merged to, each when it first comes up."""

        def __missing__(self, word: str) -> bytes:
            if len(word) > KEPT_CHARS:
                return library([word])[0]
            parts = [word] if word.isalpha() else PIECE.findall(word)
            self[word] = found = array("I", [k for p in parts for k in merge(p.encode() + b"\xff")]).tobytes()
            return found

    plain, other = Known(), {}

    def encode(text: str) -> np.ndarray:
        if merge is not None and "<|" not in text and PLAIN.fullmatch(text):
            if len(plain) > KEPT:
                plain.clear()
            found = map(plain.__getitem__, text.lower().split())
        else:
            words = BLANK.split(text)
            if len(other) > KEPT:
                other.clear()
            new = list(set(words).difference(other))
            got = dict(zip(new, library(new)))
            other.update((w, i) for w, i in got.items() if len(w) <= KEPT_CHARS)
            found = (got[w] if w in got else other[w] for w in words)
        return ids[np.frombuffer(b"".join(found), dtype=np.uint32)]

    return encode


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """The pieces of each document with the checksum of their ids: full sequences and a shorter last one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                a = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                for s in range(0, len(a), size):
                    p = a[s : s + size]
                    for col, v in zip(out, (doc, s // size, s, len(p), zlib.crc32(p.tobytes()))):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """Packs documents(doc_id, text); one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; pieces of equal
    length are taken by doc_id and piece. Very long texts are cut into full sequences. Other columns are ignored.
    An empty table gives no rows."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, size, end_id))
    histogram = {n: k for n, k in cut.groupBy("length").count().collect()}  # a row for each length up to size
    ranges = spark.sparkContext.broadcast(plan(histogram, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranges.value
        for b in batches:
            row = b.column("_row").to_numpy(zero_copy_only=False)
            at = np.searchsorted(r["first"], row, side="right") - 1
            past = row - r["first"][at]
            sequence, offset = r["sequence"][at] + past // r["copies"][at], r["offset"][at] + past % r["copies"][at] * r["length"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    rows = numbered(cut, F.desc("length"), "doc_id", "piece")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "_row").mapInArrow(place, PIECES + ", sequence_id long, offset long")
