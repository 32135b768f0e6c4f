"""Exact byte-level BPE in linear time.

All tokens are put into one automaton over Latin-1 strings (one character per byte). A text piece is
encoded by taking the longest token at the current position and going back to shorter ones while the
last two tokens cannot stand side by side in a BPE result. Whether two tokens can is decided from the
merge that made each of them, and memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import texts_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Encoded pieces that a worker remembers before it starts anew.
MEMO = 400_000
#: Letters of the longest piece that is remembered, and pairs of tokens.
MEMO_CHARS, PAIRS = 64, 4_000_000
_CODERS: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.rank_of = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.text_of = {i: t for t, i in self.rank_of.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank_of.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.memo: dict[str, list[int]] = {}
        for t, i in self.rank_of.items():
            self.shorter[i] = next((r for n in range(len(t) - 1, 0, -1) if (r := self.rank_of.get(t[:n])) is not None), None)
        self.reachable = {i for t, i in self.rank_of.items() if len(t) == 1}
        for i in self.reachable:
            self.split[i] = (i, i)
        for t, i in sorted(self.rank_of.items(), key=lambda x: x[1]):
            if len(t) > 1:
                self._learn(t, i)

    def _learn(self, text: str, token: int) -> None:
        """Finds the two tokens of lower rank that merge into this one."""
        left = self.shorter[token]
        while left is not None:
            right = self.rank_of.get(text[len(self.text_of[left]) :])
            if left in self.split and right in self.split and left < token > right and self.fits(left, right):
                self.split[token] = (left, right)
                self.merged[left, right] = token
                self.reachable.add(token)
                self.compatible.clear()
                return
            left = self.shorter[left]

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge would join bytes across the border of the two tokens."""
        if (known := self.compatible.get((left, right))) is not None:
            return known
        a, b, limit, merged, split, ok = left, right, 1 << 62, self.merged, self.split, None
        while ok is None:
            joint = merged.get((a, b))
            if joint is not None and joint < limit:
                ok = False
            elif a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        ok = True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        ok = True
        self.compatible[left, right] = ok
        return ok

    def _longest(self, text: str) -> list[int | None]:
        """The longest reachable token that starts at each position."""
        best: list[int | None] = [None] * len(text)
        for end, token in self.automaton.iter(text):
            start = end + 1 - len(self.text_of[token])
            if token in self.reachable and (best[start] is None or len(self.text_of[best[start]]) < end + 1 - start):
                best[start] = token
        return best

    def _shorter(self, token: int) -> int | None:
        token = self.shorter[token]
        while token is not None and token not in self.reachable:
            token = self.shorter[token]
        return token

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1."""
        if (whole := self.rank_of.get(piece)) is not None:
            return [whole]
        best, n, text_of = self._longest(piece), len(piece), self.text_of
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, best[0]
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + len(text_of[token])
                if not dead[end] and (last is None or self.fits(last, token)):
                    out.append(token)
                    at, token = end, best[end] if end < n else None
                    break
                token = self._shorter(token)
                if token is None:
                    dead[at] = 1
                    token = out.pop()
                    at -= len(text_of[token])
                    last = out[-1] if out else None
                    token = self._shorter(token)
                    while token is None and out:
                        dead[at] = 1
                        token = out.pop()
                        at -= len(text_of[token])
                        token = self._shorter(token)
                    last = out[-1] if out else None
                    if token is None:
                        raise ValueError("the vocabulary lacks single bytes")
        return out

    def encode(self, text: str) -> list[int]:
        memo, found = self.memo, self.pattern.findall(text)
        if len(memo) > MEMO:
            memo.clear()
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        long = []
        for piece in found:
            if piece not in memo:
                memo[piece] = self.encode_piece(piece.encode().decode("latin-1"))
                if len(piece) > MEMO_CHARS:
                    long.append(piece)
        ids = list(chain.from_iterable(map(memo.__getitem__, found)))
        for piece in long:
            del memo[piece]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every row of documents(doc_id, text).

    Null text is empty: no ids, digests of nothing. Rows are independent, so repeated rows, ties and
    empty tables need no special care; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            n, ids_sha, decoded = [], [], []
            for text in texts_of(b):
                ids = c.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
