"""Packing of documents into sequences of a fixed number of tokens, best fit decreasing.

Documents are tokenised where they are read. Overlong documents are cut into full windows first;
the remainders of a hash partition are sorted by length, longest first, and each goes to the open
window with the least remaining capacity that still holds it. A segment tree over the remaining
capacities finds that window in log2(capacity) steps. Only (id, length) rows are shuffled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import partitions, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


#: Fixed value: the pattern by which byte-level tokenizers split text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Merge ranks and special tokens of a tokenizer that is plain byte-level BPE, else None.

    Plain: no normalizer or prefix, merges in the order of the ids they make, added tokens that take
    nothing around them. Then merging by rank gives the same ids.
    """
    model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(a[k] for a in added for k in ("lstrip", "rstrip", "single_word")):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {a["content"]: a["id"] for a in added}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(set(made)) or len(made) + 256 != len(vocab) or any(len(t) == 1 and i > made[0] for t, i in vocab.items()):
        return None
    return {bytes(letter[c] for c in t): i for t, i in vocab.items()}, special


def encoder(path: str):
    """Function from a text to its ids, equal to those of the tokenizers library.

    Plain byte-level BPE is encoded from the file's ranks by tiktoken, which is five times as fast;
    texts with very long runs of blanks, and every other file, by the tokenizers library itself.
    """
    if (path, "ids") not in _TOKENIZERS:
        t = tokenizer(path)
        if got := byte_ranks(json.loads(t.to_str())):
            import tiktoken

            fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=got[0], special_tokens=got[1])

            def ids(text: str) -> list[int]:
                if LONG_BLANK.search(text):  # tiktoken's pattern gives up on these
                    return t.encode(text, add_special_tokens=False).ids
                return fast.encode(text, allowed_special="all")

            _TOKENIZERS[path, "ids"] = ids
        else:
            _TOKENIZERS[path, "ids"] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _TOKENIZERS[path, "ids"]


#: Runs of blanks that are left to the tokenizers library.
LONG_BLANK = re.compile(r"\s{10000}")


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a node counts the open windows below it."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node, count = capacity + self.base, self.count
        while node:
            count[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (window, capacity) of the tightest window with capacity >= length."""
        node, count = length + self.base, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.base
        self._change(capacity, -1)
        return self.open[capacity].pop(), capacity


class Packer:
    """Best fit for pieces that come longest first, none above size; holds the open windows only."""

    def __init__(self, size: int):
        self.size, self.tree, self.windows = size, CapacityTree(size), 0

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset of the next piece; a full window needs no search."""
        if length < self.size and (got := self.tree.take(length)):
            window, capacity = got
        else:
            window, capacity = self.windows, self.size
            self.windows += 1
        if capacity > length:
            self.tree.add(capacity - length, window)
        return window, self.size - capacity


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Full windows and remainders of each document with the checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for at in range(0, len(ids), 64):
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(ids[at : at + 64], texts[at : at + 64]):
                    a = np.array([*encode(text), end_id], dtype="<u4")
                    for s in range(0, len(a), size):
                        p = a[s : s + size]
                        for col, v in zip(out, (doc, s, len(p), zlib.crc32(p.tobytes()), len(a))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], PIECES.replace(" long", "").split(", "))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs documents(doc_id, text); one row per piece, see PACKED.

    Null and empty texts are the end id alone; very long texts are cut into windows. Repeated rows are packed as often as they occur, ties
    in length are ordered by doc_id and start. Other columns are ignored. An empty table gives no
    rows. The partition of a piece is a hash of its id, start and place in the input, so lost tasks are recomputed alike and no id fills one.
    """
    parts = partitions(docs.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(size), TaskContext.get().partitionId() << 40
        for b in batches:
            placed = np.array([packer.place(n) for n in b.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
            columns = [*b.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "sequence_id", "offset"])

    # rows without an id and rows that repeat one are told apart by the place where they were read
    dealt = pieces(docs, path, size, end_id).withColumn("salt", F.xxhash64("doc_id", "start", F.monotonically_increasing_id()))
    dealt = dealt.repartition(parts, "salt").sortWithinPartitions(F.desc("length"), "doc_id", "start", "salt").drop("salt")
    return dealt.mapInArrow(fill, PACKED)
