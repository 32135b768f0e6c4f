"""Configuration packing, vector codes and prefix trie against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strandline.llm import config_packing, packing, prefix_trie, vector_codes
from strandline.llm.common import numbered

WORDS = P.path("word_bpe_49k.json")
_r = random.Random(8)
LONG = " ".join(_r.choice("stone River, Été über <|endoftext|> 12 ñandú 日本語 don't light\n of\tthe İx Σας ſ".split(" ")) for _ in range(6000))
TEXTS = ["", None, " \n\t ", "one two", "x" * 9000, LONG, LONG, LONG[:-40], "the the the", "😀 \x00 naïve\r\n\x1c\x85 z", "<|startoftext|>a", "'s 't's"]


def test_word_encoder_equals_library():
    t, encode = packing.tokenizer(WORDS), config_packing.word_encoder(WORDS)
    assert config_packing.word_ranks(__import__("json").loads(t.to_str()))
    assert config_packing.word_ranks(__import__("json").loads(packing.tokenizer(P.path("byte_bpe_50k.json")).to_str())) is None
    chars = [chr(c) for c in [*range(0x250), 0x301, 0x3A3, 0x3C2, 0x212A, 0x4E2D, 0x1F600]]
    texts = [x or "" for x in TEXTS] + ["".join(_r.choice(chars) for _ in range(_r.randint(1, 12))) for _ in range(3000)] + ["".join(_r.choice("abcdefghij'slmtvred .,<|>") for _ in range(14)) for _ in range(3000)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == e.ids


def best_fit(lengths, size):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [c for c in left if c >= n]
        if fit:
            left[left.index(min(fit))] -= n
        else:
            left.append(size - n)
    return len(left)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_no_worse_than_best_fit(seed):
    r = random.Random(seed)
    lengths = [min(512, max(1, int(r.lognormvariate(4, 1.2)))) for _ in range(2500)] + [37] * (1000 * (seed % 2))
    histogram = Counter(lengths)
    p = config_packing.plan(histogram, 512)
    taken = np.diff(np.append(p["first"], len(lengths)))
    got, room = Counter(), Counter()
    for n, k, first, copies, offset in zip(p["length"].tolist(), taken.tolist(), p["sequence"].tolist(), p["copies"].tolist(), p["offset"].tolist()):
        got[n] += k
        for q in range(-(-k // copies)):
            room[first + q] += n * copies
            assert offset + n * copies <= 512
    assert got == histogram and max(room.values()) <= 512
    assert -(-sum(lengths) // 512) <= len(room) <= best_fit(lengths, 512)


def test_plan_finds_configurations_that_best_fit_misses():
    histogram = {51: 600, 27: 600, 26: 600, 23: 1200}
    assert config_packing.plan(histogram, 100)["sequence"].size and best_fit([n for n, k in histogram.items() for _ in range(k)], 100) == 1100
    sequences = set()
    p = config_packing.plan(histogram, 100)
    for first, copies, k in zip(p["sequence"].tolist(), p["copies"].tolist(), np.diff(np.append(p["first"], 3000)).tolist()):
        sequences |= set(range(first, first + k // copies))
    assert len(sequences) == 900


def test_config_packing(spark):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(TEXTS)] + [(6, LONG, 1, "z"), (None, "no id", 1, "z")], "doc_id long, text string, _row int, length string").repartition(3)
    rows, t, want = config_packing.pack(docs, WORDS).collect(), packing.tokenizer(WORDS), []
    for i, text in [*enumerate(TEXTS), (6, LONG), (None, "no id")]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, k, s, len(x), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), 4096)) for x in [ids[s : s + 4096]]]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by) <= best_fit([r.length for r in rows], 4096)
    assert config_packing.pack(docs.limit(0), WORDS).count() == 0


def test_numbered_splits_equal_rows(spark):
    df = spark.createDataFrame([(i % 3 if i > 900 else 7, i) for i in range(1000)], "k int, i int").repartition(5)
    got = numbered(df, "k").orderBy("_row").collect()
    assert [r._row for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert max(Counter(r._part for r in got).values()) < 500


def plain_codes(rows, parts=8, entries=16, rounds=6):
    ok = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not ok:
        return []
    width = -(-max(len(v) for *_, v in ok) // parts) or 1
    q = [[int(np.floor(4096 * x)) for x in v] + [0] * (width * parts - len(v)) for *_, v in ok]
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for x in q]
    order = sorted(range(len(ok)), key=lambda k: (ok[k][0] is None, ok[k][0] or 0, ok[k][2]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    pick = lambda: [[min(range(len(b)), key=lambda e: (far(x[p], b[e]), e)) for p, b in enumerate(books)] for x in cut]
    for _ in range(rounds):
        codes = pick()
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [cut[k][p] for k in range(len(ok)) if codes[k][p] == e]:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    codes = pick()
    error = [sum(far(x[p], books[p][c]) for p, c in enumerate(code)) for x, code in zip(cut, codes)]
    total = Counter()
    for (_, label, _), e in zip(ok, error):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, bytes(c).hex(), e, total[label], digest) for (i, label, _), c, e in zip(ok, codes, error)]


@pytest.mark.parametrize("n", [0, 5, 300])
def test_vector_codes(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice(["a", "b", None]), [r.gauss(0, 1) for _ in range(24)]) for i in range(n)]
    if n > 100:
        rows[40:44] = [(3, "a", rows[3][2]), (3, "a", rows[4][2]), (None, "b", rows[5][2]), (44, None, [0.0] * 24)]
        rows += [(900, "a", None), (901, "a", [1.0, None]), (902, "a", [float("nan")] * 24), (903, "a", [float("inf")] * 24), (904, "a", []), (905, "c", [1.5] * 21), (906, None, [2.0e4] * 24), (907, "a", rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumn("q", F.lit("clash")).withColumn("_label", F.lit(1)).repartition(3)
    got = [tuple(x) for x in vector_codes.vector_codes(df).collect()]
    assert sorted(got, key=repr) == sorted(plain_codes(rows), key=repr)


def test_rounds_ship_changes_only(spark):
    state = spark.createDataFrame([([1, 2, 3, 4], bytearray([0, 1]), bytearray([0, 0])), ([5, 6, 7, 8], bytearray([1, 1]), bytearray([0, 1]))], "q array<int>, code binary, was binary").coalesce(1)
    got = {(r.slot, r.place): r.change for r in vector_codes.contributions(state, (2, 2, 2)).collect()}
    assert got == {(2, -1): -1, (2, 0): -3, (2, 1): -4, (3, -1): 1, (3, 0): 3, (3, 1): 4, (0, -1): -1, (0, 0): -5, (0, 1): -6, (1, -1): 1, (1, 0): 5, (1, 1): 6}


def plain_trie(rows):
    own: dict = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + said[h:]
    members: dict = {}
    for c, said in made.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    kids: dict = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = Counter(), Counter()
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1].encode()) if key else 0
    ends = {key: ",".join(str(c) for c in sorted(m) if len(made[c]) == len(key)) for key, m in members.items()}
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()]


@pytest.mark.parametrize("width", [4096, 3])
def test_prefix_trie(spark, monkeypatch, width):
    monkeypatch.setattr(prefix_trie, "SLICE", width)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    r, rows = random.Random(4), []
    for c in range(60):
        for turn in range(r.choice([1, 2, 9, 14])):
            rows.append((c, turn, r.choice(["user", None]), r.choice(["hello", "ä" * 3, "", None, f"t{r.randrange(3)}"])))
    rows += [(70, k, "user", f"long {k}") for k in range(120)] + [(c, k, "user", "same") for c in range(100, 130) for k in range(10)]
    rows += [(5, None, "user", "null turn"), (5, 0, "user", "tie"), (5, 0, "a", "tie"), (5, 0, "a", "tie"), (None, 1, "user", "no conversation"), (99, 1, "user", "only")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, depth int, a string").repartition(3)
    got = [tuple(x) for x in prefix_trie.prefix_trie(df).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)


def test_prefix_trie_of_little(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    rows = [(4, 0, "user", "x")] if zlib.crc32(b"4") % 9 else [(3, 0, "user", "x")]  # turnless: its first turns come from a conversation that isn't there
    assert [tuple(x) for x in prefix_trie.prefix_trie(spark.createDataFrame(rows, kind)).collect()] == plain_trie(rows)
