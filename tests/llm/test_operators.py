"""Dealt operators against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from strandline.llm import byte_bpe, embedding, langid, licenses, media, minhash, packing, sharding, token_counts, toxicity
from strandline.llm.common import connected_components

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
_r = random.Random(5)
BASE = " ".join(_r.choice("stone river, Été über <|endoftext|> 12 ñandú 日本語 \n light of the".split(" ")) for _ in range(3000))
TEXTS = ["", None, " \n\t ", "one two", "a  b\nc d", "x" * 9000, BASE, BASE, BASE[:-40], "Released under the MIT License.", "the the the the the the", "😀 \x00 naïve\r\n"]
EXTRA = "doc_id long, text string, n long, rep string, key int, hits string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, None, 2, "z") for i, t in enumerate(TEXTS)] + [(6, BASE, 1, None, 2, "z")]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_packing(docs, none):
    rows = packing.pack(docs, JSON).collect()
    t, want = tok(), []
    for i, text in [*enumerate(TEXTS), (6, BASE)]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, s, len(p), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), 2048) for p in [ids[s : s + 2048]]]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    for q in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == q), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(none, JSON).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = sorted((random.Random(1).randint(1, 100) for _ in range(500)), reverse=True)
    left, want = [], []
    for n in lengths:
        fit = [c for c in left if c >= n]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - n)
        else:
            left.append(100 - n)
        want.append(len(left))
    packer = packing.Packer(100)
    for n, windows in zip(lengths, want):
        packer.place(n)
        assert packer.windows == windows


def test_token_counts(docs, none, tmp_path):
    t = tok()
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [*enumerate(TEXTS), (6, BASE)])
    for _ in range(2):  # the second run reads every count from the cache
        got = token_counts.token_counts(docs, JSON, cache=f"file://{tmp_path}/cache").collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert docs.sparkSession.read.parquet(f"file://{tmp_path}/cache").count() == len({x or "" for x in TEXTS})
    assert token_counts.token_counts(none, JSON).count() == 0


def test_byte_bpe(docs, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_decode(docs, RANKS, P.PATTERN).collect()}
    for i, x in enumerate(TEXTS):
        ids = e.encode_ordinary(x or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    assert byte_bpe.encode_decode(none, RANKS, P.PATTERN).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, 30_000).collect()
    assert len(rows) == len(TEXTS) + 1
    size = {}
    for r in rows:
        size[r.shard_depth, r.shard_prefix] = size.get((r.shard_depth, r.shard_prefix), 0) + r.n_bytes
    for r in rows:
        assert r.shard_bytes == size[r.shard_depth, r.shard_prefix]
        assert r.oversized == (r.shard_bytes > 30_000)
    assert sharding.shard(none, 10).count() == 0


def test_minhash(docs, none):
    got = {r.doc_id: r for r in minhash.components(docs).collect()}
    assert got[0].n_shingles == got[1].n_shingles == got[2].n_shingles == 0
    assert got[3].n_shingles == got[10].n_shingles == 1
    assert {i: got[i].component_id for i in (5, 6, 7, 8)} == {5: 5, 6: 6, 7: 6, 8: 6}
    assert minhash.components(none).count() == 0


def test_minhash_without_ids_and_with_two_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, a), (None, a + " end"), (None, b), (7, b + " end"), (1, a.replace("a30", "x")), (None, None), (None, c), (20, c), (20, b), (30, "d " * 9), (30, None), (31, "")]
    got = minhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, 1), (None, 1), (1, 1), (None, 7), (7, 7), (None, 7), (20, 7), (20, 7), (None, None), (30, 30), (30, 30), (31, 31)]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    alone = minhash.components(spark.createDataFrame([(None, c), (None, c)], "doc_id long, text string")).collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in alone] == [(56, None, False)] * 2


def test_components_that_do_not_converge_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.component for r in connected_components(path).collect()} == {0}
    with pytest.raises(RuntimeError, match="converge"):
        connected_components(path, max_rounds=1)


def test_embedding(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[:100] + rng.normal(size=(100, 8)) * 0.1
    rows = [(i, [float(v) for v in r], i % 2 if i % 50 else None) for i, r in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, rows[3][1], 1), (304, [1.0], 1)]
    got = {r.vec_id: r for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if v and label is not None and np.isfinite(v).all() and any(v)}
    label = {i: c for i, _, c in rows}
    for i in label:
        n = sum(j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in unit) if i in unit else 0
        assert got[i].n_links == n
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_language_id_held_out(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(d.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert langid.predict(none, langid.fit(none.withColumn("lang", F.lit("en")))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, model).collect()} == {("und", 0.0)}


def test_media(docs, none):
    got = {r.doc_id: r for r in media.media_features(docs).collect()}
    for i, x in enumerate(TEXTS):
        raw = (x or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(p[-64:])
    assert got[6].feature == got[7].feature
    assert media.media_features(none).count() == 0


def test_licenses_against_every_window(docs, none):
    filler = " ".join(f"word{i % 97}" for i in range(700))
    cases = [f"{filler[:900]} {t} {filler}" for t in licenses.TEMPLATES.values()] + [filler, *TEXTS]
    s = licenses.Scanner(licenses.TEMPLATES)
    for text in cases:
        run, want = licenses.shingle_run(text), {}
        for k, t in s.sets.items():
            for x in range(0, max(1, -(-len(run) // len(t)))):
                share = len(np.intersect1d(run[x * len(t) : (x + 2) * len(t)], t)) / len(t)
                if share >= 0.75:
                    want[k] = max(want.get(k, 0), share)
        assert {k: c for k, _, c in s.scan(text, 0.75)} == want
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert got[9] == "MIT" and got[6] == "" and licenses.scan(none).count() == 0


def test_licenses_find_the_notices_of_the_tables(spark):
    notice = r"(?i)(?:released|licensed) under [^\n]*?(?:licen[sc]e(?:, version \d(?:\.\d)?)?|cc [a-z-]+ \d\.\d)\."
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.lower("text").contains("licens"))
    rows = d.select("doc_id", F.regexp_extract_all("text", F.lit(notice), F.lit(0)).alias("said")).collect()
    got = {r.doc_id: r.licenses for r in licenses.scan(d).collect()}
    known = {"cc by-nc": "CC-BY-NC-4.0", "mit license": "MIT", "apache": "Apache-2.0", "gnu general": "GPL-3.0"}
    assert len(rows) == len(got) == 262 and all(r.said for r in rows)
    for r in rows:
        assert got[r.doc_id] == ",".join(sorted({v for k, v in known.items() if k in " ".join(r.said).lower()}))


@pytest.mark.parametrize("family, text", [
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"), ("LGPL-2.1", "It is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "It is licensed under the GNU Affero General Public License, version 3."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"), ("ISC", "Released under the ISC License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"), ("Unlicense", "This is free and unencumbered software released into the public domain."),
])
def test_license_families(family, text):
    s = licenses.Scanner(licenses.TEMPLATES)
    found = [k for k, *_ in s.scan(f"some words before it. {text} and some words after it", 0.75)]
    assert any(k == family or k.startswith(family + "-") for k in found)


def test_license_full_texts():
    import re

    s = licenses.Scanner(licenses.TEMPLATES)
    for k in ("MIT", "ISC", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "MPL-1.1", "CC0-1.0", "Unlicense"):
        words = re.findall(r"\S+", licenses.TEMPLATES[f"{k}-text"])
        cut = " ".join(words[: len(words) * 9 // 10])  # without the last tenth
        assert f"{k}-text" in [x for x, *_ in s.scan(f"file header\n{cut}\nmore", 0.75)]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    assert [x for x, *_ in s.scan(gpl, 0.75)] == ["GPL-notice"]


def test_toxicity(spark, docs, none):
    rows = [(i, f"plain words number {i % 7} here" + (" you idiot and scum" if i % 5 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.fit(d, labels)
    assert {r.doc_id for r in toxicity.classify(d, chain).where("toxic").collect()} == {i for i in range(300) if i % 5 == 0}
    assert not any(r.toxic for r in toxicity.classify(docs, chain).collect())
    assert toxicity.classify(none, toxicity.fit(none, labels)).count() == 0


def test_encoder_equals_the_library():
    t, encode = tok(), packing.encoder(JSON)
    parts = ["'s", "'LL", "<|endoftext|>", "<|endoftext|", "  ", "\r\n", "\t", "\x85", "​", "é", "日本", "12", "²", "!?", "😀", "x" * 500, " " * 300, " a"]
    cases = ["".join(random.Random(i).choices(parts, k=40)) for i in range(300)]
    cases += ["".join(f"a{chr(c)}b 1{chr(c)}2  {chr(c)} !{chr(c)}?" for c in range(i, i + 64)) for i in range(0, 0x3000, 64)]
    assert all(encode(x) == t.encode(x, add_special_tokens=False).ids for x in cases)
    other = P.path("word_bpe_49k.json")
    assert len(packing.encoder(other)("plain words")) == 2
