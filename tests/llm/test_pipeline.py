"""The pipeline against a plain version, stage by stage, on rows with nulls, repeats and copies."""

import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from strandline.llm import langid, minhash, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def near_copies_plain(rows):
    """Rows that stay, by comparing all pairs of texts."""
    texts = sorted({r[1] for r in rows if r[1] and r[1].split()})
    sets = [set(minhash.shingles(t.encode()).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    group, best = dict(zip(texts, label)), {}
    for r in rows:
        if r[1] in group:
            key = (r[0] is None, r[0] or 0, zlib.crc32(b"") if r[1] is None else __import__("hashlib").md5(r[1].encode()).hexdigest())
            if group[r[1]] not in best or key < best[group[r[1]]][0]:
                best[group[r[1]]] = key, r
    return [r for r in rows if r[1] not in group] + [r for _, r in best.values()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = rows_of(docs)
    long = max((r for r in first if r[1]), key=lambda r: len(r[1]))
    odd = [(None, long[1], *long[2:]), (long[0], long[1], *long[2:]), (long[0], None, *long[2:]), (900_001, None, *long[2:]), (900_002, " \n", *long[2:]), (900_003, long[1] + " end", *long[2:])]
    docs = spark.createDataFrame([*first, *odd], docs.schema).repartition(3)

    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = rows_of(corpus_pipeline.drop_toxic(spark, docs, SF))
    want = [r for r in rows_of(docs) if chain.scores(chain.rows.hits(r[1]))[-1] < toxicity.THRESHOLD]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 0 < len(got) < docs.count()

    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    got = rows_of(corpus_pipeline.keep_language(spark, docs, SF))
    said = {t: model.predict([t])[0] for t in {r[1] for r in rows_of(docs)}}
    assert sorted(got, key=repr) == sorted((r for r in rows_of(docs) if said[r[1]][0] != "und" and said[r[1]][1] >= 0.5), key=repr)

    got = rows_of(corpus_pipeline.drop_near_copies(spark, docs, SF))
    assert sorted(got, key=repr) == sorted(near_copies_plain(rows_of(docs)), key=repr)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    """Every document left by the plain chain is packed whole, and no other."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = [r for r in rows_of(docs) if chain.scores(chain.rows.hits(r[1]))[-1] < toxicity.THRESHOLD]
    df = spark.createDataFrame(left, docs.schema)
    model = langid.fit(df.where(~langid.held_out(df["doc_id"])))
    left = [r for r in left for lang, score, _ in model.predict([r[1]]) if lang != "und" and score >= 0.5]
    left = near_copies_plain(left)
    t, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for doc, text, *_ in left:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(doc, s, len(p), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), 2048) for p in [ids[s : s + 2048]]]
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_viterbi_against_every_path():
    rng = np.random.default_rng(2)
    for _ in range(300):
        emit = -rng.exponential(4, size=(rng.integers(1, 7), 3))
        best = max(
            (sum(emit[i, p[i]] for i in range(len(p))) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:])), p)
            for p in np.ndindex(*[3] * len(emit))
        )[0]
        path = langid.best_path(emit)
        assert abs(emit[np.arange(len(emit)), path].sum() - langid.SWITCH * np.count_nonzero(np.diff(path)) - best) < 1e-9
    for _ in range(50):
        emit = -rng.exponential(3, size=(200, 4)) - 0.8 * (np.arange(4) != 1)
        assert (langid.best_path(emit) == langid.viterbi(emit)).all()


def test_chain_against_a_plain_version(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.fit(d, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in d.collect():
        have, p = toxicity.all_features(r.text), []
        for w in chain.weights:
            z = sum(w[i] for i, f in enumerate(chain.names) if f in have) + sum(a * b for a, b in zip(w[len(chain.names) :], p)) + w[-1]
            p.append(1 / (1 + np.exp(-z)))
        assert np.allclose(chain.scores(chain.rows.hits(r.text)), p)
