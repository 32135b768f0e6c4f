"""Cases that the general tests of the subpackage leave out: very long runs, shared and damaged chunks, repeated ids."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.llm import embedding, langid, media, minhash, packing, token_counts, toxicity

JSON = P.path("byte_bpe_50k.json")


def test_encoder_on_very_long_runs():
    t, encode = packing.tokenizer(JSON), packing.encoder(JSON)
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + "\t " * 200_000 + "b", "ab" * 50_000, "!" * 50_000, "word " * 50_000):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_second_run_encodes_nothing(spark, tmp_path, monkeypatch):
    docs, cache = spark.createDataFrame([(1, "one"), (2, "two two"), (3, "one"), (4, None)], "doc_id long, text string"), f"file://{tmp_path}/c"
    first = sorted(map(tuple, token_counts.token_counts(docs, JSON, cache=cache).collect()))
    monkeypatch.setattr(token_counts, "_counter", lambda path: lambda texts: [-1 for _ in texts])
    again = sorted(map(tuple, token_counts.token_counts(docs, JSON, cache=cache).collect()))
    assert again == first and spark.read.parquet(cache).count() == 3
    more = docs.unionByName(spark.createDataFrame([(5, "new")], docs.schema))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, JSON, cache=cache).collect()}[5] == -1


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = next((p for p in map(P.path, P.names()) if p.endswith(".model")), None) if hasattr(P, "names") else None
    if path is None:
        pytest.skip("no .model file is listed")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(spark.createDataFrame([(1, "a few plain words"), (2, None)], "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(model.encode("a few plain words")), 2: 0}


def _long(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(map(str, r.integers(0, 10**9, n)))


def test_media_store(spark, tmp_path):
    shared = _long(1, 6000)
    texts = [_long(2, 50) + shared + _long(3, 60), _long(4, 900) + shared + _long(5, 10), "short", None, "short"]
    docs, path = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), f"{tmp_path}/store"
    got = {r.doc_id: r for r in media.media_features(docs, f"file://{path}").collect()}
    for i, t in enumerate(texts):
        stored = media.wav(media.payload_of((t or "").encode()))
        assert (got[i].media_bytes, got[i].media_sha256, got[i].feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(media.payload_of((t or "").encode())))
    files = pq.read_table(path).to_pylist()
    chunks = [c for f in files for c in f["chunks"]]
    digests = {c["digest"] for c in chunks}
    held = [c["digest"] for c in chunks if c["data"] is not None]
    assert len(files) == 4 and len(chunks) > len(digests) and sorted(held) == sorted(digests)  # each chunk once, some shared
    bad = spark.read.parquet(f"file://{path}").withColumn("chunks", F.transform("chunks", lambda c: c.withField("digest", F.unhex(F.sha2(c["digest"], 256)))))
    bad.write.parquet(f"file://{tmp_path}/bad")
    spark.read.parquet(f"file://{path}/{media.WORDS}").write.parquet(f"file://{tmp_path}/bad/{media.WORDS}")
    with pytest.raises(Exception, match="damaged"):
        media.read_back(spark, f"file://{tmp_path}/bad").count()


def test_cuts_against_a_plain_rolling_hash():
    data = _long(6, 9000).encode()
    h, marks = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - media.MEAN_BITS) == 0:
            marks.append(i + 1)
    want, last = [], 0
    while len(data) - last > media.MIN:
        last = min(next((m for m in marks if m >= last + media.MIN), len(data)), last + media.MAX, len(data))
        want.append(last)
    assert media.cuts(data) == (want if want[-1] == len(data) else [*want, len(data)])


def test_vectors_with_repeated_ids(spark):
    e = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, e[0], 1), (1, e[1], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 1), (4, [0.0, 1.0, 0.01], 1), (None, e[0], 1), (5, [float("inf"), 1.0, 0.0], 1), (6, e[0], 2), (7, e[0], None)]
    got = embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    ones = sorted((r.n_links, r.component_id) for r in got if r.vec_id == 1)
    assert ones == [(2, 1), (2, 1)]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id not in (1,)} == {2: (2, 1, False), 3: (2, 1, False), 4: (2, 1, False), None: (2, 1, False), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True)}


def test_vectors_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "LEAF", 64)
    r = np.random.default_rng(8)
    x = r.normal(size=(700, 6))
    x[350:] = x[:350] + r.normal(size=(350, 6)) * 0.12
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    label = np.arange(700)
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(700)}


def test_order_of_rows_does_not_matter(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")
    rows = [(5, a), (5, b), (7, a + " x"), (8, b + " y"), (9, "z " * 30)]
    want = None
    for turn in range(3):
        df = spark.createDataFrame(rows[turn:] + rows[:turn], "doc_id long, text string").repartition(turn + 1)
        got = sorted((r.doc_id, r.component_id) for r in minhash.components(df).collect())
        want = want or got
        assert got == want == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_words_across_the_blocks_of_a_long_text(monkeypatch):
    data = (_long(9, 400) + " \t" + "é" * 300 + "\n" + _long(10, 400)).encode()
    whole = minhash.word_hashes(data)
    monkeypatch.setattr(minhash, "TEXT_BYTES", 97)
    assert (minhash.word_hashes(data) == whole).all() and len(whole) == len(data.split())


def test_language_of_repeated_and_carried_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(d)
    long = " ".join(r.text for r in d.where("lang = 'fr'").limit(20).collect() if r.text) * 3
    df = spark.createDataFrame([(1, "x", long), (1, "x", long), (None, "y", None)], "doc_id long, extra string, text string")
    got = langid.predict(df, model, spans=True, carry=True).collect()
    assert [r.lang_pred for r in got if r.extra == "x"] == ["fr", "fr"] and got[0].spans == got[1].spans and {r.extra for r in got} == {"x", "y"}
    for s in got[0].spans:
        assert 0 <= s["start"] < s["end"] <= len(long)
    with pytest.raises(ValueError):
        langid.predict(df.withColumn("score", F.lit(1)), model, carry=True)


def test_toxicity_on_a_very_long_text(spark):
    rows = [(i, "plain words here" + (" idiot" if i % 4 == 0 else "")) for i in range(200)]
    chain = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    df = spark.createDataFrame([(1, "plain words here " * 200_000), (2, "idiot " * 200_000), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.toxic for r in toxicity.classify(df, chain).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_survivors_keep_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", "a", 1, "x"), (2, "one two three four five six", "b", 2, "y"), (3, None, "c", 3, "z")]
    kept = minhash.survivors(spark.createDataFrame(rows, "doc_id long, text string, _mark string, _id int, _row string"))
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]] and kept.columns == ["doc_id", "text", "_mark", "_id", "_row"]


@pytest.mark.parametrize("kind", ["double", "string", "long", "array<int>"])
def test_labels_of_any_type(spark, kind):
    values = {"double": (0.2, 0.7, -0.0, 0.0), "string": ("a", "b", "c", "c"), "long": (1 << 40, (1 << 40) + 1, 7, 7), "array<int>": ([1], [2], [], [])}[kind]
    rows = [(i, v, [1.0, 0.0, 0.0]) for i, v in enumerate(values)] + [(9, None, [1.0, 0.0, 0.0])]
    got = embedding.near_vectors(spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 2), 9: (0, 9)}


def test_vectors_of_several_widths(spark):
    r = np.random.default_rng(2)
    rows = [(i, 1, r.normal(size=8 if i < 40 else 3 if i < 60 else 12).tolist()) for i in range(80)]
    rows += [(100 + i, 1, [2 * x for x in v]) for i, _, v in rows[::9]]
    got = {x.vec_id: x.component_id for x in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    for k, (i, _, _) in enumerate(rows[:80:9]):
        assert got[100 + i] == got[i]


def test_store_is_read_by_its_path_alone(spark, tmp_path):
    texts = [f"{_long(k, 40)} word word word {k % 7}" for k in range(400)]
    docs, path = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/dictionary-store"
    words = media.dictionary(docs)
    assert words and words == media.dictionary(docs.repartition(7))
    media.store(docs, path, words)
    got = {bytes(r.file): bytes(r.payload_sha256) for r in media.read_back(spark, path).collect()}
    assert got == {hashlib.sha256(t.encode()).digest(): hashlib.sha256(media.payload_of(t.encode())).digest() for t in texts}


def test_cache_by_version_in_lots_and_compacted(spark, tmp_path):
    docs, cache = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)] + [(None, "text 1"), (None, None)], "doc_id long, text string"), f"file://{tmp_path}/lots"
    plain = sorted(map(tuple, token_counts.token_counts(docs, JSON).collect()), key=repr)
    assert sorted(map(tuple, token_counts.token_counts(docs, JSON, cache=cache, batches=3).collect()), key=repr) == plain
    assert spark.read.parquet(cache).count() == 6  # later lots found what earlier ones had stored
    other = P.path("word_bpe_49k.json")
    token_counts.token_counts(docs, other, cache=cache).collect()
    token_counts.compact(spark, cache, JSON)
    assert len(spark.read.parquet(cache).where(f"version = '{token_counts.version_of(JSON)}'").inputFiles()) <= 4
    assert sorted(map(tuple, token_counts.token_counts(docs, JSON, cache=cache).collect()), key=repr) == plain and spark.read.parquet(cache).count() == 12


def test_one_id_does_not_fill_a_partition(spark):
    docs = spark.createDataFrame([(None, f"word {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, JSON).collect()
    assert len(rows) == 400 and len({r.sequence_id >> 40 for r in rows}) == 4


def test_repeated_labelled_ids_count_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.sample_rows(docs, labels, 100).collect())) == [(1, "text 0", 1), (2, "other", 0)]


def test_languages_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", 2)
    docs = spark.createDataFrame([(i, "alpha beta gamma", "aa") for i in range(9)] + [(20 + i, "delta epsilon zeta", "bb") for i in range(8)] + [(40, "junk", "cc")], "doc_id long, text string, lang string")
    assert langid.fit(docs).langs == ["aa", "bb"]
