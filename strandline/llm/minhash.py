"""Near-duplicate groups by min-max hashing.

Each of PERMS multiplicative permutations of a document's shingle hashes gives its minimum and its
maximum, so 2 * PERMS signature values cost PERMS evaluations. Bands of ROWS values make buckets.
Exact copies are one class from the start. Every class is first compared with one pivot; what is
linked is contracted. Buckets that still hold several components are searched further within blocks,
where a task returns only components that a link joins. Each link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import connected_components, materialize, partitions, texts_of

#: 80 permutations, 160 values, 40 bands of 4: a pair at similarity 0.75 meets in no band with
#: probability (1 - 0.75 ** 4) ** 40 = 2.5e-7.
PERMS, ROWS = 80, 4
BANDS = 2 * PERMS // ROWS
#: Pairs of a large bucket whose signatures agree in less than this share are not verified; at
#: similarity 0.75 fewer than 93 of 160 values agree with probability under 1e-6, and less above it.
AGREE = 0.58
WORDS = 5
#: Members that a task compares with as many others at once.
BLOCK = 512

_rng = np.random.default_rng(75)
_CHAR = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POW = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(WORDS + 1)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that are hashed at once; longer texts are cut between words.
TEXT_BYTES = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text, A-Z lower-cased."""
    if len(data) <= TEXT_BYTES:
        return _word_hashes(data)
    parts, at = [], 0
    while at < len(data):
        cut = _BLANK.search(data, at + TEXT_BYTES)
        end = cut.end() if cut else len(data)
        parts.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def _word_hashes(data: bytes) -> np.ndarray:
    b = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_SPACE[b]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    keep = np.flatnonzero(inside)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(len(keep), dtype=np.int64) - np.repeat(first, length)
    # the place within the word is mixed into each byte's hash: equal sums need equal words
    h = mix(_CHAR[b[keep]] + place.astype(np.uint64) * _ODD)
    return mix(np.add.reduceat(h, first) + length.astype(np.uint64))


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of all runs of `words` words, sorted; a shorter text is one run."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h += w[j : j + n] * _POW[j + 1]
    return np.unique(mix(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 2 * PERMS values for each set; none is empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), PERMS, 2), np.uint64)
    v = np.empty_like(flat)
    for i in range(PERMS):
        np.bitwise_xor(flat, _B[i], out=v)
        np.multiply(v, _A[i], out=v)
        out[:, i, 0] = np.minimum.reduceat(v, first)
        out[:, i, 1] = np.maximum.reduceat(v, first)
    return out.reshape(len(sets), -1)


def band_keys(mixed: np.ndarray) -> np.ndarray:
    """BANDS keys for each row of mixed signature values."""
    rows = mixed.reshape(len(mixed), BANDS, ROWS) * _POW[1 : ROWS + 1]
    return mix(rows.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD).view(np.int64)


SKETCH = "doc_id long, mark string, n_shingles long, digest binary, bands array<long>, sketch binary"
#: Shingles whose permutations are evaluated at once: few enough for a core's cache.
AT_ONCE = 1 << 16


def sketches(docs: DataFrame) -> DataFrame:
    """Digest of the text (mark), set size, digest of the set, band keys and one byte of each signature value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, bands, short, sets = [], [], [], [], []

            def flush():
                if sets:
                    mixed = mix(signatures(sets))
                    bands.extend(band_keys(mixed))
                    short.extend(x.tobytes() for x in (mixed >> np.uint64(56)).astype(np.uint8))
                    sets.clear()

            held = 0
            for t in texts_of(b):
                s = shingles(t.encode())
                n.append(len(s))
                if len(s):
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sets.append(s)
                    held += len(s)
                if not len(s) or held > AT_ONCE:
                    flush()
                    held = 0
                if not len(s):
                    digest.append(None), bands.append(None), short.append(None)
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                [x.split()[0] for x in SKETCH.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("mark"), "text").mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.encode()).view(np.int64) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "s"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs(u, v, ...) whose full sets reach the similarity."""
    kept = pairs.columns
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("s").alias("su")), "u")
    both = both.join(sets.select(F.col("rep").alias("v"), F.col("s").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    both = both.select(*kept, common.alias("i"), (F.size("su") + F.size("sv")).alias("n"))
    return both.where(F.expr(f"100L * i >= {percent}L * (n - i)")).select(*kept)


def _near(comp, n, sk, side, x: int, percent: int) -> np.ndarray:
    """Members behind x of another component (and block, where there are two) of a size and a signature near enough."""
    later = np.arange(x + 1, len(comp))
    ok = later[(comp[later] != comp[x]) & (100 * np.minimum(n[later], n[x]) >= percent * np.maximum(n[later], n[x]))]
    if side.min() != side.max():
        ok = ok[side[ok] != side[x]]
    return ok[(sk[ok] == sk[x]).sum(axis=1) >= AGREE * sk.shape[1]]


def _union(sets: dict[int, int], x: int) -> int:
    while sets.setdefault(x, x) != x:
        sets[x] = x = sets[sets[x]]
    return x


def joined_components(comp, n, sk, shingle_sets, side, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that a link joins, none that earlier ones join; links are confirmed on the full sets."""
    joined: dict[int, int] = {}
    out = []
    for x in range(len(comp)):
        for y in _near(comp, n, sk, side, x, percent).tolist():
            a, b = _union(joined, comp[x]), _union(joined, comp[y])
            if a != b:
                both = len(np.intersect1d(shingle_sets[x], shingle_sets[y], assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    joined[a] = b
                    out.append((int(comp[x]), int(comp[y])))
    return out


def by_blocks(members: DataFrame, group, names: list[str]) -> DataFrame:
    """Distinct rows (longs) of group(rep, comp, n, sketches, sets, side) over pairs of blocks of each key's members.

    members(key, rep, comp, n, sketch[, s]) of a key are cut into blocks of BLOCK; a task holds two of them.
    side is the block that a member comes from; with two present, pairs across are meant.
    """
    parts, full = partitions(members.sparkSession), "s" in members.columns
    size = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = members.join(size, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "n", "sketch", *["s"] * full)
    m = m.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def found(rows):
        side, rep, comp, n, sketch, s = list(zip(*rows))[3:]
        comp = np.array(comp)
        if len(rows) < 2 or comp.min() == comp.max():
            return []
        sk = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(rows), -1)
        return group(np.array(rep), comp, np.array(n, dtype=np.int64), sk, s, np.array(side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(len(names))], names)
        for b in batches:
            out, sets = [], b.column("s") if full else None
            for k, row in enumerate(zip(*(c.to_pylist() for c in b.columns[:8]))):
                if row[:3] != now:
                    if rows:
                        out += found(rows)
                    now, rows = row[:3], []
                rows.append((*row, sets[k].values.to_numpy() if full else None))
            yield batch(out)
        yield batch(found(rows) if rows else [])

    return m.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def with_candidates(members: DataFrame, percent: int) -> DataFrame:
    """rep of each member whose signature is near that of a member of another component."""

    def group(rep, comp, n, sk, _, side):
        hit = np.zeros(len(rep), bool)
        for x in range(len(rep)):
            near = _near(comp, n, sk, side, x, percent)
            hit[near] = True
            hit[x] |= len(near) > 0
        return [(int(r),) for r in rep[hit]]

    return by_blocks(members, group, ["rep"])


def cross_components(members: DataFrame, percent: int) -> DataFrame:
    """Components (u, v) joined by links between members(key, rep, comp, n, sketch, s) of a key; a task returns fewer than its blocks have."""
    return by_blocks(members, lambda _, *rest: joined_components(*rest, percent), ["u", "v"])


def hung(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(rep, component) of nodes(rep) that hang on parents(u, v), v < u, one for each u at most: each on the root of its tree.

    Every round doubles the distance that a node looks up.
    """
    label = nodes.join(parents.select(F.col("u").alias("rep"), "v"), "rep", "left").select("rep", F.coalesce("v", "rep").alias("component"))
    for _ in range(64):
        label = materialize(label)
        up = label.select(F.col("rep").alias("component"), F.col("component").alias("root"))
        step = materialize(label.join(up, "component").select("rep", "component", "root"))
        label = step.select("rep", F.col("root").alias("component"))
        if not step.where("component <> root").limit(1).count():
            return label
    raise RuntimeError("trees deeper than 2 ** 64")


def merged(label: DataFrame, joined: DataFrame) -> DataFrame:
    """label(rep, component) once the components of joined(u, v) are one."""
    root = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return materialize(label.join(root, "component", "left").select("rep", F.coalesce("root", "component").alias("component")))


def labelled(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows(doc_id, mark, n_shingles, rep) of every document, rep null for an empty set;
    classes(rep, component) of every distinct set. mark is the digest of the text.

    A class is first compared with one pivot, the smallest class that it shares a bucket with, so a
    group of any size hangs on few pivots after one comparison for each class. What is linked is
    contracted; only buckets whose members still differ in component are searched further, block by
    block, those of one pivot together.
    """
    rows = materialize(sketches(docs))
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min("mark").alias("mark"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))  # a key of the class, fixed by the checkpoint
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("m")).where("m > 1")
    buckets = materialize(keys.join(full, "key").select("key", "rep", "n", "m", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn")))
    near = F.expr(f"100L * least(n, pn) >= {percent}L * greatest(n, pn)")
    texts = docs.where("text is not null").groupBy(F.md5("text").alias("mark")).agg(F.first("text").alias("text"))
    shared = buckets.select("rep").distinct()
    sets = materialize(shingle_sets(texts.join(classes.select("rep", "mark").join(shared, "rep"), "mark")))
    against = buckets.where("rep <> pivot").where(near)
    links = confirmed(against.groupBy("rep").agg(F.min("pivot").alias("v")).select(F.col("rep").alias("u"), "v"), sets, percent)
    label = hung(shared, links)
    mixed = buckets.where("m > 2").join(label, "rep")
    two = buckets.where("m = 2 and rep <> pivot").where(near).join(label, "rep").join(label.select(F.col("rep").alias("pivot"), F.col("component").alias("pc")), "pivot").where("component <> pc")
    several = mixed.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("key")
    inside = mixed.join(several, "key").select("pivot", "rep", "n", "component")
    both = F.explode(F.array(F.struct("rep", "n", "component"), F.struct(F.col("pivot").alias("rep"), F.col("pn").alias("n"), F.col("pc").alias("component"))))
    inside = inside.unionByName(two.select("pivot", both.alias("x")).select("pivot", "x.*"))
    unit = inside.groupBy(F.col("pivot").alias("key"), "rep").agg(F.first("component").alias("comp"), F.first("n").alias("n"))
    unit = materialize(unit.join(classes.select("rep", "sketch"), "rep"))
    inside = unit.join(with_candidates(unit, percent), "rep").join(sets, "rep")
    more = materialize(cross_components(inside, percent))
    if more.limit(1).count():
        label = merged(label, more)
    full = classes.select("rep", "digest").join(label, "rep", "left").select("rep", "digest", F.coalesce("component", "rep").alias("component"))
    full = materialize(full)
    own = rows.select("doc_id", "mark", "n_shingles", "digest").join(full.select("digest", "rep"), "digest", "left").drop("digest")
    return materialize(own), full.select("rep", "component")


def components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents(doc_id, text).

    Documents link when 100 * intersection >= percent * union of their shingle sets. Null texts and
    texts without a word have an empty set and are a component of their own. doc_id names a document:
    rows that repeat it fall into one component, whatever their texts. component_id is the smallest id of
    a component; rows without an id take part and have kept = false, and a component of such rows
    only has a null component_id. All rows are returned; other columns are ignored; an empty table gives no rows.
    Very long texts are sketched whole. Links that meet in no band or agree in less than AGREE of their
    signature are lost with the probabilities stated at these constants; every other link is kept.
    """
    own, label = labelled(docs, percent)
    some = own.where("rep is not null")
    ids = some.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v < w").drop("w")
    same = some.join(ids, "doc_id").join(label, "rep").join(label.select(F.col("rep").alias("v"), F.col("component").alias("cv")), "v")
    same = materialize(same.where("component <> cv").select(F.col("component").alias("u"), F.col("cv").alias("v")).distinct())
    if same.limit(1).count():
        label = merged(label, same)
    some = some.join(label, "rep")
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    some = some.join(least, "component").select("doc_id", "n_shingles", "component_id")
    # an id whose other row has words takes that row's component
    none = own.where("rep is null").select("doc_id", "n_shingles")
    named = some.join(none.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    none = none.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def survivors(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of docs for each group of near-duplicates, with the columns of docs.

    The row with the smallest doc_id stays (null after all ids, then by digest of the text); of rows
    that repeat id and text one stays. Rows are told apart by id and text, so an id on two texts
    decides each by itself. Rows with an empty set are in no group and all stay. An empty table gives no rows.
    """
    own, label = labelled(docs, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    keep = own.where("rep is not null").join(label, "rep").groupBy("component").agg(F.min(order).alias("k"))
    id_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keep = keep.select(F.col("k.mark").alias("_mark"), id_of(F.col("k.doc_id")).alias("_id"))
    # copies of a row meet where the texts are dealt by these keys, and the kept ones are joined there: texts move once
    word = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keys = F.md5("text").alias("_mark"), id_of(F.col("doc_id").cast("long")).alias("_id")
    # a row travels as one value, so that its columns may have any name
    rows = docs.where(word).select(*keys, F.struct(*docs.columns).alias("_row")).groupBy("_mark", "_id").agg(F.first("_row").alias("_row"))
    return rows.join(keep, ["_mark", "_id"]).select("_row.*").unionByName(docs.where(~word))
