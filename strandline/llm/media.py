"""Media columns stored as deduplicated, content-defined chunks.

A payload is kept as an 8-bit mono WAV file. Its header stays with the file's list; a gear hash over
the last 32 bytes cuts the samples into chunks where its top bits are zero. Chunks are named by their SHA-256. A digest that
several files use (found by a join of digests alone) is held by one of them, its owner, so each chunk is
written once; a file is an ordered list of digests in which the chunks that it owns carry their bytes.
The store is a Parquet table. Reading joins the owned chunks to the lists that lack them, puts each file
together, verifies every digest and decodes the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shared_path, texts_of

MIN, MEAN_BITS, MAX = 2048, 13, 65536
_rng = np.random.default_rng(20260101)
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
HEADER = 44
#: Texts that the compression dictionary is trained on, at most (about; taken by hash), and its bytes.
SAMPLE, DICTIONARY = 2_000, 112_640
LEVEL = 9
FEATURES = "file binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def cuts(data: bytes) -> list[int]:
    """End of each chunk; minimum and maximum chunk lengths apply, the last may be shorter."""
    n = len(data)
    if n <= MIN:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after these, h holds the gear hash of the last 32 bytes
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step)
        h = g
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, last = [], 0
    while n - last > MIN:
        k = np.searchsorted(marks, last + MIN)
        end = min(int(marks[k]) if k < len(marks) else n, last + MAX, n)
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit unsigned PCM, one channel; payload length is even, so no pad byte is needed."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or media[36:40] != b"data":
        raise ValueError("not a stored media file")
    (n,) = struct.unpack("<I", media[40:44])
    if n != len(media) - HEADER:
        raise ValueError("truncated media file")
    return media[HEADER:]


def feature(payload: bytes) -> str:
    """Mean, deviation, crossings of the middle level and the sixteen-bin level histogram."""
    a = np.frombuffer(payload, np.uint8)
    hist = np.bincount(a >> 4, minlength=16)
    total, squares = int(a.sum(dtype=np.int64)), int((a.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero(np.diff(a >= 128)))
    return f"sum={total};squares={squares};crossings={crossings};levels=" + ",".join(map(str, hist))


def dictionary(docs: DataFrame, sample: int = SAMPLE) -> bytes:
    """A compression dictionary of texts taken by hash; empty where there are too few to train one."""
    import zstandard

    n = docs.count()
    share = int(min(1.0, sample / max(n, 1)) * 1_000_000)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("text"), "text").select(F.substring("text", 1, 8192)).limit(2 * sample)
    parts = [r[0].encode() for r in some.collect() if r[0]]
    if len(parts) < 200:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _coder(kind, words: bytes, **more):
    import zstandard

    return kind(dict_data=zstandard.ZstdCompressionDict(words), **more) if words else kind(**more)


#: Folder of the dictionary within a store; readers of tables pass over such names.
WORDS = "_dictionary"
LISTED = "file binary, n_bytes long, media_sha256 binary, header binary, chunks array<struct<seq:int,digest:binary,data:binary>>"
CHUNKS = pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary()), ("data", pa.binary())]))


def listed(docs: DataFrame, words: bytes, with_bytes: bool) -> DataFrame:
    """LISTED of the distinct texts of each task; data is null unless with_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = _coder(zstandard.ZstdCompressor, words, level=LEVEL), set()
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), CHUNKS]
        for b in batches:
            out, size = [[] for _ in kinds], 0
            for t in texts_of(b):
                raw = t.encode()
                sha = hashlib.sha256(raw).digest()
                if sha in seen:  # copies within the task; others go when the lists meet
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sha)
                media = wav(payload_of(raw))
                rows, body = [], media[HEADER:]
                ends = cuts(body)
                for k, (a, z) in enumerate(zip([0, *ends], ends)):
                    data = pack.compress(body[a:z]) if with_bytes else None
                    size += len(data or b"")
                    rows.append({"seq": k, "digest": hashlib.sha256(body[a:z]).digest(), "data": data})
                for col, v in zip(out, (sha, len(raw), hashlib.sha256(media).digest(), media[:HEADER], rows)):
                    col.append(v)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in LISTED.split(", ")])
                    out, size = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in LISTED.split(", ")])

    return docs.select("text").mapInArrow(run, LISTED)


def store(docs: DataFrame, path: str, words: bytes = b"") -> None:
    """Writes the media of the distinct texts of docs to a Parquet table at path, each chunk once.

    First pass: digests only, to find those used more than once and their owners. Second pass: the
    compressed files go to the partition of their digest, one copy of each is kept, and chunks owned
    elsewhere lose their bytes; only (file, seq) of these are joined, so bytes move once. The dictionary that
    chunks are compressed with lies beside them, so that whoever knows the path can read the store.
    """
    uses = listed(docs, words, False).select("file", F.explode("chunks").alias("c")).select("file", "c.seq", "c.digest").repartition("digest")  # dealt once, for the owners and for those that borrow
    first = F.min(F.struct("file", "seq"))
    owner = uses.groupBy("digest").agg(first.alias("owner"), F.max(F.struct("file", "seq")).alias("last")).where("owner <> last")
    lent = uses.join(owner, "digest").where("file <> owner.file or seq <> owner.seq")
    lent = lent.groupBy("file").agg(F.collect_set("seq").alias("lent"))
    files = listed(docs, words, True).groupBy("file").agg(*[F.first(c).alias(c) for c in ("n_bytes", "media_sha256", "header", "chunks")])
    kept = F.transform("chunks", lambda c: c.withField("data", F.when(~F.coalesce(F.array_contains("lent", c["seq"]), F.lit(False)), c["data"])))
    shared = owner.select(F.col("owner.file").alias("file"), F.col("owner.seq").alias("seq")).groupBy("file").agg(F.collect_set("seq").alias("gives"))
    files = files.join(lent, "file", "left").join(shared, "file", "left")
    files.select("file", "n_bytes", "media_sha256", "header", kept.alias("chunks"), "gives").write.parquet(path)
    docs.sparkSession.createDataFrame([(bytearray(words),)], "words binary").coalesce(1).write.parquet(f"{path}/{WORDS}")


def read_back(spark, path: str) -> DataFrame:
    """FEATURES of every stored file, computed from its chunks; a wrong or missing digest fails the job.

    Files that own all their chunks are read in place. Lists with chunks owned by other files are joined
    with these by digest and put together by file.
    """
    words = bytes(spark.read.schema("words binary").parquet(f"{path}/{WORDS}").first()[0])
    files = spark.read.schema(LISTED + ", gives array<int>").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = _coder(zstandard.ZstdDecompressor, words)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for k in range(b.num_rows):
                now, n, want, header, chunks = (b.column(c)[k].as_py() for c in range(5))
                pieces = [header]
                for c in sorted(chunks, key=lambda c: c["seq"]):
                    piece = unpack.decompress(c["data"]) if c["data"] is not None else b""
                    if hashlib.sha256(piece).digest() != c["digest"]:
                        raise ValueError(f"a stored chunk of {now.hex()} is damaged")
                    pieces.append(piece)
                media = b"".join(pieces)
                sha = hashlib.sha256(media).digest()
                if sha != want:
                    raise ValueError(f"stored media of {now.hex()} is damaged")
                p = samples(media)
                for col, v in zip(out, (now, n, len(p), hashlib.sha256(p).digest(), zlib.crc32(p[-64:]), len(media), sha, feature(p))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in FEATURES.split(", ")])

    whole = F.forall("chunks", lambda c: c["data"].isNotNull())
    given = files.where("gives is not null").select(F.explode(F.filter("chunks", lambda c: F.array_contains("gives", c["seq"]))).alias("c"))
    given = given.select("c.digest", F.col("c.data").alias("lent"))
    parts = files.where(~whole).select("file", "n_bytes", "media_sha256", "header", F.explode("chunks").alias("c")).select("file", "n_bytes", "media_sha256", "header", "c.*")
    there, missing = parts.where("data is not null"), parts.where("data is null").drop("data").join(given, "digest").withColumnRenamed("lent", "data")
    joined = there.unionByName(missing.select(*there.columns)).groupBy("file", "n_bytes", "media_sha256", "header")
    joined = joined.agg(F.collect_list(F.struct("seq", "digest", "data")).alias("chunks"))
    names = ["file", "n_bytes", "media_sha256", "header", "chunks"]
    return files.where(whole).select(names).mapInArrow(run, FEATURES).unionByName(joined.select(names).mapInArrow(run, FEATURES))


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, FEATURES (digests in hexadecimal) and text_sha256 of every row of documents(doc_id, text), read back from the store at path.

    path: a folder that driver and executors share, written here; by default a new one in the shared
    folder of the session. Null text is empty: its payload is 64 zero bytes. Equal texts are stored once
    and get equal values; repeated rows are returned as often as they occur; very long texts are stored
    whole; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path, words = path or shared_path(spark, "media"), dictionary(docs)
    store(docs, path, words)
    file = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), file.alias("file")).join(read_back(spark, path), "file")
    plain = [F.lower(F.hex(c)).alias(c) if c.endswith("sha256") else F.col(c) for c in (x.split()[0] for x in FEATURES.split(", ")[1:])]
    return found.select("doc_id", *plain, F.lower(F.hex("file")).alias("text_sha256"))
