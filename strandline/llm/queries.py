"""One registered query for each operator of this package, and the SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import byte_bpe, config_packing, embedding, langid, licenses, media, minhash, packing, prefix_trie, sharding, token_counts, toxicity, vector_codes
from strandline.llm.common import shared_path, table

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with a cache of its own, so that a run counts all texts; the second lot of rows looks up what the first has stored."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, cache=shared_path(spark, "token-cache"), batches=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents")).drop("text_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {q.__name__: q for q in (
    op1_packing, op2_embedding_near_dedup, op3_token_counts, op4_byte_bpe, op5_sharding, op6_minhash, op7_language_id, op8_media_columns, op9_license_scan, op10_toxicity,
    op11_config_packing, op12_vector_codes, op13_prefix_trie,
)}

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds of op12, one pair of tables a round. Sums of small integers in doubles are exact."""
    sql = f"""WITH k AS MATERIALIZED (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE) for x in embedding] AS q, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * w + 1 : part * w + w] AS v FROM k, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM p) WHERE n <= {entries})"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (
  SELECT vec_id, p.part, any_value(p.v) AS v, min({{'d': list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), 'e': b.entry}}) AS m
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY vec_id, p.part)"""
        if r < rounds:
            sql += f""",
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY place) AS v FROM (
      SELECT part, m.e AS entry, place, floor(sum(v[place]) / count(*)) AS mean FROM a{r}, range(1, 1 + (SELECT max(w) FROM k)) t(place) GROUP BY 1, 2, 3)
    GROUP BY 1, 2) n ON n.part = b.part AND n.entry = b.entry)"""
    return f"""{sql},
e AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string([x::BIGINT for x in v], ','), ',' ORDER BY part, entry)) AS s FROM b{rounds})
SELECT k.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM k JOIN e USING (vec_id), h"""


ORACLES = {
    "op12_vector_codes": _codes_sql(),
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
-- unsigned CRC-32 of the decimal digits, bit by bit
crc AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(conv_id::VARCHAR, '')])),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT conv_id, said, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d FROM (
    SELECT c.conv_id, t.said, t.p, 0 AS own FROM crc c JOIN t ON t.conv_id = c.base AND t.p <= c.h
    UNION ALL SELECT c.conv_id, t.said, t.p, 1 FROM crc c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h)),
pre AS MATERIALIZED (
  SELECT conv_id, d, octet_length(encode(said.t)) AS bytes, list(said) OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM crc),
n AS MATERIALIZED (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM pre GROUP BY 1, 2),
m AS MATERIALIZED (SELECT pre.conv_id AS member, pre.d, n.conv_id, n.n_convs, n.bytes FROM pre JOIN n ON n.d = pre.d AND n.prefix = pre.prefix),
up AS (SELECT n.conv_id, n.d, m.conv_id AS parent FROM n LEFT JOIN m ON m.member = n.conv_id AND m.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY 1, 2),
subs AS (
  SELECT m.conv_id, m.d, sum((k.k IS NULL)::INT) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM n JOIN m ON m.member = n.conv_id AND m.d <= n.d LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.d = n.d GROUP BY 1, 2),
ends AS (
  SELECT m.conv_id, m.d, sha256(string_agg(l.member::VARCHAR, ',' ORDER BY l.member)) AS s
  FROM (SELECT member, max(d) AS d FROM m GROUP BY 1) l JOIN m ON m.member = l.member AND m.d = l.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, up.parent AS parent_conv_id, n.n_convs, coalesce(kids.k, 0) AS n_children, subs.n_leaves::BIGINT AS n_leaves,
  subs.saved::BIGINT AS saved_tokens, coalesce(ends.s, sha256('')) AS ends_sha256
FROM n JOIN up ON up.conv_id = n.conv_id AND up.d = n.d JOIN subs ON subs.conv_id = n.conv_id AND subs.d = n.d
LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.d = n.d LEFT JOIN ends ON ends.conv_id = n.conv_id AND ends.d = n.d""",
    "op2_embedding_near_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
    "op5_sharding": f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
nodes AS (SELECT d AS depth, h >> (60 - d) AS prefix, sum(n_bytes)::BIGINT AS bytes FROM r, range(0, 61) t(d) GROUP BY 1, 2),
fit AS (SELECT r.doc_id, r.n_bytes, n.depth, n.prefix, n.bytes,
  row_number() OVER (PARTITION BY r.doc_id, r.n_bytes ORDER BY n.bytes > {SHARD_BYTES}, CASE WHEN n.bytes > {SHARD_BYTES} THEN -n.depth ELSE n.depth END) AS k
  FROM r JOIN nodes n ON n.prefix = r.h >> (60 - n.depth))
SELECT doc_id, n_bytes, depth::INT AS shard_depth, prefix AS shard_prefix, bytes AS shard_bytes, bytes > {SHARD_BYTES} AS oversized FROM fit WHERE k = 1""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
