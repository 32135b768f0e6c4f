"""Queries on parts of documents, transcripts of chunks, manifests, copies and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import chunks as C
from strandline.operators import context as X
from strandline.plans.registry import register
from strandline.sources.tables import table

TURN = "SELECT conv_id, turn, max(coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2"


def turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


register("answer_context", "SELECT true AS few, true AS some, true AS within, true AS hits")(
    lambda spark, sf: X.answer_context(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", "which license version").agg(
        (F.count("*") <= 6).alias("few"), (F.count("*") >= 1).alias("some"), (F.sum(F.length("context")) <= 12_000).alias("within"), F.bool_and(F.lower("context").rlike("licens|version")).alias("hits"))
)
register("neighbour_context", f"""
WITH t AS ({TURN}) SELECT conv_id, turn, md5(right(coalesce(lag(text) OVER w, ''), 400)) AS before, md5(left(coalesce(lead(text) OVER w, ''), 400)) AS behind FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")(
    lambda spark, sf: X.with_neighbours(turns(spark, sf), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("before").alias("before"), F.md5("behind").alias("behind"))
)
register("composed_books", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''")(
    lambda spark, sf: X.compose(C.pieces(table(spark, sf, "documents").where("text <> ''"), "doc_id", "text", C.blocks(1500)).withColumnRenamed("piece", "place"), "doc_id").select("doc_id", F.md5("text").alias("digest"))
)
register("vocabulary", r"""
WITH t AS (SELECT conv_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[^\s]*\s?', ''), '\s?[^\s]*$', '') AS t FROM conversations) SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(t), '\p{L}{3,}')) AS form FROM t""")(
    lambda spark, sf: X.vocabulary(table(spark, sf, "conversations"), "conv_id", "text")
)

#: Line items as phrases heard in chunks of five line numbers' time, some of them twice.
_HEARD = "SELECT l_orderkey, chunk, min(l_linenumber * 2.0 - chunk * 4 + l_partkey % 3 * 0.1)::DOUBLE AS start, min(l_linenumber * 2.0 - chunk * 4 + l_partkey % 3 * 0.1 + 1.5)::DOUBLE AS \"end\", any_value('p' || l_linenumber) AS text FROM lineitem, (VALUES (0), (1)) c(chunk) WHERE (chunk = 0 AND l_linenumber <= 5) OR (chunk = 1 AND l_linenumber >= 3) GROUP BY l_orderkey, chunk, l_linenumber"


def _heard(spark, sf):
    both = table(spark, sf, "lineitem").withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1)))).where("(chunk = 0 and l_linenumber <= 5) or (chunk = 1 and l_linenumber >= 3)")
    start = F.min(F.expr("l_linenumber * 2.0D - chunk * 4 + l_partkey % 3 * 0.1D"))
    h = both.groupBy("l_orderkey", "chunk", "l_linenumber").agg(start.alias("start"), F.min(F.expr("l_linenumber * 2.0D - chunk * 4 + l_partkey % 3 * 0.1D + 1.5D")).alias("end"))
    h = h.select("l_orderkey", "chunk", "start", "end", F.concat(F.lit("p"), "l_linenumber").alias("text"))
    c = table(spark, sf, "lineitem").select("l_orderkey").distinct().withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1))))
    return h, c.select("l_orderkey", "chunk", (F.col("chunk") * 4).cast("double").alias("offset"), (F.col("chunk") * 8).cast("double").alias("limit"))


register("joined_transcripts", f"""
WITH RECURSIVE h AS ({_HEARD}), o AS (SELECT l_orderkey, chunk, text, chunk * 4 + start AS s, greatest(chunk * 4 + "end", chunk * 4 + start + 0.01::DOUBLE) AS e FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY chunk, s, e, text) AS k FROM o WHERE (chunk = 0 AND s >= 0 AND s < 8) OR (chunk = 1 AND s >= 8)),
g AS (SELECT l_orderkey, k, s, e, text, true AS ok, e AS last FROM k WHERE k = 1
  UNION ALL SELECT k.l_orderkey, k.k, k.s, k.e, k.text, k.chunk = 0 OR k.s >= g.last - 0.25, CASE WHEN k.chunk = 0 OR k.s >= g.last - 0.25 THEN greatest(g.last, k.e) ELSE g.last END FROM g JOIN k ON k.l_orderkey = g.l_orderkey AND k.k = g.k + 1)
SELECT l_orderkey, round(s, 3) AS start, round(e, 3) AS "end", text FROM g WHERE ok""")(
    lambda spark, sf: X.join_transcripts(*_heard(spark, sf), "l_orderkey").select("l_orderkey", "start", "end", "text")
)
register("front_coded_words", "SELECT p_brand, list_distinct(list(p_name)).list_sort().array_to_string('|') AS words FROM part GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("w")).select("p_brand", F.array_join(X.front_decoded(X.front_coded(F.col("w"))), "|").alias("words"))
)
_LINE = """CASE o_orderkey % 7 WHEN 0 THEN '# note' WHEN 1 THEN 'no json' WHEN 2 THEN concat('{"id": "', o_orderkey, '", "audio": "", "language": "en", "transcript": "t"}') WHEN 3 THEN concat('{"id": "', o_orderkey, '", "audio": "a", "language": "fr", "transcript": "t"}')
  ELSE concat('{"id": "', o_orderkey, '", "audio": "a", "language": "', CASE WHEN o_orderkey % 700 = 4 THEN 'es' ELSE 'en-US' END, '", "transcript": "t"}') END"""
register("manifest_samples", "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 700 = 4 THEN 'es' ELSE 'en' END AS language FROM orders WHERE o_orderkey % 7 > 3")(
    lambda spark, sf: X.manifest(table(spark, sf, "orders").select(F.expr(_LINE).alias("t")), "t", ["en", "es"], 50)[0].select("id", "language")
)
register("manifest_faults", """
WITH f AS (SELECT CASE o_orderkey % 7 WHEN 1 THEN 'no_json' WHEN 2 THEN 'no_audio' WHEN 3 THEN 'language' END AS fault FROM orders WHERE o_orderkey % 7 BETWEEN 1 AND 3), n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 7 > 3 AND o_orderkey % 700 = 4)
SELECT fault, count(*) AS count FROM f GROUP BY 1 UNION ALL SELECT 'few_es', n FROM n WHERE n BETWEEN 1 AND 49""")(
    lambda spark, sf: X.manifest(table(spark, sf, "orders").select(F.expr(_LINE).alias("t")), "t", ["en", "es"], 50)[1]
)
register("upserted_texts", """
SELECT o_orderkey, 'es' AS lang, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE o_orderstatus END AS text FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")(
    lambda spark, sf: X.upsert(table(spark, sf, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "'es' AS lang", "o_orderstatus AS text"),
        table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey", "'es' AS lang", "explode(array('a', 'b')) AS text"), ["o_orderkey", "lang"])
)


def _copies(spark, sf):
    docs = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderpriority AS title", "o_orderkey % 10 AS stamp")
    parts = table(spark, sf, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_linenumber AS place", "l_returnflag AS text")
    copies = X.export_copy(docs, parts, "o_orderkey")
    copies = copies.withColumn("copy", F.expr("IF(o_orderkey % 11 = 0, 'broken', copy)"))
    stored = docs.where("o_orderkey % 2 = 0").withColumn("stamp", F.lit(5))
    return X.import_copy(copies, stored, "o_orderkey", "o_orderkey bigint, title string, stamp bigint, parts array<struct<place:int,text:string>>", "stamp").select("o_orderkey", "title", F.coalesce(F.size("parts"), F.lit(0)).alias("parts"))


register("restored_copies", """
WITH n AS (SELECT l_orderkey, count(*)::INT AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderpriority AS title, coalesce(parts, 0) AS parts FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_orderkey % 11 > 0 AND (o_orderkey % 2 = 1 OR o_orderkey % 10 > 5)""")(
    lambda spark, sf: _copies(spark, sf).withColumn("parts", F.greatest("parts", F.lit(0)))
)
register("incomplete_translations", """
SELECT o_orderkey, o_orderkey % 5 <> 0 AS incomplete FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.incomplete(F.lit("these words here stand alone under some large green trees where nobody ever looked " * 6),
        F.expr("""CASE o_orderkey % 5 WHEN 0 THEN repeat('estas palabras de aquí están solas bajo los grandes árboles verdes donde nadie miró nunca ', 6) WHEN 1 THEN '' WHEN 2 THEN repeat('these words here stand alone under some large green trees', 6)
          WHEN 3 THEN repeat('x the y and z you w that ', 20) ELSE 'corto' END"""), "es").alias("incomplete"))
)
register("source_languages", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' WHEN 2 THEN 'pt' WHEN 3 THEN 'es' WHEN 4 THEN 'de' WHEN 5 THEN 'en' ELSE '' END AS lang, CASE o_orderkey % 7 WHEN 0 THEN 'user' WHEN 1 THEN 'youtube' WHEN 2 THEN 'metadata' WHEN 3 THEN 'title' WHEN 4 THEN 'available' WHEN 5 THEN 'available' ELSE 'unknown' END AS source,
  CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 0.97 WHEN 2 THEN 0.75 WHEN 3 THEN 0.45 WHEN 4 THEN 0.8 WHEN 5 THEN 0.55 ELSE 0 END::DOUBLE AS confidence FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.source_language(F.expr("IF(o_orderkey % 7 = 0, 'fr-CA', 'auto')"), F.expr("IF(o_orderkey % 7 = 1, 'en', '')"), F.expr("IF(o_orderkey % 7 = 2, 'pt', NULL)"),
        F.expr("IF(o_orderkey % 7 = 3, 'es', '')"), F.lit(0.7), F.expr("CASE o_orderkey % 7 WHEN 3 THEN array('es', 'en') WHEN 4 THEN array('de-DE') WHEN 5 THEN array('fr', 'en') END")).alias("s")).select("o_orderkey", "s.*")
)
register("open_circuits", """
WITH c AS (SELECT user_id, event_id, event_type <> 'error' AND value < 60 AS ok FROM events), g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM c),
r AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, g ORDER BY event_id)::INT AS run FROM g) SELECT event_id, run, run >= 3 AS open FROM r""")(
    lambda spark, sf: X.circuit(table(spark, sf, "events").select("user_id", "event_id", F.expr("event_type <> 'error' and value < 60").alias("ok")), "user_id", ["event_id"]).select("event_id", "run", "open")
)
register("fitting_proposals", "SELECT o_orderkey, o_orderkey % 4 = 0 AS fits FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", X.proposals_fit(F.expr("""CASE o_orderkey % 4 WHEN 0 THEN array(named_struct('start', 40, 'end', 60), named_struct('start', 0, 'end', 40)) WHEN 1 THEN array(named_struct('start', 0, 'end', 41), named_struct('start', 40, 'end', 60))
      WHEN 2 THEN array(named_struct('start', 5, 'end', 90)) ELSE array(named_struct('start', 90, 'end', 110)) END"""), F.lit(100)).alias("fits"))
)
