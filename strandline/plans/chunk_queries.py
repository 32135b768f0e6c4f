"""Queries of chunkers and of rules that carry state along a key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import chunks as C
from strandline.operators import sequences as S
from strandline.plans.registry import register
from strandline.sources.tables import table


def docs(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", "text")


register("sentences", f"""
WITH s AS (SELECT doc_id, unnest([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(regexp_replace(text, '([.!?…]+[{C.CLOSE.replace(chr(39), chr(39) * 2)}]*)\\s+([{C.OPEN.replace(chr(39), chr(39) * 2)}]*[^\\p{{Ll}}\\s])', '\\1' || chr(30) || '\\2', 'g'), chr(30))]) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars, max(length(s))::INT AS longest FROM s WHERE s <> '' GROUP BY 1""")(
    lambda spark, sf: docs(spark, sf).select("doc_id", F.explode(C.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.max(F.length("s")).alias("longest"))
)
register("blank_blocks", r"""
WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '(\n{2,})', chr(30) || '\1' || chr(30), 'g'), chr(30)) AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(w) AS t, unnest([list_sum([length(x) FOR x IN w[1:i]]) - length(w[i]) FOR i IN range(1, len(w) + 1)]) AS s FROM w),
i AS (SELECT doc_id, s + length(t) - length(regexp_replace(t, '^\s+', '')) AS start, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM p)
SELECT doc_id, start::INT AS start, (start + length(text))::INT AS "end", md5(text) AS digest FROM i WHERE text <> ''""")(
    lambda spark, sf: C.blank_blocks(docs(spark, sf), "doc_id", "text").select("doc_id", "start", "end", F.md5("text").alias("digest"))
)
register("core_parts", r"""
SELECT conv_id, turn, k % 3 AS before, md5(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS core, k % 2 AS after FROM (SELECT *, (conv_id + turn)::INT AS k FROM conversations) WHERE trim(coalesce(text, '')) <> ''""")(
    lambda spark, sf: table(spark, sf, "conversations").where("trim(coalesce(text, '')) <> ''").select("conv_id", "turn", C.core(F.expr("concat(repeat('\n', int((conv_id + turn) % 3)), regexp_replace(text, '^\\\\s+|\\\\s+$', ''), repeat(' ', int((conv_id + turn) % 2)))")).alias("c"))
    .select("conv_id", "turn", F.length("c.before").alias("before"), F.md5("c.core").alias("core"), F.length("c.after").alias("after"))
)

_LETTERS = r"md5(regexp_replace(text, '\s+', '', 'g'))"


def _letters(found):
    """Of each document: its pieces' characters without blanks, in order, and whether a piece has blanks at its ends."""
    n = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"), F.max(F.length("text")).alias("longest"))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return n.select("doc_id", F.md5(F.regexp_replace(joined, r"\s+", "")).alias("letters"), "longest", F.exists("p", lambda x: x["text"].rlike(r"^\s|\s$|^$")).alias("untrimmed"))


_WORDED = r"FROM documents WHERE regexp_matches(text, '\S')"
register("reading_units", f"SELECT doc_id, {_LETTERS} AS letters, true AS fits, false AS untrimmed {_WORDED}")(
    lambda spark, sf: _letters(C.pieces(docs(spark, sf), "doc_id", "text", C.units)).select("doc_id", "letters", (F.col("longest") <= C.HARD).alias("fits"), "untrimmed")
)
register("packed_paragraphs", f"SELECT doc_id, {_LETTERS} AS letters {_WORDED}")(
    lambda spark, sf: _letters(C.pieces(docs(spark, sf), "doc_id", "text", C.paragraphs(3500))).select("doc_id", "letters")
)
register("short_pieces", f"SELECT doc_id, {_LETTERS} AS letters, false AS untrimmed {_WORDED}")(
    lambda spark, sf: _letters(C.pieces(docs(spark, sf), "doc_id", "text", C.short)).select("doc_id", "letters", "untrimmed")
)
register("captions", f"SELECT doc_id, {_LETTERS} AS letters, false AS untrimmed {_WORDED}")(
    lambda spark, sf: _letters(C.pieces(docs(spark, sf), "doc_id", "text", C.captions())).select("doc_id", "letters", "untrimmed")
)


def _tiles(spark, sf):
    d = docs(spark, sf)
    found = C.pieces(d, "doc_id", "text", C.blocks(3000))
    good = C.tiling(found, d.withColumn("n", F.length("text")), "doc_id", "n").withColumnRenamed("tiles", "whole")
    holed = C.tiling(found.where("piece <> 1"), d.withColumn("n", F.length("text")), "doc_id", "n").withColumnRenamed("tiles", "holed")
    n = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    return good.join(holed, "doc_id").join(n, "doc_id", "left").select("doc_id", "whole", (F.col("holed") == (F.coalesce("n", F.lit(0)) < 2)).alias("holes_found"))


register("exact_blocks", "SELECT doc_id, true AS whole, true AS holes_found FROM documents WHERE text IS NOT NULL")(_tiles)


def segments(spark, sf):
    """Turns of a conversation as timed segments."""
    t = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn AS place", "turn * 2.5D + conv_id % 3 * 0.25D AS start", "turn * 2.5D + conv_id % 3 * 0.25D + 1.25D + (turn + conv_id) % 4 * 0.5D AS end",
        "substring(trim(coalesce(text, '')), 1, int(20 + (turn * 37 + conv_id * 11) % 90)) AS text", "role = 'user' AND conv_id % 2 = 0 AS change",
    )
    w = Window.partitionBy("conv_id").orderBy("place")
    return t.withColumn("next_start", F.lead("start").over(w))


_SEGMENTS = """s AS (SELECT conv_id, turn AS place, turn * 2.5::DOUBLE + conv_id % 3 * 0.25::DOUBLE AS start, turn * 2.5::DOUBLE + conv_id % 3 * 0.25::DOUBLE + 1.25::DOUBLE + (turn + conv_id) % 4 * 0.5::DOUBLE AS "end",
  substr(trim(coalesce(text, '')), 1, (20 + (turn * 37 + conv_id * 11) % 90)::INT) AS text, role = 'user' AND conv_id % 2 = 0 AS change FROM conversations)"""

register("timed_groups", f"""
WITH RECURSIVE {_SEGMENTS}, r AS (SELECT *, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY start, place) AS k, count(*) FILTER (change) OVER (PARTITION BY conv_id) >= 2 AND change AS c FROM s WHERE trim(text) <> ''),
g AS (SELECT conv_id, k, place, 0::BIGINT AS grp, start AS gs, "end" AS ge, length(text) AS n, text AS last, 0 AS speaker FROM r WHERE k = 1
  UNION ALL SELECT conv_id, k, place, CASE WHEN cut THEN grp + 1 ELSE grp END, CASE WHEN cut THEN start ELSE gs END, "end", CASE WHEN cut THEN length(text) ELSE n + 1 + length(t) END, CASE WHEN cut THEN text ELSE t END, CASE WHEN c THEN 1 - speaker ELSE speaker END
  FROM (SELECT r.*, g.grp, g.gs, g.ge, g.n, g.speaker, r.start - g.ge > 0.8 OR r.c OR r."end" - g.gs > 9 OR g.n + 1 + length(r.t) > 240
    OR ((regexp_matches(g.last, '[.!?…]["''»)\\]]?$') OR (regexp_matches(g.last, '[,;:—-]["''»)\\]]?$') AND g.ge - g.gs >= 6)) AND g.ge - g.gs >= 2.2) AS cut FROM g JOIN r ON r.conv_id = g.conv_id AND r.k = g.k + 1))
SELECT conv_id, place, grp AS "group", speaker FROM g""")(
    lambda spark, sf: S.timed_groups(segments(spark, sf), "conv_id").select("conv_id", "place", "group", "speaker")
)
register("text_batches", f"""
WITH RECURSIVE {_SEGMENTS}, r AS (SELECT *, lead(start) OVER w AS nx, row_number() OVER w AS k, 23 + length(text) AS size FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
g AS (SELECT conv_id, k, place, 0::BIGINT AS batch, 1 AS n, size + 2 AS chars, nx IS NOT NULL AND (nx - "end" > 0.6 OR regexp_matches(text, '[.!?]\\s*$')) AS idea, nx IS NOT NULL AND (nx - "end" > 0.6 OR regexp_matches(text, '[.!?]\\s*$')) AND size + 2 >= 350 AS closed FROM r WHERE k = 1
  UNION ALL SELECT conv_id, k, place, batch, n, chars, idea, idea AND (n >= 3 OR chars >= 350)
  FROM (SELECT conv_id, k, place, CASE WHEN fresh THEN batch + 1 ELSE batch END AS batch, CASE WHEN fresh THEN 1 ELSE n + 1 END AS n, CASE WHEN fresh THEN size + 2 ELSE chars + size + 2 END AS chars, nx IS NOT NULL AND (nx - "end" > 0.6 OR regexp_matches(text, '[.!?]\\s*$')) AS idea
    FROM (SELECT r.*, g.batch, g.n, g.chars, g.closed OR g.n >= 8 OR g.chars + r.size > 2800 AS fresh FROM g JOIN r ON r.conv_id = g.conv_id AND r.k = g.k + 1)))
SELECT conv_id, place, batch FROM g""")(
    lambda spark, sf: S.text_batches(segments(spark, sf), "conv_id").select("conv_id", "place", "batch")
)
_RATE = "CASE WHEN v <= 0 OR (room >= v AND room > 0) THEN 1 WHEN room <= 0 THEN 1.25 ELSE least(1.25, round(ceil(v / room / 0.05::DOUBLE - 1e-9) * 0.05::DOUBLE, 2)) END::DOUBLE"
register("voice_plan", f"""
WITH RECURSIVE {_SEGMENTS}, r AS (SELECT *, lead(start) OVER w AS nx, row_number() OVER w AS k, length(text) / 17.5::DOUBLE AS v FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
g AS (SELECT conv_id, k, place, nx, v, start AS pos, {_RATE} AS rate FROM (SELECT *, coalesce(nx, 1e18) - start AS room FROM r WHERE k = 1)
  UNION ALL SELECT conv_id, k, place, nx, v, pos, {_RATE} FROM (SELECT *, coalesce(nx, 1e18) - pos AS room FROM (SELECT r.conv_id, r.k, r.place, r.nx, r.v, greatest(r.start, g.pos + g.v / g.rate + 0.08::DOUBLE) AS pos FROM g JOIN r ON r.conv_id = g.conv_id AND r.k = g.k + 1)))
SELECT conv_id, place, round(pos, 3) AS planned, rate, round(pos + v / rate, 3) AS finish, coalesce(pos + v / rate > nx + 1e-6, false) AS overrun FROM g""")(
    lambda spark, sf: S.voice_plan(segments(spark, sf).withColumn("voice", F.length("text") / 17.5), "conv_id").select("conv_id", "place", "planned", "rate", "finish", "overrun")
)
register("batch_ratio", "SELECT conv_id, coalesce(sum(length(role)) / nullif(sum(length(coalesce(text, ''))), 0), 1) AS ratio FROM conversations GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "conversations").groupBy("conv_id").agg(S.batch_ratio(F.col("text"), F.col("role")).alias("ratio"))
)
