"""Queries of places found again in documents that were changed, and of matches between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.text import ACCENTED, PLAIN
from strandline.operators import placement as P
from strandline.plans.registry import register
from strandline.sources.tables import table

#: A document that was left alone, lower-cased behind a new start, broken within the quote, broken at it, or written anew.
_CHANGED = """CASE k WHEN 0 THEN t WHEN 1 THEN concat('-- ', lower(t)) WHEN 2 THEN concat(substr(t, 1, spot + 20), ' ### ', substr(t, spot + 21)) WHEN 3 THEN concat(substr(t, 1, spot), '####', substr(t, spot + 11))
  WHEN 4 THEN concat('no', repeat('#', length(t))) WHEN 5 THEN concat(t, t) ELSE t END"""
_PLACED = "length(t) * (k + 1) {div} 8"


def _find_quotes(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "coalesce(text, '') AS t").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    d = d.selectExpr("*", f"CAST({_PLACED.format(div='div')} AS INT) AS spot")
    d = d.selectExpr("doc_id", "k", f"{_CHANGED} AS text", "spot AS at", "IF(k = 6, substr(t, spot + 1, 5), substr(t, spot + 1, 40)) AS quote", "substr(t, greatest(spot - 24, 0) + 1, least(spot, 24)) AS before")
    return P.find_quotes(d).select("doc_id", "k", "place", "found")


def _near(needle: str) -> str:
    """Nearest occurrence of a needle in f, of which b is the reverse."""
    return f"""(CASE WHEN length({needle}) = 0 THEN NULL ELSE (SELECT CASE WHEN y > 0 AND (x = 0 OR spot - (n - m - y + 1) <= x - 1) THEN n - m - y + 1 WHEN x > 0 THEN spot + x - 1 END FROM (
    SELECT length({needle}) AS m, length(f) AS n, strpos(substr(f, spot + 1), {needle}) AS x, CASE strpos(substr(b, greatest(length(f) - spot - length({needle}), 0) + 1), reverse({needle})) WHEN 0 THEN 0 ELSE strpos(substr(b, greatest(length(f) - spot - length({needle}), 0) + 1), reverse({needle})) + greatest(length(f) - spot - length({needle}), 0) END AS y)) END)"""


register("find_quotes", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, k FROM documents, range(7) r(k)), e AS (SELECT *, {_PLACED.format(div='//')} AS spot FROM d),
q AS (SELECT doc_id, k, {_CHANGED} AS text, spot, CASE WHEN k = 6 THEN substr(t, spot + 1, 5) ELSE substr(t, spot + 1, 40) END AS quote, substr(t, greatest(spot - 24, 0) + 1, least(spot, 24)) AS before FROM e),
f AS (SELECT *, translate(lower(text), '{ACCENTED}', '{PLAIN}') AS f, reverse(translate(lower(text), '{ACCENTED}', '{PLAIN}')) AS b, translate(lower(quote), '{ACCENTED}', '{PLAIN}') AS fq, translate(lower(before), '{ACCENTED}', '{PLAIN}') AS fb FROM q),
h AS (SELECT *, substr(fq, 1, greatest(10, length(fq) // 2)) AS fh FROM f),
c AS (SELECT doc_id, k, spot, text, quote, {_near('fq')} AS p1, {_near('fh')} AS p2, CASE WHEN length(fb) >= 8 THEN {_near('fb')} + length(fb) END AS p3 FROM h)
SELECT doc_id, k::INT AS k, (CASE WHEN text = '' THEN 0 WHEN length(quote) < 8 THEN least(spot, length(text)) WHEN substr(text, spot + 1, length(quote)) = quote THEN spot ELSE coalesce(p1, p2, CASE WHEN p3 > length(text) THEN length(text) ELSE p3 END, least(spot, length(text))) END)::BIGINT AS place,
  CASE WHEN text = '' THEN 'empty' WHEN length(quote) < 8 THEN 'index' WHEN substr(text, spot + 1, length(quote)) = quote THEN 'same' WHEN p1 IS NOT NULL THEN 'quote' WHEN p2 IS NOT NULL THEN 'half' WHEN p3 IS NOT NULL THEN 'before' ELSE 'kept' END AS found FROM c""")(_find_quotes)


@register("placed_blocks")
def _placed_blocks(spark, sf):
    """Documents spoken in blocks of 40 words, of which every seventh is lost and every fifth spoken otherwise; SQL doesn't state the rules."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    block = lambda i: F.array_join(F.transform(F.slice("w", i * 40 + 1, 40), lambda w, j: F.when((i % 5 == 4) & (j % 9 == 8), "spoken").otherwise(w)), " ")
    blocks = F.when(F.size("w") > 0, F.transform(F.filter(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 40).cast("int")), lambda i: i % 7 != 6), block))
    return P.place_blocks(d.select("doc_id", "text", blocks.alias("blocks")), "doc_id")


_USEFUL = f"""list_filter(regexp_split_to_array(regexp_replace(translate(lower(coalesce({{0}}, '')), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]', ' ', 'g'), ' +'), lambda w: length(w) > 1 AND w NOT IN ({", ".join(repr(w) for w in P.TITLE_STOP)}))"""
register("best_matches", f"""
WITH a AS (SELECT item_id AS id, {_USEFUL.format("text")} AS ws, ['src7', 'someone'] AS by FROM benchmark),
o AS (SELECT doc_id, list_distinct({_USEFUL.format("text")}) AS ws, {_USEFUL.format("source")} AS by FROM documents WHERE lang IS NOT NULL),
t AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM a), u AS (SELECT doc_id, unnest(ws) AS w FROM o), s AS (SELECT id, n, doc_id, count(*) AS hits FROM t JOIN u USING (w) GROUP BY 1, 2, 3),
r AS (SELECT s.id, s.doc_id, hits / n + CASE WHEN len(list_filter(a.by, lambda w: list_contains(o.by, w))) >= 0.5 * len(a.by) THEN 0.25::DOUBLE ELSE 0 END AS score FROM s JOIN a USING (id) JOIN o USING (doc_id)),
b AS (SELECT id, max({{s: score, o: -doc_id}}) AS m FROM r WHERE score >= 0.6 GROUP BY 1)
SELECT a.id, -m.o AS match, m.s AS score FROM a LEFT JOIN b USING (id)""")(
    lambda spark, sf: P.best_matches(
        table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"), F.lit("Src7 Someone").alias("author")),
        table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("author"), F.col("lang").alias("cover")),
    ).select("id", "match", "score")
)

register("compact_places", f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS cs FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(cs, lambda c, i: {{'l': translate(lower(c), '{ACCENTED}', '{PLAIN}')[1], 'i': i - 1}}), lambda x: regexp_matches(x.l, '^[a-z0-9]$')) AS k FROM l)
SELECT doc_id, md5(array_to_string([x.l for x in k], '')) AS letters, md5(array_to_string([x.i for x in k], ',')) AS places, len(k)::INT AS n FROM k""")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", P.compacted(F.col("text")).alias("c")).select(
        "doc_id", F.md5("c.text").alias("letters"), F.md5(F.array_join(F.col("c.places").cast("array<string>"), ",")).alias("places"), F.size("c.places").alias("n"))
)


def _pages(spark, sf):
    """Documents as pages of 400 characters, in a text whose commas moved and whose every third page lost some letters at its start."""
    d = table(spark, sf, "documents").where("length(text) > 0").withColumn("n", F.expr("CAST((length(text) - 1) DIV 400 AS INT)"))
    page = lambda i: F.substr("text", i * 400 + 1, F.lit(400))
    pages = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.when(i % 3 == 2, F.overlay(page(i), F.lit("#"), F.lit(20), F.lit(3))).otherwise(page(i)))
    marks = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.struct(i.alias("page"), F.substring(page(i), 1, 60).alias("sample")))
    d = d.select("doc_id", F.replace(F.array_join(pages, ""), F.lit(","), F.lit(" , ")).alias("changed"), marks.alias("marks"))
    return d.withColumnRenamed("changed", "text")


register("placed_pages", f"""
WITH RECURSIVE d AS (SELECT doc_id, text, (length(text) - 1) // 400 AS n FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, i AS page, substr(text, 400 * i + 1, 400) AS s FROM (SELECT doc_id, text, unnest(range(n + 1)) AS i FROM d)),
t AS (SELECT doc_id, replace(string_agg(CASE WHEN page % 3 = 2 AND length(s) >= 19 THEN substr(s, 1, 19) || '#' || substr(s, 23) WHEN page % 3 = 2 THEN s || '#' ELSE s END, '' ORDER BY page), ',', ' , ') AS t FROM p GROUP BY 1),
k AS MATERIALIZED (SELECT doc_id, list_filter(list_transform(string_split(t, ''), lambda c, i: {{'l': translate(lower(c), '{ACCENTED}', '{PLAIN}')[1], 'i': i - 1}}), lambda x: regexp_matches(x.l, '^[a-z0-9]$')) AS k FROM t),
c AS MATERIALIZED (SELECT doc_id, array_to_string([x.l for x in k], '') AS c FROM k),
m AS MATERIALIZED (SELECT doc_id, page, substr(regexp_replace(translate(lower(substr(s, 1, 60)), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]', '', 'g'), 1, 40) AS n FROM p),
r AS (SELECT doc_id, -1::BIGINT AS page, 0::BIGINT AS at_, NULL::BIGINT AS hit FROM c
  UNION ALL SELECT doc_id, page, CASE WHEN h > 0 THEN h - 1 + greatest(1, length(n) // 2) ELSE at_ END, CASE WHEN h > 0 THEN h - 1 END FROM (
    SELECT r.doc_id, m.page, r.at_, n, CASE WHEN length(n) < 6 THEN 0 WHEN strpos(substr(c, r.at_ + 1), n) > 0 THEN strpos(substr(c, r.at_ + 1), n) + r.at_ WHEN length(n) > 14 AND strpos(substr(c, r.at_ + 1), substr(n, 1, 14)) > 0 THEN strpos(substr(c, r.at_ + 1), substr(n, 1, 14)) + r.at_ ELSE 0 END AS h
    FROM r JOIN m ON m.doc_id = r.doc_id AND m.page = r.page + 1 JOIN c ON c.doc_id = r.doc_id))
SELECT r.doc_id, page::INT AS page, k[hit + 1].i::INT AS place FROM r JOIN k USING (doc_id) WHERE hit IS NOT NULL""")(lambda spark, sf: P.place_pages(_pages(spark, sf), "doc_id"))
