"""Queries of positioned text pieces made from line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import boxes as B
from strandline.operators import layout as L
from strandline.plans.registry import expressions, register
from strandline.sources.tables import table

#: A line item as a piece: suppliers are documents, order keys give pages of some twenty pieces.
_PIECE = """l_suppkey AS doc, l_orderkey // 40 AS page, l_orderkey * 100 + l_linenumber * 8 + l_quantity % 8 AS item, l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN '-' WHEN l_linenumber % 3 = 1 THEN ' ' ELSE '' END AS str,
  CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 80 < 40 THEN 350 ELSE 0 END + l_partkey % 10 * 10 AS x, (l_orderkey * 7 + l_linenumber) % 50 * 4 + l_discount AS y, l_quantity AS width, 8 + l_linenumber % 3 AS height, l_linenumber % 2 = 0 AS eol"""
_SQL = f"a AS (SELECT doc, page::BIGINT AS page, item::BIGINT AS item, str, x::DOUBLE AS x, y::DOUBLE AS y, width, height::DOUBLE AS height, eol FROM (SELECT DISTINCT ON (doc, page, item) * FROM (SELECT {_PIECE} FROM lineitem) ORDER BY doc, page, item, str, x, y, width))"


def pieces(spark, sf):
    spelled = _PIECE.replace("//", "div").replace("l_returnflag || CASE", "concat(l_returnflag, CASE").replace("ELSE '' END AS str", "ELSE '' END) AS str").replace("\n", " ")
    rows = table(spark, sf, "lineitem").selectExpr(*expressions(spelled))
    # one piece for a place: the smallest of equals. Few are equal, so pieces are dealt by page first, which is where all that follows wants them
    one = rows.withColumn("page", F.col("page").cast("long")).repartition("doc", "page").groupBy("doc", "page", F.col("item").cast("long").alias("item")).agg(F.min(F.struct("str", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "width", F.col("height").cast("double").alias("height"), "eol")).alias("m"))
    return one.select("doc", "page", "item", "m.*")


K = ["doc", "page"]
_COLUMNS = f"""{_SQL}, g AS (SELECT *, x - lag(x) OVER (PARTITION BY doc, page ORDER BY x) AS g FROM a WHERE trim(str) <> ''),
b AS (SELECT doc, page, count(*) AS n, max(coalesce(g, 0)) AS g, arg_max(x, {{g: coalesce(g, 0), x: -x}}) AS top FROM g GROUP BY 1, 2), m AS (SELECT *, top - g / 2 AS split FROM b),
s AS (SELECT m.doc, m.page, count(*) FILTER (a.x < split) AS l, count(*) FILTER (a.x >= split) AS r FROM m JOIN a ON a.doc = m.doc AND a.page = m.page AND trim(str) <> '' GROUP BY 1, 2),
c AS (SELECT m.doc, m.page, CASE WHEN n >= 6 AND g > 595 * 0.22 AND least(l, r) >= 2 THEN 2 ELSE 1 END AS columns, CASE WHEN n >= 6 AND g > 595 * 0.22 AND least(l, r) >= 2 THEN split END AS split FROM m JOIN s ON s.doc = m.doc AND s.page = m.page)"""
register("page_columns", f"WITH {_COLUMNS} SELECT * FROM c")(lambda spark, sf: L.columns(pieces(spark, sf), K))

_LINES = f"""vt AS (SELECT doc, page, greatest(1.5, median(height) * 0.45) AS tol FROM a GROUP BY 1, 2),
vr AS (SELECT a.doc, a.page, item, y, tol, row_number() OVER (PARTITION BY a.doc, a.page ORDER BY item) AS k FROM a JOIN vt ON vt.doc = a.doc AND vt.page = a.page),
vl AS (SELECT doc, page, item, k, 0::BIGINT AS line, [y] AS ys, [1] AS ns FROM vr WHERE k = 1
  UNION ALL SELECT doc, page, item, k, coalesce(hit, len(ys))::BIGINT, CASE WHEN hit IS NULL THEN ys || [y] ELSE list_transform(ys, lambda v, i: CASE WHEN i = hit + 1 THEN (v * ns[i] + y) / (ns[i] + 1) ELSE v END) END,
    CASE WHEN hit IS NULL THEN ns || [1] ELSE list_transform(ns, lambda v, i: CASE WHEN i = hit + 1 THEN v + 1 ELSE v END) END
  FROM (SELECT vr.*, vl.ys, vl.ns, list_position([abs(v - vr.y) <= vr.tol FOR v IN vl.ys], true) - 1 AS hit FROM vl JOIN vr ON vr.doc = vl.doc AND vr.page = vl.page AND vr.k = vl.k + 1))"""
register("visual_lines", f"WITH RECURSIVE {_SQL}, {_LINES} SELECT doc, page, item, line FROM vl")(lambda spark, sf: L.lines(pieces(spark, sf), K).select("doc", "page", "item", "line"))
register("reading_order", f"""
WITH RECURSIVE {_COLUMNS}, {_LINES}, f AS (SELECT doc, page, 2 * count(*) FILTER (page % 5 = 0 AND item % 3 > 0) > count(*) AS rtl FROM a GROUP BY 1, 2),
z AS (SELECT a.*, line, split, rtl, round(avg(y) OVER (PARTITION BY a.doc, a.page, line), 6) AS band, split IS NOT NULL AND (width * 6 > 416.5 OR x < split AND x + width * 6 > split) AS spans, (split IS NOT NULL AND x >= split)::INT AS col
  FROM a JOIN vl USING (doc, page, item) LEFT JOIN c USING (doc, page) JOIN f USING (doc, page))
SELECT doc, page, item, row_number() OVER (PARTITION BY doc, page ORDER BY band DESC, line, CASE WHEN spans THEN 0 ELSE 1 END, CASE WHEN spans THEN 0 WHEN rtl THEN -col ELSE col END, CASE WHEN rtl THEN -x ELSE x END, item) - 1 AS place,
  CASE WHEN spans THEN -1 ELSE col END AS "column" FROM z""")(
    lambda spark, sf: L.reading_order(pieces(spark, sf).withColumn("width", F.col("width") * 6).withColumn("rtl", F.expr("page % 5 = 0 AND item % 3 > 0")), K).select(*K, "item", "place", "column")
)


def _line_texts(spark, sf):
    p = pieces(spark, sf).withColumn("line", F.floor("y").cast("long") % 5)
    return L.line_texts(p, K).select("doc", "page", "line", "text", "x", F.round("y", 6).alias("y"), "width")


register("line_texts", f"""
WITH {_SQL}, l AS (SELECT *, floor(y)::BIGINT % 5 AS line FROM a), w AS (SELECT *, lag(x + width) OVER o AS e, lag(str) OVER o AS before FROM l WINDOW o AS (PARTITION BY doc, page, line ORDER BY x, item)),
s AS (SELECT *, CASE WHEN before IS NOT NULL AND x - e > greatest(1, height * 0.15) AND NOT regexp_matches(before, '\\s$') AND NOT regexp_matches(str, '^\\s') THEN ' ' ELSE '' END || str AS s FROM w)
SELECT doc, page, line, trim(regexp_replace(string_agg(s, '' ORDER BY x, item), '\\s+', ' ', 'g')) AS text, min(x) AS x, round(avg(y), 6) AS y, greatest(0, arg_max(x + width, {{x: x, e: x + width}}) - min(x)) AS width FROM s GROUP BY 1, 2, 3""")(_line_texts)

register("boundaries", f"""
WITH {_COLUMNS}, j AS (SELECT a.*, split FROM a LEFT JOIN c ON c.doc = a.doc AND c.page = a.page),
w AS (SELECT *, lead(page) OVER o AS p2, lead(item) OVER o AS i2, lead(str) OVER o AS s2, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(width) OVER o AS w2, lead(height) OVER o AS h2 FROM j WINDOW o AS (PARTITION BY doc ORDER BY page, item)),
k AS (SELECT *, CASE WHEN page <> p2 THEN 'page' WHEN split IS NOT NULL AND width <= 416.5 AND w2 <= 416.5 AND (x < split) <> (x2 < split) THEN 'column' WHEN abs(y - y2) <= greatest(1.5, greatest(height, h2, 8) * 0.45::DOUBLE) THEN 'gap' ELSE 'wrap' END AS kind FROM w WHERE i2 IS NOT NULL)
SELECT doc, item AS left_item, i2 AS right_item, kind, CASE WHEN regexp_matches(str, '-$') THEN 'hyphen' WHEN regexp_matches(str, '\\s$') THEN 'space' WHEN eol THEN 'eol' ELSE '' END AS separator,
  CASE WHEN regexp_matches(str, '-$') THEN left(str, length(str) - 1) || '-' ELSE trim(str) END AS left_word, regexp_extract(s2, '^\\s*(\\p{{L}}[\\p{{L}}\\p{{M}}''’-]*)', 1) AS right_word, CASE kind WHEN 'gap' THEN x2 - x - width ELSE 0 END AS gap, y - y2 AS step, false AS stopped FROM k""")(
    lambda spark, sf: (lambda p: L.boundaries(p, "doc", ["page", "item"], L.columns(p, K), K))(pieces(spark, sf))
)
register("page_quality", f"""
WITH {_SQL}, p AS (SELECT DISTINCT doc, page + 1 AS page FROM a), n AS (SELECT doc, page, count(*) AS n, sum(length(str))::BIGINT AS chars, avg(width * 2) AS mean, count(*) FILTER (width * 2 < 85) AS low FROM a GROUP BY 1, 2)
SELECT coalesce(n.doc, p.doc) AS doc, coalesce(n.page, p.page) AS page, coalesce(n, 0) AS pieces, coalesce(chars, 0)::BIGINT AS chars, mean, coalesce(low, 0) AS low FROM p FULL JOIN n ON n.doc = p.doc AND n.page = p.page""")(
    lambda spark, sf: (lambda p: L.page_quality(p.withColumn("score", F.col("width") * 2), p.select("doc", (F.col("page") + 1).alias("page")).distinct(), K, "score"))(pieces(spark, sf))
)


def _letters_kept(spark, sf):
    """Texts without a letter or digit have nothing to keep."""
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    changed = F.expr("IF(doc_id % 4 = 3, concat(text, ' x'), replace(text, '\n', ' - '))")
    return L.same_letters(d.select("doc_id", F.explode(F.split("text", "\n")).alias("str")), d.select("doc_id", changed.alias("text")), "doc_id")


register("letters_kept", "SELECT doc_id, doc_id % 4 <> 3 AS kept FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')")(_letters_kept)
register("touching_boxes", f"""
WITH {_SQL} SELECT a.doc, a.page, a.item AS a, b.item AS b FROM a JOIN a b ON a.doc = b.doc AND a.page = b.page AND a.item < b.item AND a.x - 8 <= b.x + b.width AND b.x - 8 <= a.x + a.width AND a.y - 8 <= b.y + b.height AND b.y - 8 <= a.y + a.height""")(
    lambda spark, sf: B.touching(pieces(spark, sf).select("doc", "page", F.col("item").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1")), K)
)


def _boxes(spark, sf):
    """Boxes of line items, several pages of an order's size thrown together so that chains form."""
    least = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")]
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least)
    rows = rows.selectExpr("l_orderkey div 40 AS page", "l_orderkey * 10 + l_linenumber AS id", "(l_partkey * 7 + l_orderkey * 131 + l_linenumber * 457) % 1900 AS x0", "l_orderkey % 40 * 120 + l_linenumber * 4 AS y0", "l_quantity", "l_returnflag")
    return rows.selectExpr("page", "id", "x0", "y0", "x0 + l_quantity * 3 AS x1", "y0 + l_quantity * 2 AS y1", "l_returnflag = 'N' AS repeated")


def _merged_sql(rounds: int = 16) -> str:
    """Rounds of: boxes that reach each other become one. What still met after the last round would show as a difference."""
    sql = """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2),
s0 AS (SELECT l_orderkey // 40 AS page, l_orderkey * 10 + l_linenumber AS id, ((l_partkey * 7 + l_orderkey * 131 + l_linenumber * 457) % 1900)::DOUBLE AS x0, (l_orderkey % 40 * 120 + l_linenumber * 4)::DOUBLE AS y0,
  x0 + l_quantity * 3 AS x1, y0 + l_quantity * 2 AS y1, l_returnflag = 'N' AS repeated, 1 AS boxes FROM o)"""
    for k in range(rounds):
        sql += f""",
m{k} AS MATERIALIZED (SELECT a.page, a.id AS a, b.id AS b FROM s{k} a JOIN s{k} b ON a.page = b.page AND a.x0 - 8 <= b.x1 AND b.x0 - 8 <= a.x1 AND a.y0 - 8 <= b.y1 AND b.y0 - 8 <= a.y1),
r{k} AS (SELECT page, id, id AS root FROM s{k} UNION SELECT r.page, r.id, m.b FROM r{k} r JOIN m{k} m ON m.page = r.page AND m.a = r.root),
s{k + 1} AS MATERIALIZED (SELECT s.page, root AS id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_and(repeated) AS repeated, sum(boxes)::BIGINT AS boxes
  FROM s{k} s JOIN (SELECT page, id, min(root) AS root FROM r{k} GROUP BY 1, 2) g ON g.page = s.page AND g.id = s.id GROUP BY 1, 2)"""
    return f"{sql}\nSELECT * FROM s{rounds}"


register("merged_boxes", _merged_sql())(lambda spark, sf: B.merged(_boxes(spark, sf), ["page"]))
register("structure_roles", """
WITH r AS (SELECT l_orderkey, min(l_returnflag) AS role FROM lineitem GROUP BY 1 HAVING min(l_returnflag) = max(l_returnflag)) SELECT o_orderkey, role FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")(
    lambda spark, sf: L.structure_roles(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("role")), ["o_orderkey"])
)
_CHAPTERS = "c AS (SELECT DISTINCT l_orderkey AS key, l_partkey * 37 % 9000 AS position, 9000 AS length FROM lineitem)"
register("thinned_chapters", f"""
WITH RECURSIVE {_CHAPTERS}, n AS (SELECT key, position, length, count(*) OVER (PARTITION BY key) AS n, min(position) OVER (PARTITION BY key) AS first, row_number() OVER (PARTITION BY key ORDER BY position DESC) AS k FROM c),
m AS (SELECT *, least(1200, floor(length / greatest(4, n * 2))) AS gap FROM n),
g AS (SELECT key, position, first, k, length - position >= gap AS ok, CASE WHEN length - position >= gap THEN position ELSE length END AS after FROM m WHERE k = 1
  UNION ALL SELECT m.key, m.position, m.first, m.k, g.after - m.position >= m.gap, CASE WHEN g.after - m.position >= m.gap THEN m.position ELSE g.after END FROM g JOIN m ON m.key = g.key AND m.k = g.k + 1)
SELECT key, position FROM g WHERE ok OR position = first""")(
    lambda spark, sf: L.thin_chapters(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") * 37 % 9000).alias("position"), F.lit(9000).alias("length")).distinct(), "key", "length")
)
_COST = "SELECT conv_id, turn, sum(length(coalesce(text, ''))) AS cost FROM conversations GROUP BY 1, 2"


def _clock(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("cost"))
    return L.speech_clock(c, "conv_id", "turn", "cost")


register("speech_clock", f"""
WITH c AS ({_COST}) SELECT conv_id, turn, cost::BIGINT AS cost, (sum(cost) OVER w - cost)::BIGINT AS before, coalesce((sum(cost) OVER w - cost) / nullif(sum(cost) OVER (PARTITION BY conv_id), 0), 0) AS share FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")(_clock)
register("place_at_time", f"""
WITH c AS ({_COST}), s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS run, sum(cost) OVER (PARTITION BY conv_id) AS total FROM c) SELECT conv_id, min(turn) AS turn FROM s WHERE run >= (conv_id % 5 / 4) * total GROUP BY 1""")(
    lambda spark, sf: L.place_at(_clock(spark, sf), table(spark, sf, "conversations").selectExpr("conv_id", "conv_id % 5 / 4 AS fraction").distinct(), "conv_id", "turn", "cost")
)
register("pause_costs", "SELECT o_orderkey, [27, 11, 19, 8, 1][(o_orderkey % 5)::INT + 1] AS cost FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", L.next_cost(F.expr("CASE o_orderkey % 5 WHEN 0 THEN '\n\nAb' WHEN 1 THEN '\nab' WHEN 2 THEN '». Y' WHEN 3 THEN ', y ' ELSE 'abc' END")).alias("cost"))
)
register("median_height", f"WITH {_SQL} SELECT doc, median(CASE WHEN width > 10 THEN width END) AS median FROM a GROUP BY 1 HAVING count(*) FILTER (width > 10) > 0")(
    lambda spark, sf: pieces(spark, sf).withColumn("w", F.when(F.col("width") > 10, F.col("width"))).groupBy("doc").agg(L.median("w").alias("median")).where("median > 0")
)
