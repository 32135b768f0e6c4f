"""Queries of names, number words, glossaries, findings and clean segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import naming as N
from strandline.functions.normal import only_sound, spoken
from strandline.operators import segments as G
from strandline.operators import validate as V
from strandline.plans.registry import register
from strandline.sources.tables import table


def orders(spark, sf, expr: str):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(expr).alias("t"))


register("language_names", "SELECT o_orderkey, ['en', 'de', 'fa', 'pt', '', 'es'][(o_orderkey % 6)::INT + 1] AS code FROM orders")(
    lambda spark, sf: orders(spark, sf, "element_at(array('English', 'german', ' Farsi', 'pt_BR', 'klingon', 'ES'), int(o_orderkey % 6) + 1)").select("o_orderkey", N.language_code(F.col("t")).alias("code"))
)
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
register("spanish_numbers", f"""
WITH n AS (SELECT o_orderkey, o_orderkey % 10001 AS n FROM orders), d AS (SELECT *, n // 1000 AS t, n // 100 % 10 AS h, n % 100 AS r FROM n)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'cero' WHEN n > 9999 THEN n::VARCHAR ELSE concat_ws(' ', CASE WHEN t = 1 THEN 'mil' WHEN t > 1 THEN {_LIST(N.ONES)}[t] || ' mil' END, CASE WHEN h = 1 AND r = 0 THEN 'cien' WHEN h > 0 THEN {_LIST(N.HUNDREDS)}[h] END,
  CASE WHEN r BETWEEN 1 AND 29 THEN {_LIST(N.ONES)}[r] WHEN r >= 30 THEN {_LIST(N.TENS)}[r // 10 - 2] || CASE WHEN r % 10 > 0 THEN ' y ' || {_LIST(N.ONES)}[r % 10] ELSE '' END END) END AS words FROM d""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", N.spanish_number(F.col("o_orderkey") % 10001).alias("words"))
)
register("graphemes", "SELECT conv_id, turn, length_grapheme(coalesce(text, '') || 'é👍🏽')::INT AS n FROM conversations")(
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", F.size(N.graphemes(F.concat(F.coalesce("text", F.lit("")), F.lit("é👍🏽")))).alias("n"))
)
register("text_hashes", "SELECT conv_id, turn, list_reduce([0::BIGINT] || [unicode(c)::BIGINT FOR c IN string_split(lower(coalesce(text, '')), '') IF c <> ''], lambda h, c: ((h * 31 + c) & 4294967295)::BIGINT) AS h FROM conversations")(
    lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", N.hash31(F.col("text")).alias("h"))
)
register("glossaries", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Alpha|beta|Gamma ' || o_orderstatus WHEN 1 THEN 'one|two' ELSE '' END AS terms FROM orders")(
    lambda spark, sf: orders(spark, sf, "CASE o_orderkey % 3 WHEN 0 THEN concat('Alpha, beta;ALPHA\n\nGamma ', o_orderstatus, ', Beta') WHEN 1 THEN 'one,two, an overlong term here,six' ELSE ' ,; ' END").select("o_orderkey", F.array_join(N.glossary(F.col("t"), 22), "|").alias("terms"))
)
register("sure_findings", "SELECT l_orderkey, l_linenumber, l_linenumber BETWEEN 1 AND 3 AND l_returnflag <> 'R' AND l_linestatus = 'O' AND l_partkey % 5 > 0 AS sure FROM lineitem")(
    lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.sure_finding(F.expr("IF(l_partkey % 5 = 0, ' ', 'x')"), F.col("l_linenumber"), F.expr("IF(l_returnflag = 'R', 'style', 'Grammar')"), F.expr("IF(l_linestatus = 'O', 'misspelling', 'locale')")).alias("sure"))
)
register("separators", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '' WHEN 'R' THEN chr(10) || chr(10) ELSE ' ' END AS sep FROM lineitem")(
    lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.separator(F.expr("CASE l_returnflag WHEN 'A' THEN 'join' WHEN 'R' THEN 'paragraph' ELSE 'pending' END")).alias("sep"))
)


def _clean(spark, sf):
    s = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "turn * 2000 AS start", "turn * 2000 + 1000 + (conv_id + turn) % 5 * 700 AS end", "IF(turn % 4 = 3, '[music] ♪', concat('>> ', regexp_replace(coalesce(text, ''), '[\\\\[\\\\]()♪<>]', ' '))) AS raw")
    s = s.withColumn("text", spoken(F.col("raw"))).where(~only_sound(F.col("raw")))
    return G.clip_overlaps(s, "conv_id", "start", "end", "turn", 250).select("conv_id", "turn", "start", "end", F.md5("text").alias("digest"))


register("clean_segments", r"""
WITH t AS (SELECT conv_id, turn, turn * 2000 AS s, turn * 2000 + 1000 + (conv_id + turn) % 5 * 700 AS e, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\[\]()♪<>]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM conversations WHERE turn % 4 <> 3),
k AS (SELECT *, lead(s) OVER (PARTITION BY conv_id ORDER BY s, turn) AS nx FROM t WHERE regexp_matches(t, '[\p{L}\p{N}]'))
SELECT conv_id, turn, s AS start, greatest(least(e, coalesce(nx, e)), s + 250) AS "end", md5(t) AS digest FROM k""")(_clean)

register("accuracy_report", """
WITH w AS (SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE len(string_split(trim(p_type), ' ')) END / greatest(1, len(regexp_extract_all(lower(p_name), '[a-z0-9áéíóúüñ]+'))) AS wer FROM part)
SELECT p_brand, count(*) AS samples, round(avg(wer), 4) AS mean_wer, round(avg((wer <= 0.05)::INT), 4) AS success FROM w GROUP BY 1""")(
    lambda spark, sf: table(spark, sf, "part").select("p_brand", V.word_error_rate(F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.regexp_replace("p_type", r"[a-zA-Z0-9]+", "zz")))).alias("wer"))
    .groupBy("p_brand").agg(F.count("*").alias("samples"), F.round(F.avg("wer"), 4).alias("mean_wer"), F.round(F.avg((F.col("wer") <= 0.05).cast("int")), 4).alias("success"))
)
