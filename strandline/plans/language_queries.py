"""Queries of language evidence and of checks on transformed texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import language as L
from strandline.operators import validate as V
from strandline.plans.registry import register
from strandline.sources.tables import table

#: Customers' names among letters of another script, in growing shares.
_SCRIPT = "concat(repeat(CASE c_custkey % 5 WHEN 0 THEN 'привет' WHEN 1 THEN '漢字かな' WHEN 2 THEN 'שלום' WHEN 3 THEN 'ελ' ELSE 'abc' END, int(c_custkey % 7)), c_name)"
_LETTERS = "regexp_replace(t, '[^\\p{L}]', '', 'g')"
_SHARES = ", ".join(f"length(regexp_replace({_LETTERS}, '[^{c}]', '', 'g')) / length({_LETTERS}) AS {k}" for k, c in L.SCRIPTS.items())
_CASES = lambda said: "CASE " + " ".join(f"WHEN {k} >= 0.3 THEN {said(k)}" for k in L.SCRIPTS)
register("script_language", f"""
WITH s AS (SELECT c_custkey, {_SHARES} FROM (SELECT c_custkey, {_SCRIPT.replace("int(c_custkey % 7)", "c_custkey % 7")} AS t FROM customer))
SELECT c_custkey, {_CASES(lambda k: f"'{k}'")} ELSE '' END AS lang, {_CASES(lambda k: f"round(least(0.95, 0.6 + {k} * 0.35), 3)")} ELSE 0 END::DOUBLE AS confidence FROM s""")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", L.script_language(F.expr(_SCRIPT)).alias("s")).select("c_custkey", "s.*")
)

_PLAIN = lambda ws: ", ".join(f"'{w}'" for w in ws if w == w.translate(str.maketrans(T.ACCENTED, T.PLAIN)))
register("word_evidence", f"""
WITH h AS (SELECT doc_id, substr(coalesce(text, ''), 1, {L.WORD_CHARS}) AS h FROM documents), t AS (SELECT *, regexp_extract_all(lower(h), '[a-záéíóúüñ]+') AS t FROM h),
p AS (SELECT *, [translate(w, '{T.ACCENTED}', '{T.PLAIN}') FOR w IN t] AS p FROM t),
n AS (SELECT doc_id, len(t) AS n, len([w FOR w IN p IF w IN ({_PLAIN(L.ENGLISH)})]) + least(12, 3 * len(regexp_extract_all(h, '(?i)[\\p{{L}}\\p{{N}}_]+''(?:s|t|re|ve|ll|d|m)(?:[^\\p{{L}}\\p{{N}}_]|$)'))) AS en,
  len([w FOR w IN p IF w IN ({_PLAIN(L.SPANISH)})]) + least(12, 3 * (len(regexp_extract_all(h, '(?i)[ñ¿¡]')) + len(regexp_extract_all(h, '(?i)[a-z][áéíóú]')))) AS es FROM p),
m AS (SELECT *, greatest(en, es) AS hi, least(en, es) AS lo, en = es OR n = 0 AS tie FROM n)
SELECT doc_id, CASE WHEN tie THEN '' WHEN en > es THEN 'en' ELSE 'es' END AS lang, CASE WHEN tie THEN 0 ELSE greatest(0, least(0.95, round((hi - lo) / (hi + lo) * least(1, hi / n / 0.12::DOUBLE) * least(1, n / 80), 3))) END::DOUBLE AS confidence,
  n::INT AS words, CASE WHEN tie THEN 0 ELSE round(hi / n, 3) END::DOUBLE AS density FROM m""")(
    lambda spark, sf: L.word_evidence(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")
)

_CODE = lambda c: f"CASE ({c}) % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'es' WHEN 2 THEN 'en' ELSE '' END"
_SIGNALS = [("declared_audio", "c_custkey", None), ("generated_track", "c_nationkey", None), ("words", "c_custkey + c_nationkey", "(c_custkey % 10) / 10"), ("provider", "c_custkey * 3", None)]


def _fused(spark, sf):
    signals = [L.signal(F.lit(n), F.expr(_CODE(c)), F.expr(v) if v else F.lit(None).cast("double")) for n, c, v in _SIGNALS]
    got = L.fuse(table(spark, sf, "customer").select("c_custkey", F.array(*signals).alias("signals")), "signals").drop("signals")
    return got.withColumn("action", L.dubbing(F.col("lang"), F.col("confidence"), F.when(F.col("c_custkey") % 9 == 0, "user").otherwise("server"), F.col("conflict")))


_ROWS = " UNION ALL ".join(f"SELECT c_custkey, split_part({_CODE(c)}, '-', 1) AS l, round({f'least({L.WEIGHTS[n]}, {v})' if v else L.WEIGHTS[n]}, 3)::DOUBLE AS c, {i} AS i FROM customer" for i, (n, c, v) in enumerate(_SIGNALS))
register("language_fusion", f"""
WITH s AS (SELECT * FROM ({_ROWS}) WHERE l <> ''), b AS (SELECT c_custkey, arg_max(l, c * 10 - i / 1000) AS lang, max(c) AS top FROM s GROUP BY 1),
j AS (SELECT c_custkey, b.lang, list(c ORDER BY c DESC) FILTER (l = b.lang) AS same, max(c) FILTER (l <> b.lang) AS against FROM s JOIN b USING (c_custkey) GROUP BY 1, 2),
f AS (SELECT *, list_reduce(same, lambda x, y: x + (1 - x) * y * 0.45::DOUBLE) AS sure FROM j),
a AS (SELECT c_custkey, coalesce(lang, '') AS lang, coalesce(greatest(0, least(0.99, round(sure - coalesce(against, 0) * 0.6::DOUBLE, 3))), 0)::DOUBLE AS confidence, against IS NOT NULL AS conflict FROM customer LEFT JOIN f USING (c_custkey))
SELECT *, CASE WHEN lang = '' OR conflict OR NOT (c_custkey % 9 = 0 AND true OR confidence >= 0.7) THEN 'ask' WHEN lang = 'es' THEN 'none' ELSE 'dub' END AS action FROM a""")(_fused)

#: What is done to a document's text by its number.
_CHANGED = """CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN {digits} WHEN 2 THEN concat(text, ' see https://a.example/x and 77345 NASA') WHEN 3 THEN substr(text, 1, {half})
  WHEN 4 THEN concat(text, ' ', text, ' ', text) WHEN 5 THEN '' WHEN 6 THEN {joined} ELSE concat(text, ' mail to a.b@c.example') END"""
_SQL = _CHANGED.format(digits="regexp_replace(text, '[0-9]', '', 'g')", half="length(text) // 2", joined="replace(text, chr(10), ' ')")
_SPARK = _CHANGED.format(digits="regexp_replace(text, '[0-9]', '')", half="int(length(text) div 2)", joined="replace(text, '\n', ' ')")
_LOST = lambda a, b: f"[x FOR x IN list_distinct({a}) IF len(list_filter({a}, lambda y: y = x)) > len(list_filter({b}, lambda y: y = x))]"
_FOUND = lambda c, p: f"[lower(rtrim(m, '.,;:!?')) FOR m IN regexp_extract_all({c}, '{p}')]"


def _changed(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.expr(_SPARK).alias("changed"))
    got = V.check(d, "text", "changed")
    return got.select("doc_id", F.array_join(F.transform(F.filter("issues", lambda i: i["code"].isin("empty", "omission", "invention", "length", "unchanged", "missing_links", "invented_links", "missing_mails", "invented_mails", "paragraphs")), lambda i: i["code"]), ",").alias("issues"))


_WORDS = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_''-]+'))"
_BARE = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"
_PARTS = "len([p FOR p IN regexp_split_to_array({0}, '\\n\\s*\\n') IF trim(p) <> ''])"
_URL, _AT = '(?i)https?://[^\\s<>"]+|www\\.[^\\s<>"]+', "[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}"
register("transformed_text", f"""
WITH d AS (SELECT doc_id, trim(text) AS a, trim({_SQL}) AS b FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, {_WORDS.format('a')} AS na, {_WORDS.format('b')} / greatest(1, {_WORDS.format('a')}) AS r, {_FOUND('a', _URL)} AS la, {_FOUND('b', _URL)} AS lb, {_FOUND('a', _AT)} AS ma, {_FOUND('b', _AT)} AS mb FROM d)
SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN b = '' THEN 'empty' END, CASE WHEN na >= 8 AND r < 0.48 THEN 'omission' END, CASE WHEN na >= 8 AND r > 2.15 THEN 'invention' END,
  CASE WHEN na >= 8 AND r BETWEEN 0.48 AND 2.15 AND NOT r BETWEEN 0.62 AND 1.75 THEN 'length' END, CASE WHEN na >= 5 AND {_BARE.format('a')} = {_BARE.format('b')} THEN 'unchanged' END,
  CASE WHEN len({_LOST('la', 'lb')}) > 0 THEN 'missing_links' END, CASE WHEN len({_LOST('lb', 'la')}) > 0 THEN 'invented_links' END,
  CASE WHEN len({_LOST('ma', 'mb')}) > 0 THEN 'missing_mails' END, CASE WHEN len({_LOST('mb', 'ma')}) > 0 THEN 'invented_mails' END,
  CASE WHEN {_PARTS.format('a')} > 3 AND {_PARTS.format('b')} * 2 <= {_PARTS.format('a')} THEN 'paragraphs' END] IF x IS NOT NULL], ',') AS issues FROM n""")(_changed)

register("number_check", """
WITH p AS (SELECT o_orderkey, (o_orderkey % 900)::VARCHAR AS a, (o_orderkey % 30)::VARCHAR AS b, o_orderkey % 4 AS k FROM orders),
w AS (SELECT *, CASE k WHEN 0 THEN a WHEN 1 THEN '1' || a || '9' WHEN 2 THEN '' ELSE b END AS d FROM p)
SELECT o_orderkey, CASE WHEN contains(d, a) OR (k = 2 AND a IN ('7', '20')) THEN '' ELSE a END AS missing FROM w""")(
    lambda spark, sf: table(spark, sf, "orders").selectExpr("o_orderkey", "concat('in all ', o_orderkey % 900, ' were') AS a",
        "CASE o_orderkey % 4 WHEN 0 THEN concat('eran ', o_orderkey % 900) WHEN 1 THEN concat('x1', o_orderkey % 900, '9') WHEN 2 THEN 'siete y veinte' ELSE concat(o_orderkey % 30, '.') END AS b")
    .select("o_orderkey", V.listed(V.really_lost(V.lost(V.numbers(F.col("a")), V.numbers(F.col("b"))), V.digits(F.col("b")), F.col("b"))).alias("missing"))
)
register("lost_terms", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nato' WHEN 2 THEN '' WHEN 3 THEN 'nato,node.js' ELSE 'node.js' END AS lost FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", F.array_join(V.lost_terms(F.lit("The NATO said OK to Node.js"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'NATO y Node.js' WHEN 1 THEN 'con Node.js' WHEN 2 THEN 'la otan y un node.js' WHEN 3 THEN 'nada' ELSE 'OTAN' END")), ",").alias("lost"))
)
register("words_kept", "SELECT o_orderkey, o_orderkey % 3 <> 2 AS kept FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", V.words_kept(F.lit("one (two) three"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'one, two three.' WHEN 1 THEN ' one\ntwo «three»' ELSE 'one three two' END")).alias("kept"))
)
register("word_error_rate", """
WITH w AS (SELECT p_partkey, coalesce(regexp_extract_all(lower(p_name), '[a-z0-9áéíóúüñ]+'), []) AS a, coalesce(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9áéíóúüñ]+'), []) AS b FROM part),
c AS (SELECT *, list_distinct(a || b) AS v FROM w), s AS (SELECT *, array_to_string([chr((64 + list_position(v, x))::INT) FOR x IN a], '') AS sa, array_to_string([chr((64 + list_position(v, x))::INT) FOR x IN b], '') AS sb FROM c)
SELECT p_partkey, levenshtein(sa, sb)::INT AS edits, round(levenshtein(sa, sb) / greatest(1, len(a)), 6) AS wer FROM s""")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", V.edits(V.tokens(F.col("p_name")), V.tokens(F.concat_ws(" ", "p_type", "p_name"))).alias("edits"),
        F.round(V.word_error_rate(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("wer"))
)
