"""Queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import merge, quality, search
from strandline.plans.registry import register
from strandline.sources.tables import table

FOLD = f"translate(lower(%s), '{T.ACCENTED}', '{T.PLAIN}')"
WORDS = f"coalesce(regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{N}}]+'), [])"
QUESTION = "license version the that"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOP))
_M = "CASE WHEN length(w) > 6 AND suffix(w, 'mente') THEN left(w, length(w) - 5) ELSE w END"
_STEM = """CASE WHEN length(v) > 5 AND suffix(v, 'ces') THEN left(v, length(v) - 3) || 'z' WHEN length(v) > 4 AND suffix(v, 'es') THEN left(v, length(v) - 2)
  WHEN length(v) > 3 AND suffix(v, 's') THEN left(v, length(v) - 1) ELSE v END"""
_RAW = f"[w FOR w IN regexp_split_to_array({FOLD % 'text'}, '[^a-z0-9]+') IF length(w) >= 2 AND w NOT IN ({_STOP})]"
TERMS = f"[x FOR x IN [{_STEM} FOR v IN [{_M} FOR w IN {_RAW}]] IF length(x) >= 2 AND x NOT IN ({_STOP})]"

register("bm25_search", f"""
WITH d AS (SELECT doc_id, coalesce({TERMS}, []) AS t FROM documents), e AS (SELECT * FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM e),
q AS (SELECT unnest(['license', 'version']) AS term),
f AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM e, q),
df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM f GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
FROM f JOIN df USING (term), s GROUP BY doc_id HAVING score > 0 ORDER BY score DESC, doc_id LIMIT 10""")(
    lambda spark, sf: search.bm25(table(spark, sf, "documents"), QUESTION)
)

register("term_stats", f"""
WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term""")(
    lambda spark, sf: search.term_stats(table(spark, sf, "documents"))
)

register("filter_all_words", f"""
SELECT doc_id, source FROM documents
WHERE contains({FOLD % "concat_ws(' ', source, text)"}, 'src1') AND contains({FOLD % "concat_ws(' ', source, text)"}, 'license')""")(
    lambda spark, sf: search.contains_all(table(spark, sf, "documents"), ["source", "text"], "src1 license").select("doc_id", "source")
)

register("first_hit_snippet", """
WITH h AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k
  FROM conversations WHERE contains(lower(text), 'the'))
SELECT conv_id, turn, substr(text, greatest(instr(lower(text), 'the') - 40, 1), 140) AS snippet FROM h WHERE k = 1""")(
    lambda spark, sf: search.first_hit(table(spark, sf, "conversations"), "conv_id", "turn", "text", "the")
)

register("substring_hits", """
SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS hits
FROM documents WHERE contains(lower(text), 'the')""")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.hits(F.col("text"), "the").alias("hits")).where("hits > 0")
)

register("duplicate_groups", """
SELECT md5(text) AS identity, count(*) AS n, max(doc_id) AS canonical FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")(
    lambda spark, sf: merge.duplicate_groups(table(spark, sf, "documents"), F.md5("text"), "doc_id")
)

register("cache_eviction", """
WITH r AS (SELECT lang, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id DESC) AS held, sum(n_chars) OVER (PARTITION BY lang) AS total FROM documents)
SELECT lang, doc_id, n_chars FROM r WHERE total > 200000 AND held > 180000""")(
    lambda spark, sf: merge.evict(table(spark, sf, "documents"), "lang", "doc_id", "n_chars", 200_000)
)

register("consecutive_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
SELECT doc_id, count(*) FILTER (before IS NULL OR before <> line) AS n_lines,
  md5(string_agg(line, chr(10) ORDER BY i) FILTER (before IS NULL OR before <> line)) AS digest FROM k GROUP BY doc_id""")(
    lambda spark, sf: table(spark, sf, "documents")
    .select("doc_id", T.consecutive_distinct(F.split("text", "\n")).alias("l"))
    .select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))
)

register("running_lines", f"""
WITH a AS (SELECT lang, doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT lang, doc_id, [x FOR x IN t IF trim(x) <> ''] AS t FROM a),
e AS (SELECT lang, doc_id, unnest([t[1], t[-1]]) AS line FROM w WHERE len(t) > 0),
l AS (SELECT lang, doc_id, trim(regexp_replace(regexp_replace({FOLD % 'line'}, '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) AS line FROM e WHERE length(line) <= 90),
p AS (SELECT lang, count(DISTINCT doc_id) AS pages FROM a GROUP BY lang)
SELECT l.lang, line, count(DISTINCT doc_id) AS n, pages FROM l JOIN p USING (lang) WHERE line <> '' GROUP BY l.lang, line, pages
HAVING count(DISTINCT doc_id) >= greatest(3, ceil(pages * 0.005))""")(
    lambda spark, sf: search.running_lines(
        table(spark, sf, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")), "lang", "doc_id", "place", "line", share=0.005
    )
)

_counts = ", ".join(f"len(list_filter(t, lambda x: list_contains({w!r}, x)))::BIGINT AS {k}" for k, w in quality.FREQUENT.items())

register("frequent_word_language", f"""
WITH c AS (SELECT doc_id, {_counts} FROM (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '{quality.TITLE_WORD.replace(chr(39), chr(39) * 2)}'), []) AS t FROM documents)),
o AS (SELECT *, list_reverse_sort([en, es, pt, fr, de, it]) AS top FROM c)
SELECT * EXCLUDE (top), CASE WHEN top[1] = 0 OR top[1] = top[2] THEN '' WHEN en = top[1] THEN 'en' WHEN es = top[1] THEN 'es' WHEN pt = top[1] THEN 'pt' WHEN fr = top[1] THEN 'fr' WHEN de = top[1] THEN 'de' ELSE 'it' END AS lang,
  CASE WHEN top[1] = 0 OR top[1] = top[2] THEN 0 ELSE round(least(0.8, 0.35 + 0.5 * (top[1] - top[2]) / top[1] * least(1, top[1] / 4)), 3) END::DOUBLE AS confidence FROM o""")(
    lambda spark, sf: quality.title_language(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")
)


def _script_share(spark, sf):
    """Rounded as SQL rounds: 41 / 640 is just below a half as a double, while F.round takes its decimal digits. A text without letters has 0 / 0."""
    share = quality.script_share(F.col("text"), "IsLatin")
    latin = F.coalesce(F.floor(share * 1e6 + 0.5) / 1e6, F.when(F.col("text").isNotNull(), F.lit(float("nan"))))
    return table(spark, sf, "documents").select("doc_id", latin.alias("latin"))


register("script_share", """
SELECT doc_id, round(length(regexp_replace(substr(text, 1, 4000), '[^\\p{Latin}]', '', 'g')) / length(regexp_replace(substr(text, 1, 4000), '[^\\p{L}]', '', 'g')), 6) AS latin
FROM documents""")(_script_share)


def _numbers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", quality.numbers(F.col("text")).alias("n"))
    one = d.select("doc_id", F.explode("n").alias("number"))
    two = d.select((F.col("doc_id") - 1).alias("doc_id"), F.explode("n").alias("number"))
    return merge.missing_items(one, two).groupBy("doc_id", "number").agg(F.count("*").alias("n"))


register("missing_numbers", """
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents),
lost AS (SELECT doc_id, number FROM n EXCEPT ALL SELECT doc_id - 1, number FROM n)
SELECT doc_id, number, count(*) AS n FROM lost GROUP BY ALL""")(_numbers)

register("strip_html", """
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM a)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM b""")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))
)

register("url_parts", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""")(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("host"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"),
    )
)

register("ordered_page", "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(40)
)

register("title_match", f"""
SELECT p_partkey, round(len(list_filter(w, lambda x: list_contains({WORDS % 'p_type'}, x))) / len(w), 6) AS share
FROM (SELECT *, {WORDS % 'p_name'} AS w FROM part) WHERE len(w) > 0""")(
    lambda spark, sf: table(spark, sf, "part").where(F.size(T.words(F.col("p_name"))) > 0).select("p_partkey", F.round(quality.containment(F.col("p_name"), F.col("p_type")), 6).alias("share"))
)
