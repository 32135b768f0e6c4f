"""Queries that clean, mark and classify texts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import normal as N
from strandline.functions import text as T
from strandline.operators.chunks import sentences
from strandline.plans.registry import register
from strandline.sources.tables import table

FOLD = f"translate(lower(%s), '{T.ACCENTED}', '{T.PLAIN}')"
TEXT = "coalesce(text, '')"


def turns(spark, sf, expr: str = TEXT):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.expr(expr).alias("t"))


def orders(spark, sf, expr: str, name: str = "t"):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(expr).alias(name))


register("atom_text", "SELECT conv_id, turn, md5(regexp_replace('office ' || coalesce(text, '') || ' x', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS digest FROM conversations")(
    lambda spark, sf: turns(spark, sf, "concat('oﬃce ', coalesce(text, ''), ' \u0001x')").select("conv_id", "turn", F.md5(N.atom_text(F.col("t"))).alias("digest"))
)
register("fragments", r"""
SELECT conv_id, turn, coalesce(regexp_extract(coalesce(text, ''), '(\p{L}[\p{L}\p{M}''’-]*)\s*$', 1), '') AS last, coalesce(regexp_extract(coalesce(text, ''), '^\s*(\p{L}[\p{L}\p{M}''’-]*)', 1), '') AS first, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))::INT AS letters FROM conversations""")(
    lambda spark, sf: turns(spark, sf).select("conv_id", "turn", N.last_fragment(F.col("t")).alias("last"), N.first_fragment(F.col("t")).alias("first"), F.length(N.without_blanks(F.concat(F.col("t"), F.lit("­")))).alias("letters"))
)
register("long_tokens", "SELECT o_orderkey, o_orderkey % 6 < 4 AS long, o_orderkey % 3 = 0 AS sha FROM orders")(
    lambda spark, sf: orders(spark, sf, "CASE o_orderkey % 6 WHEN 0 THEN 'HTTPS://a.b/c' WHEN 1 THEN 'x@y.org' WHEN 2 THEN '12+34-56*(78.9)' WHEN 3 THEN repeat('a', 90) WHEN 4 THEN '12+3' ELSE concat(repeat('a ', 60)) END").select(
        "o_orderkey", N.long_token(F.col("t")).alias("long"), N.is_sha(F.expr("IF(o_orderkey % 3 = 0, sha2('x', 256), 'abc')")).alias("sha"))
)
register("line_keys", f"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace({FOLD % TEXT}, '[0-9]+', '', 'g'), '\\s+', ' ', 'g'))) AS key FROM conversations")(
    lambda spark, sf: turns(spark, sf).select("conv_id", "turn", F.md5(N.line_key(F.col("t"))).alias("key"))
)
_SPOKEN = "CASE turn % 6 WHEN 0 THEN concat('[Music] >> ', {0}) WHEN 1 THEN concat({0}, ' (LAUGHS) and (applause) ♪ la la ♪') WHEN 2 THEN '(ohhhhh) [noise] ♪' WHEN 3 THEN concat('(he said) ', {0}) ELSE {0} END"
_BARE = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\[\\]()♪]|>>', ' ', 'g'), '\\s+', ' ', 'g'))"
register("spoken_text", f"SELECT conv_id, turn, CASE turn % 6 WHEN 1 THEN trim({_BARE} || ' and') WHEN 2 THEN '' WHEN 3 THEN trim('(he said) ' || {_BARE}) ELSE {_BARE} END AS said, turn % 6 = 2 OR ({_BARE} = '' AND turn % 6 NOT IN (1, 3)) AS silent FROM conversations")(
    lambda spark, sf: turns(spark, sf, _SPOKEN.format(_BARE.replace(", 'g')", ")").replace("\\", "\\\\"))).select("conv_id", "turn", N.spoken(F.col("t")).alias("said"), N.only_sound(F.col("t")).alias("silent"))
)
register("voice_text", "SELECT o_orderkey, 'continued ' || o_orderpriority AS said FROM orders")(
    lambda spark, sf: orders(spark, sf, "concat('con­tin-\n ued​ ', o_orderpriority, '\u0002')").select("o_orderkey", N.voice_text(F.col("t")).alias("said"))
)
register("said_numerals", """
SELECT o_orderkey, 'Secreto  número ' || o_orderkey || ',  hashtag amor y  número ' AS said, 'Secreto  ' || o_orderkey || ',  amor y  número ' AS anchor FROM orders""")(
    lambda spark, sf: orders(spark, sf, "concat('Secreto #', o_orderkey, ', #amor y #')").select("o_orderkey", N.say_numerals(F.col("t")).alias("said"), N.unsay_numerals(N.say_numerals(F.col("t"))).alias("anchor"))
)
register("answer_text", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || ' of *one' WHEN 1 THEN 'a bold ' || o_orderstatus || ' word' ELSE 'code 2*3*4' END AS said FROM orders")(
    lambda spark, sf: orders(spark, sf, "CASE o_orderkey % 3 WHEN 0 THEN concat('Sure:\n```text\n', o_orderpriority, ' of *one\n```\nbye') WHEN 1 THEN concat(' `a **bold ', o_orderstatus, '** word` ') ELSE 'code 2*3*4' END").select(
        "o_orderkey", N.plain_emphasis(N.answer_text(F.col("t"))).alias("said"))
)
register("segment_markers", "SELECT o_orderkey, o_orderkey % 3 <> 1 AS kept, CASE o_orderkey % 3 WHEN 0 THEN 'uno dos' WHEN 1 THEN 'uno' ELSE 'solo' END AS plain FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 3 = 2, 'alone', '[[SEG_000001]] one [[SEG_000002]] two') AS a",
        "CASE o_orderkey % 3 WHEN 0 THEN '[[SEG_000001]] uno [[SEG_000002]] dos' WHEN 1 THEN '[[SEG_000002]] uno' ELSE '[[SEG_000000]] solo' END AS b")
    .select("o_orderkey", N.markers_kept(F.col("a"), F.col("b")).alias("kept"), N.drop_markers(F.col("b")).alias("plain"))
)
register("spanish_norms", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Lunes: el martes, este y solo en enero.' ELSE 'Aquella vez en el español' END AS said FROM orders")(
    lambda spark, sf: orders(spark, sf, "IF(o_orderkey % 2 = 0, 'Lunes: el Martes, éste y sólo en Enero.', 'Aquélla vez en el Español')").select("o_orderkey", N.spanish_norms(F.col("t")).alias("said"))
)
register("opening_marks", "SELECT o_orderkey, 'Hola. ¿Qué ' || o_orderstatus || '? ¡Ya! ¿Sí?' AS said FROM orders")(
    lambda spark, sf: orders(spark, sf, "concat('Hola. Qué ', o_orderstatus, '? Ya! ¿Sí?')").select("o_orderkey", N.opening_marks(sentences(F.col("t"))).alias("said"))
)
register("marked_terms", "SELECT o_orderkey, 'the `REST API` of `Node.js`, `npm` not npmx ' || o_orderstatus AS marked, 'the REST API of Node.js, npm not npmx ' || o_orderstatus AS plain FROM orders")(
    lambda spark, sf: orders(spark, sf, "concat('the REST API of Node.js, `npm` not npmx ', o_orderstatus)").select("o_orderkey", N.mark_terms(F.col("t")).alias("marked"), N.unmark_terms(N.mark_terms(F.col("t"))).alias("plain"))
)
register("escaped_html", """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM pages""")(
    lambda spark, sf: table(spark, sf, "pages").select("page_id", F.md5(N.escape_html(F.col("html"))).alias("digest"))
)
register("written_rates", """
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 ELSE floor(least(2, greatest(0.25, value / 50)) * 100 + 0.5) / 100 END AS rate, value, event_type FROM events),
p AS (SELECT *, round_even((least(2, greatest(0.75, value / 90)) - 1) * 100, 0)::INT + CASE event_id % 3 WHEN 0 THEN -3 WHEN 1 THEN 3 ELSE 0 END AS n FROM r)
SELECT event_id, rate::DOUBLE AS rate, floor(least(2, greatest(0.5, floor(rate / 0.05 + 0.5) * 0.05)) * 100 + 0.5) / 100 AS control, printf('%+d%%', greatest(-25, least(100, n))) AS prosody FROM p""")(
    lambda spark, sf: table(spark, sf, "events").selectExpr("event_id", "IF(event_id % 4 = 0, 'x', replace(string(value / 50), '.', ',')) AS t", "value / 90 AS r", "CASE event_id % 3 WHEN 0 THEN ' Warm' WHEN 1 THEN 'energetic' END AS tone").select(
        "event_id", N.rate_of(F.col("t")).alias("rate"), N.control_rate(F.col("t")).alias("control"), N.prosody(F.col("r"), F.col("tone")).alias("prosody"))
)
register("untranslated", """
WITH a AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS o FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN o = '' ELSE o = '' OR (length(o) >= 12 AND length(o) - length(trim(substr(o, 1, (length(o) * 0.95)::INT))) < greatest(8, length(o) * 0.12)) OR o = trim(substr(o, 1, (length(o) * 0.95)::INT)) END AS same FROM a""")(
    lambda spark, sf: turns(spark, sf).select("conv_id", "turn", N.untranslated(F.col("t"), F.expr("""CASE turn % 4 WHEN 0 THEN concat('  ', t, '\n') WHEN 1 THEN '  ' WHEN 2 THEN IF(trim(t) = '', '', 'otra cosa muy distinta') ELSE
      substring(lower(trim(regexp_replace(t, '\\\\s+', ' '))), 1, int(round(length(lower(trim(regexp_replace(t, '\\\\s+', ' ')))) * 0.95))) END""")).alias("same"))
)
register("block_kinds", """
SELECT o_orderkey, ['h3', 'ul', 'ol', 'blockquote', 'table', 'h3', 'h3', 'p'][(o_orderkey % 8)::INT + 1] AS kind, ['split', 'none', 'dialogue', 'compound', 'unbreakable', 'split'][(o_orderkey % 6)::INT + 1] AS hyphen, o_orderkey % 5 < 3 AS page, o_orderkey % 4 < 2 AS acronym FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").selectExpr("o_orderkey", """CASE o_orderkey % 8 WHEN 0 THEN '## Título' WHEN 1 THEN '- uno\n- dos' WHEN 2 THEN '1. uno\n 2. dos' WHEN 3 THEN '«uno\n«dos' WHEN 4 THEN '|a|b|\n|c|d|' WHEN 5 THEN 'EL FIN'
          WHEN 6 THEN 'Capítulo dos' ELSE 'El fin de todo.' END AS b""", "CASE o_orderkey % 6 WHEN 0 THEN 'extraor-' WHEN 1 THEN 'fin' WHEN 2 THEN 'dijo —' WHEN 3 THEN 'franco-' WHEN 4 THEN 'a‑' ELSE 'a­' END AS l",
        "IF(o_orderkey % 6 = 3, 'Alemán', ' dinario') AS r", "CASE o_orderkey % 5 WHEN 0 THEN '— 128 —' WHEN 1 THEN 'xiv' WHEN 2 THEN '[7]' WHEN 3 THEN 'mi' ELSE '1984' END AS p", "IF(o_orderkey % 4 < 2, 'AB', 'aB') AS x").select(
        "o_orderkey", N.block_kind(F.col("b")).alias("kind"), N.hyphen_kind(F.col("l"), F.col("r")).alias("hyphen"), N.page_number(F.col("p")).alias("page"), N.split_acronym(F.col("x"), F.lit("CDE")).alias("acronym"))
)
register("raw_transcripts", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'hola a todos ' || o_orderstatus || ' y más' WHEN 1 THEN 'at 3:15 only ' || o_orderstatus ELSE 'uno dos' END AS said FROM orders""")(
    lambda spark, sf: orders(spark, sf, """CASE o_orderkey % 3 WHEN 0 THEN concat('0:14\nhola a todos ', o_orderstatus, '\n0:14\nhola a todos ', o_orderstatus, '\n[1:02:03] - y más') WHEN 1 THEN concat(' at 3:15 only ', o_orderstatus)
      ELSE 'WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>uno</c>\ndos' END""").select("o_orderkey", N.raw_transcript(F.col("t")).alias("said"))
)


def _line_kinds(spark, sf):
    """Every line of every document alone, and with the line after it; page numbers are asked of its first word, acronyms of its first two."""
    d = table(spark, sf, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("l")).where("size(l) > 0")
    d = d.select("doc_id", F.posexplode(F.transform("l", lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get("l", i + 1), F.lit("")).alias("b")))).alias("place", "x")).select("doc_id", "place", "x.*")
    w = F.split("a", " +")
    one, two = F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
    return d.select("doc_id", "place", N.block_kind(F.col("a")).alias("alone"), N.block_kind(F.concat("a", F.lit("\n"), "b", F.lit("."))).alias("both"), N.hyphen_kind(F.concat("a", F.lit("- ")), F.col("b")).alias("hyphen"), N.page_number(one).alias("page"), N.split_acronym(one, two).alias("acronym"))


def _block_sql(c: str, lines: str) -> str:
    every = lambda p: f"len({lines}) > 1 AND len(list_filter({lines}, lambda x: NOT regexp_matches(x, '{p}'))) = 0"
    cells = f"[len(list_filter(string_split(x, '|'), lambda y: trim(y) <> '')) for x in {lines}]"
    return f"""CASE WHEN regexp_matches({c}, '^#{{1,3}}\\s+\\S') THEN 'h3' WHEN {every('^[-•●]\\s+\\S')} THEN 'ul' WHEN {every('^\\d+\\.\\s+\\S')} THEN 'ol' WHEN starts_with({c}, '>') OR {every('^["“«]')} THEN 'blockquote'
    WHEN regexp_matches({c}, '\\|.*\\|') AND len({lines}) > 1 AND list_min({cells}) = list_max({cells}) THEN 'table'
    WHEN length({c}) <= 90 AND NOT regexp_matches({c}, '[.!?…:]$') AND ({c} = upper({c}) AND regexp_matches({c}, '[A-ZÁÉÍÓÚÑ]{{2,}}') OR regexp_matches({c}, '^(?i)(capítulo|capitulo|parte|prólogo|prologo|epílogo|anexo|introducción)')) THEN 'h3' ELSE 'p' END"""


_HYPHENS = "[-­‐‑‒]"
register("line_kinds", f"""
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
r AS (SELECT doc_id, i AS place, l[i + 1] AS a, coalesce(l[i + 2], '') AS b FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM l)),
s AS (SELECT *, a || chr(10) || b || '.' AS ab, [trim(a)] AS la, [trim(x) for x in string_split(a || chr(10) || b || '.', chr(10)) if trim(x) <> ''] AS lb, a || '-' AS e, regexp_replace(b, '^\\s+', '') AS f, regexp_split_to_array(a, ' +') AS w FROM r),
p AS (SELECT *, coalesce(w[1], '') AS w1, coalesce(w[2], '') AS w2, lower(regexp_replace(trim(coalesce(w[1], '')), '^[\\s\\-–—·•|*\\[\\](){{}}<>."'']+|[\\s\\-–—·•|*\\[\\](){{}}<>."'']+$', '', 'g')) AS core FROM s)
SELECT doc_id, place::INT AS place, {_block_sql("a", "la")} AS alone, {_block_sql("ab", "lb")} AS both, CASE WHEN regexp_matches(f, '^[—–]') THEN 'dialogue' WHEN regexp_matches(f, '^\\p{{Lu}}') OR regexp_matches(e, '(?i)\\d+(st|nd|rd|th){_HYPHENS}$') THEN 'compound' ELSE 'split' END AS hyphen,
  trim(w1) <> '' AND length(trim(w1)) <= 24 AND core <> '' AND (regexp_matches(core, '^\\d{{1,3}}$') OR regexp_matches(core, '{N.ROMAN_PAGE}') AND core NOT IN ({", ".join(repr(w) for w in N.NO_PAGE)})) AS page,
  regexp_matches(w1, '^\\p{{Lu}}{{1,4}}$') AND regexp_matches(w2, '^\\p{{Lu}}{{1,4}}$') AND length(w1) + length(w2) <= 8 AS acronym FROM p""")(_line_kinds)
