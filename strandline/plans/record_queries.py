"""Queries of records that are merged, deleted, synchronised, queued and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import records as R
from strandline.plans.registry import expressions, register
from strandline.sources.tables import table

FOLD = f"translate(lower(%s), '{T.ACCENTED}', '{T.PLAIN}')"

#: Orders as documents with stamps; nulls among all of them.
_DOC = """o_orderkey, o_orderkey % 100 AS updated, IF(o_orderkey % 4 = 0, NULL, o_orderkey % 90) AS synced, IF(o_orderkey % 5 = 0, o_orderkey % 70 + 1, NULL) AS erased,
  IF(o_orderkey % 3 = 0, NULL, o_orderkey % 80) AS content, o_orderkey % 11 <> 0 AS syncable, o_orderkey % 13 = 0 AS lacks_cover"""
_SQL_DOC = f"d AS (SELECT {_DOC.replace('IF(', 'if(')} FROM orders), e AS (SELECT *, coalesce(erased, 0) AS er, coalesce(content, 0) AS co, coalesce(synced, 0) AS sy, coalesce(erased, 0) > 0 AND coalesce(content, 0) <= coalesce(erased, 0) AS gone FROM d)"


def documents(spark, sf):
    return table(spark, sf, "orders").selectExpr(*expressions(_DOC))


register("sync_states", f"""
WITH {_SQL_DOC} SELECT o_orderkey, gone AS deleted, NOT gone AND (er > 0 OR sy = 0 OR co = 0 OR co > sy) AS needs_content, syncable AND NOT gone AND NOT lacks_cover AS may_lack_cover FROM e""")(
    lambda spark, sf: documents(spark, sf).select("o_orderkey", R.deleted(F.col("erased"), F.col("content")).alias("deleted"), R.needs_content(F.col("erased"), F.col("content"), F.col("synced")).alias("needs_content"),
        R.may_lack_cover(F.col("lacks_cover"), F.col("syncable"), F.col("erased"), F.col("content")).alias("may_lack_cover"))
)
for _cursor, _name, _newer in ((True, "push_since_cursor", "updated > sy"), (False, "push_first_time", "r.stamp IS NULL OR updated > r.stamp")):
    register(_name, f"""
WITH {_SQL_DOC}, r AS (SELECT o_orderkey, o_orderkey % 97 AS stamp FROM orders WHERE o_orderkey % 6 <> 0)
SELECT o_orderkey, syncable AND ((er > 0 AND NOT gone) OR (lacks_cover AND NOT gone) OR {_newer}) AS push FROM e LEFT JOIN r USING (o_orderkey)""")(
        lambda spark, sf, c=_cursor: R.push(documents(spark, sf), table(spark, sf, "orders").where("o_orderkey % 6 <> 0").selectExpr("o_orderkey", "o_orderkey % 97 AS updated"), "o_orderkey", c)
    )
register("shared_metadata", "SELECT o_orderkey, o_orderpriority AS title, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3)::INT END AS figures_there FROM orders")(
    lambda spark, sf: R.without_device_fields(table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderpriority AS title", "int(o_orderkey % 3) AS figures", "true AS has_file", "o_orderstatus AS figures_state"))
)
register("rescued_covers", "SELECT o_orderkey, 'data:image/png;' || o_orderstatus AS cover FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 0 AND o_orderkey % 2 = 0")(
    lambda spark, sf: R.covers_to_rescue(table(spark, sf, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 3 = 0, concat('data:image/png;', o_orderstatus), 'text') AS cover", "IF(o_orderkey % 5 = 0, 1L, NULL) AS erased"),
        table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 2 = 1 AS has_cover"), "o_orderkey")
)
_TITLE = "concat(o_orderpriority, ' ', o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN ' (2).pdf' WHEN 1 THEN ' - copia.EPUB' WHEN 2 THEN '_7' ELSE '.txt' END)"
_SLUG = f"substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace({FOLD % _TITLE}, '\\.(pdf|epub|txt)$', ''), '\\s*(\\([0-9]+\\)|[-\\s_]*copia(\\s*\\([0-9]+\\))?|[-\\s_]*[0-9]+)\\s*$', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40)"
_ID = f"CASE WHEN o_orderkey % 10 = 0 THEN 'h:' || sha256((o_orderkey % 40)::VARCHAR) WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'b:' || (o_orderkey % 3) || '|9|' || {_SLUG} END"


def _identified(spark, sf):
    d = table(spark, sf, "orders").selectExpr("o_orderkey", "bigint(o_totalprice) AS stamp", "IF(o_orderkey % 10 = 0, upper(sha2(string(o_orderkey % 40), 256)), 'none') AS sha",
        "IF(o_orderkey % 7 = 0, 0L, o_orderkey % 3) AS size", "IF(o_orderkey % 7 = 0, 0, 9) AS chars", f"{_TITLE} AS title")
    return d.withColumn("identity", R.identity(F.col("sha"), F.col("size"), F.col("chars"), F.col("title")))


register("document_identity", f"SELECT o_orderkey, {_ID} AS identity FROM orders")(lambda spark, sf: _identified(spark, sf).select("o_orderkey", "identity"))
register("twin_documents", f"""
WITH d AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS stamp, {_ID} AS id FROM orders), k AS (SELECT *, first_value(o_orderkey) OVER (PARTITION BY id ORDER BY stamp DESC, o_orderkey) AS canonical FROM d WHERE id IS NOT NULL)
SELECT o_orderkey, canonical FROM k WHERE o_orderkey <> canonical""")(lambda spark, sf: R.twins(_identified(spark, sf), "identity", "o_orderkey", "stamp"))

_KEY = "CASE o_orderkey % 3 WHEN 0 THEN concat('file:', o_orderkey) WHEN 1 THEN concat('x:', o_orderkey) ELSE concat('v', o_orderkey) END"


def _entries(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderkey % 4 <> 3").selectExpr(f"{_KEY} AS key", "IF(o_orderkey % 5 = 0, '', o_orderpriority) AS title", "o_orderstatus AS author", "bigint(o_totalprice) % 900 AS duration", "o_orderkey % 300 AS position",
        "o_orderkey % 2 = 0 AS favourite", "array(o_orderstatus) AS tags")
    new = o.where("o_orderkey % 4 <> 2").selectExpr(f"{_KEY} AS key", "IF(o_orderkey % 6 = 0, 'New one', NULL) AS title", "CAST(NULL AS string) AS author", "IF(o_orderkey % 7 = 0, 500L, 0L) AS duration", "IF(o_orderkey % 8 = 0, 490L, NULL) AS position")
    return R.merge_entries(old, new, "key")


register("merged_entries", f"""
WITH m AS (SELECT *, {_KEY} AS key, o_orderkey % 4 <> 3 AS a, o_orderkey % 4 <> 2 AS b FROM orders),
v AS (SELECT key, o_orderkey, coalesce(CASE WHEN b AND o_orderkey % 6 = 0 THEN 'New one' END, CASE WHEN a AND o_orderkey % 5 > 0 THEN o_orderpriority END, CASE o_orderkey % 3 WHEN 0 THEN 'Own video' WHEN 1 THEN 'Post video' ELSE 'Video' END) AS title,
  CASE WHEN a THEN o_orderstatus ELSE '' END AS author, coalesce(CASE WHEN b AND o_orderkey % 7 = 0 THEN 500 END, CASE WHEN a THEN trunc(o_totalprice)::BIGINT % 900 END, 0)::BIGINT AS duration,
  coalesce(CASE WHEN b AND o_orderkey % 8 = 0 THEN 490 END, CASE WHEN a THEN o_orderkey % 300 END, 0)::BIGINT AS position, a AND o_orderkey % 2 = 0 AS favourite, CASE WHEN a THEN o_orderstatus ELSE '' END AS tags,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://x.com/i/status/' || o_orderkey ELSE 'https://www.youtube.com/watch?v=v' || o_orderkey END AS url FROM m)
SELECT * EXCLUDE (o_orderkey), CASE WHEN position < 15 THEN 'new' WHEN duration > 0 AND (duration - position <= 30 OR position >= 0.95 * duration) THEN 'done' ELSE 'watching' END AS state FROM v""")(
    lambda spark, sf: _entries(spark, sf).withColumn("tags", F.array_join("tags", ","))
)


def _shelf(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id AS key", "source AS title", "lang AS author", "IF(lang = 'en', 'youtube', 'x') AS platform", "array(concat('Tag ', lang), source) AS tags",
        "IF(doc_id % 3 = 0, 'watching', 'done') AS state", "doc_id % 2 = 0 AS favourite", "n_chars AS opened")


register("filtered_entries", f"""
SELECT doc_id AS key FROM documents WHERE lang = 'en' AND doc_id % 3 = 0 AND (({FOLD % "concat_ws(' ', source, lang, 'tag ' || lang, source, doc_id)"} LIKE '%src1%' AND {FOLD % "concat_ws(' ', source, lang, 'tag ' || lang, source, doc_id)"} LIKE '%tag en%') OR contains(text, 'License'))""")(
    lambda spark, sf: R.filter_entries(_shelf(spark, sf), "SRC1 tag", "youtube", "watching", "tag EN", table(spark, sf, "documents").where("contains(text, 'License')").select(F.col("doc_id").alias("key"))).select("key")
)
register("page_and_rest", "SELECT (SELECT count(*) - 40 FROM documents) AS rest, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY n_chars DESC, doc_id)) AS ids FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40)")(
    lambda spark, sf: (lambda p: p[0].agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n_chars"), "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")).alias("ids")).join(p[1]))(
        R.page(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"]))
)
register("keep_watching", "SELECT arg_max(doc_id, n_chars * 1000000 - doc_id) AS key FROM documents WHERE doc_id % 3 = 0")(
    lambda spark, sf: _shelf(spark, sf).where("state = 'watching'").agg(F.max_by("key", F.struct("opened", -F.col("key"))).alias("key"))
)
register("suggested_tags", """
WITH t AS (SELECT lower(tag) AS k, count(*) AS n, min(tag) AS tag, 0 AS i FROM (SELECT 'Tag ' || lang AS tag FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1 UNION ALL VALUES ('learn src', 0, 'Learn src', 0), ('business', 0, 'Business', 1))
SELECT tag, n FROM t WHERE contains(k, 'src') AND k <> 'src1' ORDER BY n DESC, -i DESC, tag LIMIT 8""")(
    lambda spark, sf: R.suggest_tags(_shelf(spark, sf), ["SRC1"], "Src", ["Learn src", "Business"])
)

_DAY = 86_400_000
register("tombstones", f"""
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN {100 * _DAY} WHEN o_orderkey % 7 = 0 THEN (o_orderkey % 100) * {_DAY} END AS erased FROM orders) SELECT * FROM d WHERE erased IS NULL OR erased >= {70 * _DAY}""")(
    lambda spark, sf: R.purge(R.erase(table(spark, sf, "orders").selectExpr("o_orderkey", f"IF(o_orderkey % 7 = 0, (o_orderkey % 100) * {_DAY}L, NULL) AS erased"), table(spark, sf, "orders").where("o_orderkey % 5 = 0"), "o_orderkey", 100 * _DAY), 100 * _DAY)
)
register("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")(
    lambda spark, sf: R.cascade(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
)
register("changed_since", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'")(
    lambda spark, sf: table(spark, sf, "orders").where("o_orderdate > TIMESTAMP_NTZ '1997-01-01'").select("o_orderkey")
)
register("parts_stored", "SELECT l_orderkey, count(*) AS parts FROM lineitem GROUP BY 1")(lambda spark, sf: table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parts")))
register("upload_parts", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name AS translation, s.s_name AS polished FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 20 LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0""")(
    lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("translation")), "l_partkey", "left")
    .join(table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("polished")), "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "translation", "polished")
)
_LINES = "SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2"
register("packed_prefix", f"""
WITH l AS ({_LINES}), r AS (SELECT *, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM l), c AS (SELECT l_orderkey, max(run) > 60 AS cut FROM r GROUP BY 1)
SELECT l_orderkey, l_linenumber, q, cut FROM r JOIN c USING (l_orderkey) WHERE run <= 60""")(
    lambda spark, sf: R.pack_prefix(table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")), "l_orderkey", ["l_linenumber"], "q", 60)
)

_ITEM = "l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'R' THEN 'failed' ELSE 'pending' END AS state, CAST(l_quantity AS INT) % 4 AS retries"
register("queue_parts", f"""
WITH i AS (SELECT {_ITEM} FROM lineitem) SELECT l_orderkey, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, sum(retries)::BIGINT AS retries, count(*) FILTER (state <> 'done') = 0 AS complete FROM i GROUP BY 1""")(
    lambda spark, sf: R.queue_parts(table(spark, sf, "lineitem").selectExpr(*expressions(_ITEM)), "l_orderkey")
)
register("queue_summary", f"""
WITH i AS (SELECT {_ITEM} FROM lineitem), p AS (SELECT l_orderkey, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, sum(retries) AS retries FROM i GROUP BY 1)
SELECT count(*) AS parts, count(*) FILTER (pending > 0) AS open, count(*) FILTER (pending = 0 AND failed > 0) AS broken, count(*) FILTER (pending = 0 AND failed = 0) AS complete, sum(pending)::BIGINT AS pending, sum(done)::BIGINT AS done, sum(failed)::BIGINT AS failed, sum(retries)::BIGINT AS retries,
  count(*) FILTER (pending + failed > 0) = 0 AS ready FROM p""")(
    lambda spark, sf: R.queue_summary(table(spark, sf, "lineitem").selectExpr(*expressions(_ITEM)), "l_orderkey")
)
_ERROR = "CASE o_orderkey % 8 WHEN 0 THEN 'HTTP 429 quota' WHEN 1 THEN '401 Unauthorized' WHEN 2 THEN 'Timeout after 9 s' WHEN 3 THEN 'Failed to fetch' WHEN 4 THEN 'HTTP 503' WHEN 5 THEN 'palabra perdida' WHEN 6 THEN 'other' END"
register("queue_failures", f"""
WITH f AS (SELECT o_orderkey, {_ERROR} AS error, (o_orderkey % 5)::INT AS r, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 7 THEN 'pending' WHEN k IN (0, 1) OR r + 1 > 3 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN k = 7 THEN r ELSE r + 1 END AS retries,
  CASE k WHEN 0 THEN 'quota' WHEN 1 THEN 'credentials' WHEN 2 THEN 'timeout' WHEN 3 THEN 'network' WHEN 4 THEN 'provider' WHEN 5 THEN 'validation' WHEN 6 THEN 'unknown' END AS cause FROM f""")(
    lambda spark, sf: R.after_failure(table(spark, sf, "orders").selectExpr("o_orderkey", "'pending' AS state", "int(o_orderkey % 5) AS retries", f"{_ERROR} AS error"))
)
register("queue_resumed", f"WITH i AS (SELECT {_ITEM} FROM lineitem) SELECT l_orderkey, l_linenumber, CASE state WHEN 'failed' THEN 'pending' ELSE state END AS state, CASE state WHEN 'failed' THEN 0 ELSE retries END AS retries FROM i")(
    lambda spark, sf: R.resume(table(spark, sf, "lineitem").selectExpr(*expressions(_ITEM)))
)
register("reusable_results", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS text FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderkey % 3 > 0 AND o_orderkey % 6 >= 3)")(
    lambda spark, sf: R.reusable(table(spark, sf, "orders").selectExpr("o_orderkey", "IF(o_orderkey % 2 = 0, o_orderstatus, NULL) AS text"), table(spark, sf, "orders").where("o_orderkey % 3 > 0").selectExpr("o_orderkey", "o_orderkey % 6 AS tries"), "o_orderkey")
)
register("counted_tries", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 6 ELSE 0 END + CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS tries FROM orders WHERE (o_orderkey % 3 > 0 OR o_orderkey % 4 < 2) AND NOT o_orderkey % 4 = 0")(
    lambda spark, sf: R.count_tries(table(spark, sf, "orders").where("o_orderkey % 3 > 0").selectExpr("o_orderkey", "o_orderkey % 6 AS tries"), table(spark, sf, "orders").where("o_orderkey % 4 < 2").selectExpr("o_orderkey", "IF(o_orderkey % 4 = 0, 't', NULL) AS text"), "o_orderkey")
)

_AT = "conv_id, conv_id % 6 AS part, conv_id % 5 / 4 AS inside FROM conversations"
register("percent_read", f"""
WITH a AS (SELECT DISTINCT {_AT}), n AS (SELECT conv_id, sum(length(coalesce(text, ''))) AS total, sum(CASE WHEN turn < a.part THEN length(coalesce(text, '')) WHEN turn = a.part THEN length(coalesce(text, '')) * inside ELSE 0 END) AS done, max(turn) AS last, any_value(a.part) AS p FROM conversations JOIN a USING (conv_id) GROUP BY 1)
SELECT conv_id, (CASE WHEN total = 0 THEN 0 WHEN p > last THEN 100 WHEN done * 100 / total > 0 AND done * 100 / total < 1 THEN 1 ELSE floor(done * 100 / total + 0.5) END)::INT AS percent FROM n""")(
    lambda spark, sf: R.percent_read(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("part"), F.length(F.coalesce("text", F.lit(""))).alias("chars")),
        table(spark, sf, "conversations").selectExpr("conv_id", "conv_id % 6 AS part", "conv_id % 5 / 4 AS inside").distinct(), "conv_id")
)
register("minutes_left", f"""
WITH a AS (SELECT DISTINCT {_AT}), n AS (SELECT conv_id, turn, len([w FOR w IN regexp_split_to_array(trim(coalesce(text, '')), '\\s+') IF w <> '']) AS n FROM conversations)
SELECT conv_id, sum(CASE WHEN turn > a.part THEN n WHEN turn = a.part THEN n * (1 - inside) ELSE 0 END) / 200 AS minutes FROM n JOIN a USING (conv_id) GROUP BY 1""")(
    lambda spark, sf: R.minutes_left(table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("part"), "text"), table(spark, sf, "conversations").selectExpr("conv_id", "conv_id % 6 AS part", "conv_id % 5 / 4 AS inside").distinct(), "conv_id")
)
register("reading_progress", """
SELECT user_id, arg_max(event_id % 12, event_id) AS part, greatest(0, least(1, arg_max(value / 100, event_id))) AS inside, max(event_id % 12) AS furthest FROM events GROUP BY 1""")(
    lambda spark, sf: R.advance(table(spark, sf, "events").selectExpr("user_id", "event_id", "event_id % 12 AS part", "value / 100 AS inside"), "user_id", ["event_id"])
)
_TALK = "CASE turn % 3 WHEN 0 THEN concat('>> she told her mother: ', text) WHEN 1 THEN concat('— Él y su padre, ', text) ELSE text END"
_COUNT = lambda ws: f"len([w FOR w IN t IF w IN ({', '.join(repr(w) for w in ws.split())})])"
register("voice_gender", f"""
WITH t AS (SELECT conv_id, {_TALK} AS x FROM conversations), w AS (SELECT conv_id, x, coalesce(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+'), []) AS t FROM t),
n AS (SELECT conv_id, sum({_COUNT(R.MALE)})::BIGINT AS male, sum({_COUNT(R.FEMALE)})::BIGINT AS female, count(*) FILTER (regexp_matches(coalesce(x, ''), '{R.SPEAKER.replace(chr(39), chr(39) * 2)}')) >= 2 AS dialogue FROM w GROUP BY 1)
SELECT *, CASE WHEN male + female < 3 THEN '' WHEN female >= (male + female) * 0.75 THEN 'female' WHEN male >= (male + female) * 0.75 THEN 'male' ELSE '' END AS gender FROM n""")(
    lambda spark, sf: R.voice_gender(table(spark, sf, "conversations").select("conv_id", F.expr(_TALK).alias("x")), "conv_id", "x")
)
register("cost_summary", "SELECT conv_id, count(*) FILTER (trim(coalesce(text, '')) <> '') AS texts, sum(length(coalesce(text, '')))::BIGINT AS chars, floor(sum(length(coalesce(text, ''))) / 500000 * 1000 + 0.5) / 10 AS percent FROM conversations GROUP BY 1")(
    lambda spark, sf: R.cost_summary(table(spark, sf, "conversations"), "conv_id", "text")
)
