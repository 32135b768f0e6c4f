"""Records that are merged, deleted, synchronised and queued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.library import canonical_url, key_parts, normal
from strandline.functions.text import fold, watch_state

DEVICE_FIELDS = ["has_file", "has_cover", "cover_source", "figures_state", "figures", "figures_version"]
TITLES = {"x": "Post video", "file": "Own video", "youtube": "Video"}


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def deleted(erased: Column, content: Column) -> Column:
    """Whether a tombstone holds: it doesn't once content was stored after it."""
    return (nz(erased) > 0) & (nz(content) <= nz(erased))


def needs_content(erased: Column, content: Column, synced: Column) -> Column:
    """Whether the text must be sent, not the record alone: never for tombstones, always if revived, unsent or of unknown age."""
    return F.when(deleted(erased, content), False).otherwise((nz(erased) > 0) | (nz(synced) == 0) | (nz(content) == 0) | (nz(content) > nz(synced)))


def may_lack_cover(synced: Column, syncable: Column, erased: Column, content: Column) -> Column:
    return F.coalesce(syncable, F.lit(True)) & ~deleted(erased, content) & ~F.coalesce(synced, F.lit(False))


def push(local: DataFrame, remote: DataFrame, key: str, cursor: bool) -> DataFrame:
    """(key, push) of local(key, updated, synced, erased, content, syncable, lacks_cover) against remote(key, updated).

    With a cursor a change since the last sync counts, without one a newer stamp than the remote one.
    """
    r = remote.select(key, F.col("updated").alias("_there"))
    df = local.join(r, key, "left")
    gone = deleted(F.col("erased"), F.col("content"))
    newer = nz(F.col("updated")) > nz(F.col("synced")) if cursor else F.col("_there").isNull() | (F.col("updated") > F.col("_there"))
    revived = (nz(F.col("erased")) > 0) & ~gone
    return df.select(key, (F.coalesce("syncable", F.lit(True)) & (revived | (F.coalesce("lacks_cover", F.lit(False)) & ~gone) | newer)).alias("push"))


def without_device_fields(meta: DataFrame) -> DataFrame:
    """Metadata as another device gets it; the number of figures there stays as figures_there."""
    there = F.greatest(*[nz(F.col(c)) for c in ("figures", "figures_there") if c in meta.columns], F.lit(0))
    return meta.withColumn("figures_there", F.when(there > 0, there)).drop(*DEVICE_FIELDS)


def covers_to_rescue(arrived: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """(key, cover) of arrivals with an image for a local document that has none."""
    some = arrived.where("erased is null and startswith(cover, 'data:image/')").select(key, "cover")
    return some.join(local.where("not has_cover").select(key), key, "left_semi")


def title_slug(title: Column) -> Column:
    """Folded title without extension, copy suffix and signs, at most 40 characters."""
    t = F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"\.(pdf|epub|txt)$", "")
    t = F.regexp_replace(t, r"\s*(\([0-9]+\)|[-\s_]*copia(\s*\([0-9]+\))?|[-\s_]*[0-9]+)\s*$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def identity(sha: Column, size: Column, chars: Column, title: Column) -> Column:
    """A document's identity: its SHA-256, else size, characters and slug; null where these say nothing."""
    h = F.lower(F.trim(F.coalesce(sha, F.lit(""))))
    slug = title_slug(title)
    other = F.when(((nz(size) > 0) | (nz(chars) > 0)) & (slug != ""), F.concat(F.lit("b:"), nz(size).cast("string"), F.lit("|"), nz(chars).cast("string"), F.lit("|"), slug))
    return F.when(h.rlike("^[a-f0-9]{64}$"), F.concat(F.lit("h:"), h)).otherwise(other)


def twins(docs: DataFrame, key: str, id_: str, stamp: str) -> DataFrame:
    """(id, canonical) of every document that isn't the newest of its identity (ties: the smallest id); such ones become tombstones."""
    newest = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(stamp).alias("s"), (-F.col(id_)).alias("i"))).alias("m"), F.count("*").alias("n"))
    newest = newest.where("n > 1").select(key, (-F.col("m.i")).alias("canonical"))
    return docs.join(newest, key).where(F.col(id_) != F.col("canonical")).select(id_, "canonical")


def merge_entries(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Library entries of either side: the new title, author and times where given, tags and favourite always the old ones."""
    text = lambda c: F.coalesce(F.nullif(F.trim(f"n.{c}"), F.lit("")), F.nullif(F.trim(f"o.{c}"), F.lit("")))
    number = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit(0)), F.nullif(F.col(f"o.{c}"), F.lit(0)), F.lit(0))
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    k = F.coalesce(f"n.{key}", f"o.{key}")
    place = F.coalesce("n.position", "o.position", F.lit(0))
    df = both.select(
        k.alias(key), text("title").alias("title"), F.coalesce(text("author"), F.lit("")).alias("author"), number("duration").alias("duration"), place.alias("position"),
        F.coalesce("o.favourite", F.lit(False)).alias("favourite"), F.coalesce("o.tags", F.array().cast("array<string>")).alias("tags"),
    )
    parts = df.withColumn("_k", key_parts(F.col(key)))
    given = F.coalesce(*[F.when(F.col("_k.platform") == p, t) for p, t in TITLES.items()])
    return parts.select(key, F.coalesce("title", given).alias("title"), "author", "duration", "position", "favourite", "tags", canonical_url(F.col("_k")).alias("url"), watch_state(F.col("position"), F.col("duration")).alias("state"))


def filter_entries(df: DataFrame, words: str = "", platform: str = "", view: str = "", tag: str = "", spoken: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Entries of a platform, view (favourite, watching, done) and tag whose title, author, tags and id hold all
    words, or whose key is in spoken(key)."""
    if platform:
        df = df.where(F.col("platform") == platform)
    if view:
        df = df.where(F.col("favourite") if view == "favourite" else F.col("state") == view)
    if tag:
        df = df.where(F.exists("tags", lambda t: normal(t) == normal(F.lit(tag))))
    said = words.split()
    if not said:
        return df
    hay = normal(F.concat_ws(" ", "title", "author", F.array_join("tags", " "), F.col(key).cast("string")))
    fits = F.lit(True)
    for w in said:
        fits = fits & F.contains(hay, normal(F.lit(w)))
    if spoken is None:
        return df.where(fits)
    heard = spoken.select(key).distinct().withColumn("_heard", F.lit(True))
    return df.join(heard, key, "left").where(fits | F.col("_heard")).drop("_heard")


def page(df: DataFrame, order: list, size: int = 40) -> tuple[DataFrame, DataFrame]:
    """The first rows and a row with the number of the rest."""
    return df.orderBy(*order).limit(size), df.agg(F.greatest(F.count("*") - size, F.lit(0)).alias("rest"))


def suggest_tags(entries: DataFrame, used: list[str], written: str, starters: list[str], most: int = 8) -> DataFrame:
    """Tags by count, then the starters, without used ones, that hold what is written."""
    tags = entries.select(F.explode("tags").alias("tag")).groupBy(normal(F.col("tag")).alias("k")).agg(F.count("*").alias("n"), F.min("tag").alias("tag"))
    extra = entries.sparkSession.createDataFrame([(i, t) for i, t in enumerate(starters)], "i int, tag string").select(normal(F.col("tag")).alias("k"), F.lit(0).cast("long").alias("n"), "tag", "i")
    all_ = tags.withColumn("i", F.lit(0)).unionByName(extra).groupBy("k").agg(F.max(F.struct("n", -F.col("i"), "tag")).alias("m"))
    old = [F.lit(u) for u in used]
    fits = F.contains(F.col("k"), normal(F.lit(written)))
    new = ~F.exists(F.array(*old), lambda u: normal(u) == F.col("k")) if old else F.lit(True)
    return all_.where(fits & new).orderBy(F.desc("m.n"), F.desc("m.col2"), "m.tag").limit(most).select("m.tag", "m.n")


def erase(docs: DataFrame, gone: DataFrame, key: str, now: int) -> DataFrame:
    """docs with tombstones for the keys in gone."""
    g = gone.select(key).distinct().withColumn("_g", F.lit(True))
    return docs.join(g, key, "left").withColumn("erased", F.when(F.col("_g"), F.lit(now)).otherwise(F.col("erased"))).drop("_g")


def cascade(dependent: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of a dependent table whose document stays."""
    return dependent.join(gone.select(key), key, "left_anti")


def purge(docs: DataFrame, now: int, days: int = 30) -> DataFrame:
    """docs without tombstones older than `days`; times in milliseconds."""
    return docs.where(F.col("erased").isNull() | (F.col("erased") >= now - days * 86_400_000))


def pack_prefix(rows: DataFrame, key: str, order: list, size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, whose running size stays within the budget, and whether the key was cut."""
    w = Window.partitionBy(key).orderBy(*order)
    df = rows.withColumn("_run", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.groupBy(key).agg((F.max("_run") > budget).alias("cut"))
    return df.where(F.col("_run") <= budget).drop("_run").join(cut, key)


def queue_parts(items: DataFrame, part: str) -> DataFrame:
    """(part, pending, done, failed, retries, complete) of queue items(part, state, retries)."""
    n = items.groupBy(part).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "done", "failed")], F.sum(nz(F.col("retries"))).alias("retries"))
    return n.withColumn("complete", (F.col("pending") == 0) & (F.col("failed") == 0))


def queue_summary(items: DataFrame, part: str) -> DataFrame:
    """One row over all parts: open, failed and complete parts, items by state, retries, and whether all is done."""
    p = queue_parts(items, part)
    one = p.agg(
        F.count("*").alias("parts"), F.count_if(F.col("pending") > 0).alias("open"), F.count_if((F.col("pending") == 0) & (F.col("failed") > 0)).alias("broken"),
        F.count_if("complete").alias("complete"), *[nz(F.sum(s)).alias(s) for s in ("pending", "done", "failed", "retries")],
    )
    return one.withColumn("ready", (F.col("parts") > 0) & (F.col("complete") == F.col("parts")))


#: Causes by what an error says, in the order that decides.
CAUSES = [
    ("validation", "(?i)validacion|palabra|union|estructura|cambio_no_autorizado"),
    ("credentials", r"(?i)401|unauthorized|forbidden|invalid_api_key|credencial.*invalid|api_key.*invalid"),
    ("quota", "(?i)cuota|quota|429|402|payment|billing"), ("timeout", "(?i)abort|timeout|tiempo|tardó|504|502"),
    ("network", "(?i)network|failed to fetch|fetch|red|offline|err_internet"), ("provider", "(?i)503|proveedor|api.?key|no confirmó"),
]


def cause(message: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(CAUSES):
        out = F.when(F.coalesce(message, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def after_failure(items: DataFrame, tries: int = 3) -> DataFrame:
    """Queue items(state, retries, error) after a failure: quota and credentials fail at once, others are tried again up to `tries`."""
    c = cause(F.col("error"))
    tried = nz(F.col("retries")) + 1
    final = c.isin("quota", "credentials") | (tried > tries)
    hit = F.col("error").isNotNull()
    return items.select(
        *[x for x in items.columns if x not in ("state", "retries", "error")], F.when(hit, F.when(final, "failed").otherwise("pending")).otherwise(F.col("state")).alias("state"),
        F.when(hit, tried).otherwise(nz(F.col("retries"))).alias("retries"), F.when(hit, c).alias("cause"),
    )


def resume(items: DataFrame) -> DataFrame:
    """Failed items are pending again, with fresh tries."""
    back = F.col("state") == "failed"
    return items.withColumn("retries", F.when(back, 0).otherwise(F.col("retries"))).withColumn("state", F.when(back, "pending").otherwise(F.col("state")))


def reusable(cached: DataFrame, tries: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Cached results that count: those with a text, and those without one after `most` tries."""
    return cached.join(tries.select(key, "tries"), key, "left").where(F.col("text").isNotNull() | (nz(F.col("tries")) >= most)).select(key, "text")


def count_tries(tries: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Tries after a round: one more for each null result, none for a success, the rest as before."""
    r = results.groupBy(key).agg(F.max(F.col("text").isNotNull()).alias("ok"))
    both = tries.join(r, key, "full")
    return both.where(~F.coalesce("ok", F.lit(False))).select(key, (nz(F.col("tries")) + F.when(F.col("ok").isNotNull(), 1).otherwise(0)).alias("tries"))


def percent_read(parts: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """(key, percent) of parts(key, part, chars) read up to at(key, part, inside): by length, at least 1 once begun, 100 behind the last part."""
    w = parts.join(at.select(key, F.col("part").alias("_p"), F.col("inside").alias("_i")), key, "left")
    n = w.groupBy(key).agg(
        F.sum("chars").alias("all"), F.sum(F.when(F.col("part") < F.col("_p"), F.col("chars")).when(F.col("part") == F.col("_p"), F.col("chars") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_i"))).otherwise(0)).alias("read"),
        F.max("part").alias("last"), F.max("_p").alias("p"),
    )
    raw = F.coalesce(F.try_divide(F.col("read") * 100, F.col("all")), F.lit(0.0))
    return n.select(key, F.when(F.col("p").isNull() | (nz(F.col("all")) == 0), 0).when(F.col("p") > F.col("last"), 100).when((raw > 0) & (raw < 1), 1).otherwise(F.floor(raw + 0.5)).cast("int").alias("percent"))


def minutes_left(parts: DataFrame, at: DataFrame, key: str, per_minute: int = 200) -> DataFrame:
    """(key, minutes) of the words behind at(key, part, inside)."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    w = parts.select(key, "part", words.alias("n")).join(at.select(key, F.col("part").alias("_p"), F.col("inside").alias("_i")), key)
    left = F.when(F.col("part") > F.col("_p"), F.col("n")).when(F.col("part") == F.col("_p"), F.col("n") * (1 - F.col("_i"))).otherwise(0)
    return w.groupBy(key).agg((F.sum(left) / per_minute).alias("minutes"))


def advance(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Progress folded from events(key, part, inside): the last place and the furthest part, by one aggregation."""
    last = F.max(F.struct(*order, "part", "inside")).alias("m")
    return events.groupBy(key).agg(last, F.max("part").alias("furthest")).select(key, "m.part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "m.inside")).alias("inside"), "furthest")


#: Words that speak of men and of women.
MALE = "he him his man men boy boys guy guys gentleman mr sir father dad brother son husband king actor waiter él ellos hombre hombres señor caballero padre hermano hijo esposo rey"
FEMALE = "she her hers woman women girl girls lady ladies ms mrs miss madam mother mom sister daughter wife queen actress waitress ella ellas mujer mujeres señora señorita dama madre hermana hija esposa reina"
SPEAKER = r"(^|\s)(?:>>|&gt;&gt;)+\s*|^\s*[—–-]\s+\p{L}|^\s*[A-ZÁÉÍÓÚÑ][A-Za-z0-9_ÁÉÍÓÚÑáéíóúñ' .-]{1,30}:\s+\p{L}"


def speaker_change(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(SPEAKER)


def voice_gender(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, male, female, gender, dialogue) of each key's texts: a gender with three mentions and three quarters of them."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    n = lambda ws: F.size(F.filter("_t", lambda w: w.isin(ws.split()))).cast("long")
    rows = texts.withColumn("_t", tokens).select(key, n(MALE).alias("m"), n(FEMALE).alias("f"), speaker_change(F.col(text)).alias("c"))
    g = rows.groupBy(key).agg(F.sum("m").alias("male"), F.sum("f").alias("female"), (F.count_if("c") >= 2).alias("dialogue"))
    all_ = F.col("male") + F.col("female")
    gender = F.when(all_ < 3, "").when(F.col("female") >= all_ * 0.75, "female").when(F.col("male") >= all_ * 0.75, "male").otherwise("")
    return g.withColumn("gender", gender)


def cost_summary(texts: DataFrame, key: str, text: str, quota: int = 500_000) -> DataFrame:
    """(key, texts, chars, percent) of a month's quota."""
    n = texts.groupBy(key).agg(F.count_if(F.trim(F.coalesce(text, F.lit(""))) != "").alias("texts"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"))
    return n.withColumn("percent", F.floor(F.col("chars") / quota * 1000 + 0.5) / 10)
