"""Column functions on library entries: keys, links, tags, watch and reading state, labels of time and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import fold, squeeze

TAG_LENGTH, TAGS = 30, 10
STARTED, TAIL, SEEN = 15, 30, 0.95


def normal(c: Column) -> Column:
    """Folded and squeezed; null is empty."""
    return squeeze(fold(F.coalesce(c, F.lit(""))))


def clean_tag(c: Column) -> Column:
    """A tag without #,; and spare blanks, at most TAG_LENGTH long, with a capital."""
    t = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "[#,;]", " "))
    t = F.trim(F.substring(t, 1, TAG_LENGTH))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, TAG_LENGTH))


def add_tag(tags: Column, tag: Column) -> Column:
    """struct(tags, reason): the tag appended unless it is empty, there already (folded), or one too many."""
    tag = clean_tag(tag)
    old = F.coalesce(tags, F.array().cast("array<string>"))
    there = F.exists(old, lambda x: normal(x) == normal(tag))
    reason = F.when(tag == "", "empty").when(there, "repeated").when(F.size(old) >= TAGS, "full").otherwise("")
    return F.struct(F.when(reason == "", F.array_append(old, tag)).otherwise(old).alias("tags"), reason.alias("reason"))


def remove_tag(tags: Column, tag: Column) -> Column:
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: normal(x) != normal(tag))


def seen_share(position: Column, duration: Column) -> Column:
    """Share watched, 1 once it counts as seen, 0 without a duration."""
    p, d = F.coalesce(position, F.lit(0.0)), F.coalesce(duration, F.lit(0.0))
    seen = (p >= STARTED) & ((p >= d - TAIL) | (p / d >= SEEN))
    return F.when(d == 0, 0.0).when(seen, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / d)))


def reading_state(percent: Column) -> Column:
    return F.when(F.coalesce(percent, F.lit(0)) <= 0, "unread").when(percent >= 98, "finished").otherwise("reading")


def chapter_state(index: Column, current: Column, furthest: Column, mark: Column) -> Column:
    """reading where the reader is, then a mark by hand, then read up to the furthest chapter."""
    most = F.greatest(F.coalesce(furthest, F.lit(0)), F.coalesce(current, F.lit(0)))
    return (
        F.when(index == F.coalesce(current, F.lit(0)), "reading").when(mark == "read", "read").when(mark == "unread", "pending")
        .when(index <= most, "read").otherwise("pending")
    )


def key_parts(key: Column) -> Column:
    """struct(platform, id, place) of a store key: file:<print>, x:<id>[:<n>] or a bare video id."""
    k = F.coalesce(key, F.lit(""))
    place = F.coalesce(F.try_element_at(F.split(k, ":"), F.lit(3)).try_cast("int"), F.lit(0))
    post = k.startswith("x:")
    file = k.startswith("file:")
    return F.struct(
        F.when(file, "file").when(post, "x").otherwise("youtube").alias("platform"),
        F.when(file, F.substring(k, 6, 1_000_000)).when(post, F.split_part(k, F.lit(":"), F.lit(2))).otherwise(k).alias("id"),
        F.when(post, place).otherwise(0).alias("place"),
    )


def canonical_url(parts: Column) -> Column:
    """The link of key_parts; files have none."""
    tail = F.when(parts["place"] > 0, F.concat(F.lit("/video/"), (parts["place"] + 1).cast("string"))).otherwise("")
    return (
        F.when(parts["platform"] == "file", "").when(parts["platform"] == "x", F.concat(F.lit("https://x.com/i/status/"), parts["id"], tail))
        .otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), parts["id"]))
    )


_HOST = r"(?i)^\s*https?://(?:www\.)?"
#: Link shapes of video and post identifiers, and the identifier's form.
VIDEO_LINKS = [
    _HOST + r"youtu\.be/+([^/?#\s]+)", _HOST + r"(?:[a-z0-9-]+\.)*youtube\.com[^?#]*\?(?:[^#]*&)?v=([^&#\s]+)",
    _HOST + r"(?:[a-z0-9-]+\.)*youtube\.com/+(?:shorts|embed|live)/+([^/?#\s]+)",
]
VIDEO_ID = r"^[A-Za-z0-9_-]{6,20}$"
POST_LINK = r"(?i)^\s*(?:https?://)?(?:www\.|mobile\.|m\.)?(?:x|twitter)\.com/(?:[A-Za-z0-9_]+|i)/(?:web/)?status(?:es)?/(\d+)(?:/video/(\d+))?(?:[/?#].*)?$"


def video_id(url: Column) -> Column:
    """Identifier of a video link, empty where there is none; the first shape that fits counts."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_LINKS])
    return F.when(found.rlike(VIDEO_ID), found).otherwise("")


def post_id(url: Column) -> Column:
    """struct(id, place) of a post link; id is empty where it is none."""
    n = F.coalesce(F.nullif(F.regexp_extract(url, POST_LINK, 2), F.lit("")).try_cast("int"), F.lit(1))
    return F.struct(F.coalesce(F.regexp_extract(url, POST_LINK, 1), F.lit("")).alias("id"), F.greatest(n - 1, F.lit(0)).alias("place"))


def safe_url(url: Column, host: str) -> Column:
    """The link if it is https on exactly this host, else empty."""
    return F.when(F.coalesce(F.lower(F.regexp_extract(url, r"^https://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)", 1)) == host, F.lit(False)), url).otherwise("")


def short_code(c: Column) -> Column:
    """en-US and en_US are en; null is empty."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^[^-_]*", 0)


def direction(c: Column) -> Column:
    """struct(source, target) of a pair such as en-es; nulls where it is none or both are equal."""
    a, b = (F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})-([a-z]{2,3})$", k) for k in (1, 2))
    fine = (a != "") & (a != b)
    return F.struct(F.when(fine, a).alias("source"), F.when(fine, b).alias("target"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a number."""
    units = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step)


def size_label(n: Column) -> Column:
    """KB, MB or GB with a decimal comma."""
    n = F.coalesce(n, F.lit(0)).cast("double")

    def unit(v: Column, name: str) -> Column:
        t = F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)
        return F.concat(F.replace(F.regexp_replace(t, r"\.0$", ""), F.lit("."), F.lit(",")), F.lit(f" {name}"))

    kb = F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))
    return F.when(n < 1 << 20, kb).when(n < 1 << 30, unit(n / (1 << 20), "MB")).otherwise(unit(n / (1 << 30), "GB"))


def minutes_label(m: Column) -> Column:
    """~8 min, ~1 h 20 min; empty for negative and null values."""
    m = F.floor(m + 0.5)
    hours = F.concat(F.lit("~"), F.floor(m / 60).cast("string"), F.lit(" h"))
    rest = F.when(m % 60 > 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit(" min"))).otherwise("")
    return (
        F.when(m.isNull() | (m < 0), "").when(m < 1, "under 1 min").when(m < 60, F.concat(F.lit("~"), m.cast("string"), F.lit(" min")))
        .otherwise(F.concat(hours, rest))
    )


def age_label(since_ms: Column) -> Column:
    """just now, n minutes, n hours or n days."""
    minutes = F.floor(F.greatest(since_ms, F.lit(0)) / 60000)
    said = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "minute")).when(hours < 24, said(hours, "hour")).otherwise(said(days, "day"))


def day_label(day: Column, today: Column) -> Column:
    """today, yesterday, n days ago within a week, else the date (with its year if it is another one)."""
    n = F.datediff(today, day)
    old = F.when(F.year(day) == F.year(today), F.date_format(day, "d MMM")).otherwise(F.date_format(day, "d MMM yyyy"))
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(old)


#: Fixed value: the canonical form of roman numerals.
ROMAN = r"^M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$"


def roman(c: Column) -> Column:
    """Value of a canonical roman numeral, else 0."""
    t = F.upper(F.coalesce(c, F.lit("")))
    count = lambda s, x: F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))
    total = sum(count(t, x) * v for x, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items())
    for pair, less in (("IV", 2), ("IX", 2), ("XL", 20), ("XC", 20), ("CD", 200), ("CM", 200)):
        total = total - F.when(F.contains(t, F.lit(pair)), less).otherwise(0)
    return F.when((t != "") & t.rlike(ROMAN), total).otherwise(0)
