"""Column functions on text, identifiers and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a column that is computed once for a row, however often it is used: it comes out of a generator, so its uses are no copies of the expression."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def fold(c: Column) -> Column:
    """Lower case without accents; null stays null."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Words that say nothing about a text.
STOP = (
    "el la los las un una unos unas lo al del de a ante bajo con contra desde en entre hacia hasta para por segun sin sobre tras durante mediante "
    "y e ni o u pero sino aunque porque pues que como cuando donde quien cual cuyo si no se su sus mi mis tu tus me te le les nos os "
    "yo ti ti el ella ellos ellas usted ustedes este esta estos estas ese esa esos esas aquel aquella esto eso aquello es son era eran fue "
    "fueron ser estar esta estan estaba hay ha han habia he has hemos muy mas menos ya aun tambien solo todo toda todos todas otro otra otros otras "
    "mismo misma tan tanto cada algun alguna algunos algunas ningun ninguna nada algo alguien nadie "
    "the a an and or but if then of to in on at by for with from as is are was were be been this that these those it its his her their "
    "not no so than too very can will would there what which who when where how all any some"
).split()


def words(c: Column) -> Column:
    """Runs of letters and digits of the folded text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def stem(w: Column) -> Column:
    """A folded word without a Spanish or English ending of plurals, or of adverbs in -mente."""
    w = F.when((F.length(w) > 6) & w.endswith("mente"), w.substr(F.lit(1), F.length(w) - 5)).otherwise(w)
    cut = lambda n: w.substr(F.lit(1), F.length(w) - n)
    return (
        F.when((F.length(w) > 5) & w.endswith("ces"), F.concat(cut(3), F.lit("z"))).when((F.length(w) > 4) & w.endswith("es"), cut(2))
        .when((F.length(w) > 3) & w.endswith("s"), cut(1)).otherwise(w)
    )


def search_terms(c: Column) -> Column:
    """Stems of the folded text's words of two letters or more that aren't stop words, before and after stemming."""
    told = lambda w: (F.length(w) >= 2) & ~w.isin(STOP)
    raw = F.filter(F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), told)
    return F.filter(F.transform(raw, stem), told)


def count_in(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term)))


def hits(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences, case folded."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def strip_html(c: Column) -> Column:
    """Visible text: scripts, styles and tags removed, five entities decoded, blanks squeezed."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return squeeze(c)


def consecutive_distinct(lines: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(lines, i - 1)))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour, rounded; negative and null values count as zero."""
    s = F.greatest(F.coalesce(F.floor(seconds + 0.5), F.lit(0)), F.lit(0)).cast("long")
    h, m, s = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def iso_duration(c: Column) -> Column:
    """Seconds of an ISO-8601 duration with days to seconds; 0 where it is not one."""
    part = lambda unit: F.coalesce(F.regexp_extract(c, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))
    total = part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S")
    return F.when(c.rlike(r"^P(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$"), total).otherwise(F.lit(0)).cast("long")


def watch_state(position: Column, duration: Column) -> Column:
    """new below 15 s or without a position; done within the last 30 s or past 95 %; else watching."""
    done = (duration > 0) & ((duration - position <= 30) | (position >= 0.95 * duration))
    return F.when(F.coalesce(position, F.lit(0)) < 15, "new").when(done, "done").otherwise("watching")
