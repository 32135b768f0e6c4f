"""Column functions of speech pace: rates, limits, costs and waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Voice rates, the video's slowest factor, grid of rates, characters a second, growth of a translation.
COMFORT, VOICE_MAX, VIDEO_MIN, STEP, PER_SECOND, GROWTH = 1.12, 1.25, 0.75, 0.05, 17.5, 1.15
BLOCKS = (3000, 1500, 800, 400)


def half_up(c: Column, digits: int = 0) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rate_down(rate: Column) -> Column:
    """Largest step of STEP at or below the rate, within 0.25 and 2; 1 for rates that are not positive."""
    return F.when(F.coalesce(rate, F.lit(1.0)) <= 0, 1.0).otherwise(clamp(half_up(F.floor(F.coalesce(rate, F.lit(1.0)) / STEP + 1e-9) * STEP, 2), 0.25, 2.0))


def rate_needed(voice: Column, room: Column, most: float = VOICE_MAX) -> Column:
    """Rate at which a voice fits its room, up to `most` in steps of STEP."""
    raw = voice / room
    step = half_up(F.ceil(raw / STEP - 1e-9) * STEP, 2)
    return F.when(F.coalesce(voice, F.lit(0.0)) <= 0, 1.0).when(~(room > 0) | room.isNull(), most).when(raw <= 1, 1.0).otherwise(F.least(F.lit(most), step))


def voice_rate(left: Column, now: Column, soft: Column, hard: Column) -> Column:
    """Comfortable rate to end at the soft limit if that is enough, else what the hard limit takes, up to the ceiling."""
    need = lambda limit: F.when(limit - now > 0.05, left / (limit - now)).otherwise(F.lit(float("inf")))
    a, b = need(soft), need(F.coalesce(hard, soft))
    return F.when(left <= 0, 1.0).when(a <= COMFORT, half_up(F.greatest(F.lit(1.0), a), 2)).otherwise(half_up(clamp(b, COMFORT, VOICE_MAX), 2))


def video_rate_raw(needed: Column, video: Column, delay: Column) -> Column:
    """Video speed at which the voice fits at a comfortable rate; delays slow it further."""
    factor = F.when((needed > 0.2) & (video > 0.2), F.least(F.lit(1.0), video * COMFORT / needed)).when(needed > 0.2, VIDEO_MIN).otherwise(1.0)
    factor = F.when(factor > 0.96, 1.0).otherwise(factor)
    factor = F.when(delay > 1.5, F.least(factor, F.lit(0.85))).otherwise(factor)
    factor = F.when(delay > 3, F.least(factor, F.lit(VIDEO_MIN))).otherwise(factor)
    return F.greatest(F.lit(VIDEO_MIN), factor)


def video_rate(needed: Column, video: Column, delay: Column) -> Column:
    """The nearest step to video_rate_raw."""
    raw = video_rate_raw(needed, video, delay)
    return F.when(raw >= 1 - 1e-9, 1.0).otherwise(half_up(clamp(F.floor(raw / STEP + 1e-9 + 0.5) * STEP, VIDEO_MIN, 1.0), 2))


def voice_seconds(measured: Column, state: Column, text: Column, source: Column) -> Column:
    """Measured length, 0 where the original sounds, else estimated from the text or its source."""
    of = lambda c: F.length(F.coalesce(c, F.lit("")))
    return (
        F.when(measured > 0, measured).when(state.isin("no_voice", "error"), 0.0).when(of(text) > 0, of(text) / PER_SECOND)
        .otherwise(of(source) * GROWTH / PER_SECOND)
    )


def speech_cost(text: Column) -> Column:
    """Letters and digits, 6 for a strong stop, 3 for a soft one, 2 for a dash."""
    n = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return n(r"[\p{L}\p{N}]") + n("[.!?…]") * 6 + n("[,;:]") * 3 + n("[–—]") * 2


def retry_wait(times: Column) -> Column:
    """Milliseconds before the next try: doubling from 400 up to 5000."""
    return F.least(F.lit(5000), (F.pow(F.lit(2), F.least(F.greatest(F.coalesce(times, F.lit(1)), F.lit(1)), F.lit(20)) - 1) * 400).cast("int"))


def smaller_block(length: Column, size: Column) -> Column:
    """Largest of BLOCKS below both the size and the text, null if there is none."""
    return F.array_max(F.filter(F.array(*map(F.lit, BLOCKS)), lambda t: t < F.least(size, F.greatest(length, F.lit(0)))))


def token_budget(text: Column, factor: float = 1.8, least: int = 256, most: int = 8192) -> Column:
    """Tokens to allow for an answer of the text's length."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.length(F.coalesce(text, F.lit(""))) / 3.2 * factor).cast("int") + 256))


def credits(seconds: Column) -> Column:
    return (F.ceil(F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)) / 60) * 2).cast("long")
