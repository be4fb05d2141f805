"""Numbers and times on columns: dates in several shapes, vectors, scores in per cent, splits, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
#: Month names, English and Polish (nominative and genitive, without diacritics), by number.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "styczen": 1, "stycznia": 1, "luty": 2, "lutego": 2, "marzec": 3, "marca": 3, "kwiecien": 4, "kwietnia": 4, "maj": 5, "maja": 5, "czerwiec": 6, "czerwca": 6,
    "lipiec": 7, "lipca": 7, "sierpien": 8, "sierpnia": 8, "wrzesien": 9, "wrzesnia": 9, "pazdziernik": 10, "pazdziernika": 10, "listopad": 11, "listopada": 11, "grudzien": 12, "grudnia": 12,
}


def compact_date(iso: Column) -> Column:
    """2026-01-22 as 2026_0122; null for anything else."""
    return F.when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(F.substring(iso, 1, 4), F.lit("_"), F.substring(iso, 6, 2), F.substring(iso, 9, 2)))


def iso_date(compact: Column) -> Column:
    """2026_0122 as 2026-01-22; null for anything else."""
    return F.when(compact.rlike(r"^\d{4}_\d{4}$"), F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 6, 2), F.substring(compact, 8, 2)))


def utc(text: Column) -> Column:
    """A timestamp with any offset, or a date as its midnight; null if neither."""
    whole = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")
    return F.when(whole, F.try_to_timestamp(text)).when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))


def relative_seconds(text: Column) -> Column:
    """24h or 7d as seconds; null for anything else."""
    n = F.regexp_extract(F.trim(text), r"^(-?\d{1,12})[hd]$", 1)
    return F.when(n != "", n.cast("long") * F.when(F.endswith(F.trim(text), F.lit("h")), 3600).otherwise(86400))


def month_number(word: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.lower(word))


def month_range(year: Column, month: Column) -> Column:
    """struct(first, last): the days of a month as ISO dates."""
    first = F.make_date(year, month, F.lit(1))
    return F.struct(F.date_format(first, "yyyy-MM-dd").alias("first"), F.date_format(F.last_day(first), "yyyy-MM-dd").alias("last"))


def latest_time(text: Column) -> Column:
    """The latest UTC timestamp written in a text, null if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ"), F.lit(0))
    return F.array_max(F.transform(found, lambda t: F.try_to_timestamp(t)))


def unit(vector: Column) -> Column:
    """The vector divided by its length; one without length stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def dense_percent(cosine: Column) -> Column:
    return F.round((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)) + 1) * 50).cast("int")


def fused_percent(score: Column) -> Column:
    """A fused score against the best possible one, that of rank 1 in both lists."""
    return F.least(F.round(F.greatest(score, F.lit(0.0)) / F.lit(2.0 / (RRF_K + 1)) * 100), F.lit(100)).cast("int")


def match_quality(ratio: Column, quality: Column) -> Column:
    """60 times the share of terms found, plus the quality four times, or twice where less than half was found; 100 at most."""
    return F.least(F.floor(60 * ratio + quality * F.when(ratio >= 0.5, 4).otherwise(2)), F.lit(100)).cast("int")


def credited(entries: Column, written: Column, total: Column) -> Column:
    """Entries in proportion to the chunks written, rounded half up, in whole numbers."""
    return F.when(total > 0, F.floor((2 * entries * written + total) / (2 * total))).otherwise(0).cast("long")


def eta_seconds(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Seconds for all at the pace so far, rounded up; null before anything is done."""
    return F.when((done > 0) & (elapsed_ms > 0), F.ceil(elapsed_ms / done * F.greatest(total, F.lit(1)) / 1000))


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps; the first one's values win."""
    return F.map_zip_with(first, second, lambda _, a, b: F.coalesce(a, b))


def rounded_millis(ts: Column) -> Column:
    """Milliseconds since 1970 by the clock of ``ts``, microseconds rounded to the nearest, halves away from zero."""
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    micros = ((F.unix_date(ts.cast("date")).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second
    return whole(F.when(micros < 0, micros - 500).otherwise(micros + 500), 1000)


def whole(x: Column, by: int) -> Column:
    """The quotient of long numbers without its fraction, as SQL's // gives it: towards zero."""
    return ((x - x % by) / by).cast("long")


def at_second(seconds: Column) -> Column:
    """The timestamp without zone so many seconds after 1970."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
