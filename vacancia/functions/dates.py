"""Dates in the shapes feeds and trackers write them. "Now" is always a parameter."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .patterns import let

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# each format with the signs that a text must hold to fit it; a format that fails is dear, so only those that may fit are tried
_TEXT_FORMATS = [
    ("yyyy-MM-dd'T'HH:mm:ss[.SSS][.SSSSSS]XXX", "-T:"), ("yyyy-MM-dd'T'HH:mm:ss[.SSS]", "-T:"), ("yyyy-MM-dd HH:mm:ss 'UTC'", "- :U"),
    ("yyyy-MM-dd HH:mm:ss[.SSS]", "- :"), ("yyyy-MM-dd'T'HH:mmXXX", "-T:"), ("yyyy-MM-dd", "-"), ("d MMM yyyy HH:mm:ss Z", " :+"),
    ("d MMM yyyy HH:mm:ss z", " :"), ("d MMM yyyy", " "), ("MMM d, yyyy", " ,"), ("MMMM d, yyyy", " ,"), ("yyyy/MM/dd", "/"),
]


def _may_fit(s: Column, signs: str) -> Column:
    """Whether the text holds all ``signs``; letters in either case, and a plus stands for the sign of an offset."""
    other = {"+": "-", "T": "t", "U": "u"}
    tests = [F.contains(s, F.lit(x)) | F.contains(s, F.lit(other[x])) if x in other else F.contains(s, F.lit(x)) for x in signs]
    return reduce(lambda a, b: a & b, tests)


def epoch_instant(n: Column) -> Column:
    """Seconds below 1e12, milliseconds from there on."""
    return F.timestamp_millis(F.when(n < 1e12, n * 1000).otherwise(n).cast("long"))


def any_instant(text: Column) -> Column:
    """Timestamp of a date text or digit run; NULL when it reads as neither."""
    def read(s: Column) -> Column:
        tried = F.coalesce(*[F.when(_may_fit(s, signs), F.try_to_timestamp(s, F.lit(f))) for f, signs in _TEXT_FORMATS])
        return F.when(F.rlike(s, F.lit(r"^\d{10,13}$")), epoch_instant(s.try_cast("double"))).otherwise(tried)

    # the weekday of mail dates carries nothing
    return let(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", ""), read)


def iso_epoch(number: Column) -> Column:
    """ISO-8601 text of an epoch number in seconds or milliseconds; '' when it is none."""
    return F.coalesce(F.date_format(epoch_instant(number.try_cast("double")), ISO), F.lit(""))


def iso_instant(text: Column) -> Column:
    """ISO-8601 text with milliseconds; '' when missing or unreadable."""
    return F.coalesce(F.date_format(any_instant(text), ISO), F.lit(""))


# Length of the units of relative dates, in seconds.
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def relative_instant(text: Column, now: Column) -> Column:
    """'3 weeks ago', 'yesterday', 'just now' as a timestamp counted back from ``now``."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^posted\s*", ""))
    ago = r"^(?:(\d+)|an?)\s+(minute|hour|day|week|month|year)s?\s+ago"
    number = F.regexp_extract(s, ago, 1)
    unit = F.regexp_extract(s, ago, 2)
    seconds = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    count = F.when(number == "", F.lit(1)).otherwise(number.try_cast("long"))
    back = (F.when(F.rlike(s, F.lit(r"^(just now|today|moments? ago)\b")), F.lit(0))
            .when(F.rlike(s, F.lit(r"^yesterday\b")), F.lit(UNIT_SECONDS["day"]))
            .when(unit != "", count * F.try_element_at(seconds, unit)))
    return F.timestamp_millis(F.unix_millis(now.cast("timestamp")) - back * 1000)


def strict_date(text: Column) -> Column:
    """Date of a bare YYYY-MM-DD; NULL for any other shape."""
    s = F.trim(text)
    return F.when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}$")), s.try_cast("date"))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def iso_week(d: Column) -> Column:
    """'2024-W05' with the ISO year, which differs from the calendar year at its edges."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))
