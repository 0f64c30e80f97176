"""Dates in text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how months are spelt.
_MONTHS = r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: How months begin, in order.
_SHORT = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMED = rf"\b(?:{_MONTHS})[\s-]+\d{{1,2}},?[\s-]+\d{{4}}\b"
ISO = r"\b\d{4}-\d{2}-\d{2}\b"


def date_phrases(text: Column) -> Column:
    """Dates by month name, then ISO dates; 8 at most."""
    named = F.transform(F.regexp_extract_all(text, F.lit(NAMED), 0), lambda d: F.replace(d, F.lit("-"), F.lit(" ")))
    return F.slice(F.concat(named, F.regexp_extract_all(text, F.lit(ISO), 0)), 1, 8)


def parse_date(phrase: Column) -> Column:
    """The day; one beyond the month's end runs into the next."""
    part = lambda p, k: F.regexp_extract(phrase, p, k)
    iso, named = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"([A-Za-z]+)[\s-]+(\d{1,2}),?[\s-]+(\d{4})\b"
    place = F.array_position(F.array(*map(F.lit, _SHORT)), F.lower(F.substring(part(named, 1), 1, 3)))
    of_iso = F.date_add(F.add_months(F.make_date(part(iso, 1).try_cast("int"), F.lit(1), F.lit(1)), part(iso, 2).try_cast("int") - 1), part(iso, 3).try_cast("int") - 1)
    of_name = F.date_add(F.make_date(part(named, 3).try_cast("int"), place.cast("int"), F.lit(1)), part(named, 2).try_cast("int") - 1)
    return F.when(part(iso, 1) != "", of_iso).when((part(named, 3) != "") & (place > 0), of_name)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def recency(updated: Column, ref: Column, horizon: float = 90.0) -> Column:
    """1 at the moment itself, 0 from the horizon on; null for no time."""
    days = (F.unix_micros(ref) - F.unix_micros(updated)) / 86_400_000_000.0
    return F.greatest(F.lit(0.0), 1 - days / horizon)


def turn_time(chunk: Column) -> Column:
    """The day that heads a turn, as [Month-d-yyyy | Turn n]."""
    return parse_date(F.nullif(F.regexp_extract(chunk, r"^\[([A-Z][a-z]+-\d{1,2}-\d{4})\s+\|\s*Turn\s+\d+\]", 1), F.lit("")))
