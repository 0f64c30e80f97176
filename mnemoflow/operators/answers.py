"""Answers of a model: parsing, normalising, scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRINGS = "array<string>"
_WRAP = r"[\s\[\](){}`'\"*.!?:]+"


def normalise(answer: Column) -> Column:
    """Trimmed, lower-cased, without closing marks and a leading article, single blanks."""
    out = F.lower(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    out = F.regexp_replace(out, r"[.!?,;:]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"^the\s+", ""), r"\s+", " ")


def citation_id(token: Column) -> Column:
    return F.regexp_replace(token, f"^{_WRAP}|{_WRAP}$", "")


def citations(raw: Column) -> Column:
    ids = F.transform(F.split(raw, "[,;]"), citation_id)
    return F.filter(ids, lambda s: (F.length(s) > 0) & (F.lower(s) != "none"))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def parse_choice(output: Column, options: Column) -> Column:
    """(chosen, cited): the last ANSWER counts, even out of range (then none is chosen); else the last option named; else the first number in range."""
    answers = F.regexp_extract_all(output, F.lit(r"(?i)ANSWER\s*[:=]\s*(\d+)"), 1)
    named = F.regexp_extract_all(output, F.lit(r"(?i)\b(?:option|choice|answer)\s+(\d+)\b"), 1)
    fits = lambda n: F.when((n >= 1) & (n <= options), n)
    numbers = F.filter(F.transform(F.regexp_extract_all(output, F.lit(r"\b\d+\b"), 0), lambda s: s.try_cast("int")), lambda n: (n >= 1) & (n <= options))
    fallback = F.coalesce(fits(_last(named).try_cast("int")), F.get(numbers, 0))
    chosen = F.when(F.size(answers) > 0, fits(_last(answers).try_cast("int"))).otherwise(fallback)
    cited = _last(F.regexp_extract_all(output, F.lit(r"(?i)CITATIONS\s*[:=]\s*([^\n\r]+)"), 1))
    return F.struct(chosen.alias("chosen"), F.coalesce(citations(cited), F.array().cast(_STRINGS)).alias("cited"))


def parse_free(output: Column) -> Column:
    """(chosen, cited): the first ANSWER line, else the first line that isn't blank or of citations."""
    found = F.regexp_extract_all(output, F.lit(r"(?i)ANSWER\s*[:=]\s*([^\n\r]+)"), 1)
    lines = F.filter(F.transform(F.split(output, "\r?\n"), lambda s: F.trim(s)), lambda s: (F.length(s) > 0) & ~F.regexp_like(s, F.lit(r"(?i)^citations\s*[:=]")))
    chosen = F.when(F.size(found) > 0, F.nullif(F.trim(F.get(found, 0)), F.lit(""))).otherwise(F.get(lines, 0))
    cited = F.get(F.regexp_extract_all(output, F.lit(r"(?i)CITATIONS\s*[:=]\s*([^\n\r]+)"), 1), 0)
    return F.struct(chosen.alias("chosen"), F.coalesce(citations(cited), F.array().cast(_STRINGS)).alias("cited"))


def is_correct(chosen: Column, accepted: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(accepted, normalise), normalise(chosen)), F.lit(False))
