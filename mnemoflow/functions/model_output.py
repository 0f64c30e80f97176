"""Reading what a model answered: JSON in prose, claims with faults, fences, markers; when to ask again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

_CLOSING = {"{": "}", "[": "]"}


def balanced_span(text: str | None) -> str | None:
    """The first object or array that closes again; brackets within strings don't count."""
    if not text:
        return None
    for start, opening in enumerate(text):
        closing = _CLOSING.get(opening)
        if closing is None or text.rfind(closing) < start:
            continue
        depth, quoted, at = 0, False, start
        while at < len(text):
            c = text[at]
            if quoted:
                at += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if not depth:
                    return text[start : at + 1]
            at += 1
    return None


@F.pandas_udf(T.StringType())
def _balanced(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(balanced_span)


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def extract_json(raw: Column) -> Column:
    """The JSON in an answer: all of it, else its first fenced block, else its first balanced object or array. Null if there is none."""
    whole = strip(raw)
    fenced = strip(F.nullif(F.regexp_extract(whole, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit("")))
    plain = F.coalesce(_valid(whole), _valid(fenced))
    return F.coalesce(plain, _valid(_balanced(F.when(plain.isNull(), whole))))


def conforming(json: Column, schema: str, required: list[str]) -> Column:
    """The object of the schema with all that is required; of an array, its last element that conforms."""
    kind = T.StructType.fromDDL(schema)
    good = lambda o: F.coalesce(_all([o[name].isNotNull() for name in required]), F.lit(False))
    one, many = F.from_json(json, kind), F.from_json(json, T.ArrayType(kind))
    return F.when(F.startswith(F.ltrim(json), F.lit("[")), F.try_element_at(F.filter(many, good), F.lit(-1))).otherwise(F.when(good(one), one))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


#: What a claim must have.
CLAIM = "claim string, support array<string>, confidence double"


def tolerant_claims(json: Column, support: str = "support") -> Column:
    """The claims of an array that are whole; a faulty one is left out and spoils none of the others. ``support``: what its sources are called."""
    items = F.from_json(json, T.ArrayType(T.StringType()))
    kind = T.StructType.fromDDL(CLAIM.replace("support", support))
    read = F.transform(items, lambda x: F.from_json(x, kind))
    whole = lambda c: c["claim"].isNotNull() & c[support].isNotNull() & c["confidence"].isNotNull() & F.forall(c[support], lambda s: s.isNotNull())
    return F.coalesce(F.filter(read, whole), F.array().cast(T.ArrayType(kind)))


def unfence(text: Column) -> Column:
    """Without a code fence about all of it; other text is unchanged."""
    whole = strip(text)
    lines = F.split(whole, r"\r\n|\r|\n")
    closed = F.startswith(strip(F.element_at(lines, -1)), F.lit("```")) & (F.size(lines) > 1)
    body = F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1 - F.when(closed, 1).otherwise(0)))
    return F.when(F.startswith(whole, F.lit("```")), strip(F.array_join(body, "\n"))).otherwise(text)


# How an event is marked within a chunk.
def wrap_event(event_id: Column, text: Column) -> Column:
    return F.concat(F.lit("<<<EVT id="), event_id, F.lit(">>>\n"), text, F.lit("\n<<<END>>>"))


def marked_events(chunk: Column) -> Column:
    return F.regexp_extract_all(chunk, F.lit(r"<<<EVT id=([^>]+)>>>"), 1)


def source_event(source: Column) -> Column:
    """The event that a source names behind its last colon; null if it names none."""
    return F.when(F.contains(source, F.lit(":")), F.nullif(F.trim(F.substring_index(source, ":", -1)), F.lit("")))


# What a fault that passes by itself says.
PASSING_CODES = r"HTTP (408|409|429|500|502|503|504)\b"
PASSING = "(?i)timed out|fetch failed|overloaded|RESOURCE_EXHAUSTED|ECONNRESET|ETIMEDOUT|UND_ERR"


def transient(message: Column) -> Column:
    return F.regexp_like(message, F.lit(PASSING_CODES)) | F.regexp_like(message, F.lit(PASSING))


def retry_delay(attempt: Column, base_ms: int) -> Column:
    """Doubled with each attempt."""
    return (F.pow(F.lit(2.0), attempt) * base_ms).cast("long")


def stable_json(json: Column) -> Column:
    """The same JSON with the keys of all its objects in order and no blanks; null if it can't be read or repeats a key.

    Numbers with an exponent are written out (1e5 as 100000.0).
    """
    return F.to_json(F.try_parse_json(json))
