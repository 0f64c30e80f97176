"""Text functions as columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import BRIDGE_STOP, CONTENT_STOP, HIGH_SIGNAL, ROUTER_STOP, SYNONYMS

_STRINGS = "array<string>"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast(_STRINGS)


def strip(text: Column) -> Column:
    """Without white space, line ends too, at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def tokenize_router(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: (F.length(t) > 1) & ~t.isin(ROUTER_STOP))


def tokenize_bm25(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def prefix_match(a: Column, b: Column) -> Column:
    """Equal, or the shorter has 4 characters or more and begins the longer."""
    short = F.least(F.length(a), F.length(b))
    return (a == b) | ((short >= 4) & (F.startswith(a, b) | F.startswith(b, a)))


def matched_terms(terms: Column, vocabulary: Column) -> Column:
    """How many of the terms match any of the vocabulary."""
    return F.size(F.filter(terms, lambda t: F.exists(vocabulary, lambda v: prefix_match(t, v))))


def relevance_parts(tags: Column, content: Column) -> tuple[Column, Column]:
    """What ``relevance`` needs of an event: its tags and first 200 characters in lower case, made once for all questions."""
    return F.transform(tags, F.lower), F.lower(F.substring(content, 1, 200))


def relevance(tags: Column, head: Column, terms: Column) -> Column:
    """2 for each tag that a term equals or (from 4 characters on) shares a beginning with; 1 for each term in the head."""
    tag_hits = F.size(F.filter(tags, lambda g: F.exists(terms, lambda t: (t == g) | ((F.length(t) >= 4) & (F.startswith(t, g) | F.startswith(g, t))))))
    return tag_hits * 2 + F.size(F.filter(terms, lambda t: F.contains(head, t)))


def _terms(text: Column, pattern: str, stop: list[str], most: int) -> Column:
    raw = F.regexp_extract_all(text, F.lit(pattern), 0)
    kept = F.filter(
        F.transform(raw, lambda r: F.struct(r.alias("raw"), F.regexp_replace(F.lower(r), "'s$", "").alias("term"))),
        lambda x: ((F.length(x["term"]) >= 4) | (F.substring(x["raw"], 1, 1) == F.upper(F.substring(x["raw"], 1, 1)))) & ~x["term"].isin(stop),
    )
    return F.slice(F.array_distinct(F.transform(kept, lambda x: x["term"])), 1, most)


def bridge_terms(text: Column) -> Column:
    return _terms(text, "[A-Za-z][A-Za-z'-]{2,}", BRIDGE_STOP, 12)


def content_terms(text: Column) -> Column:
    return _terms(text, "[A-Za-z][A-Za-z0-9_.:-]{2,}", CONTENT_STOP, 16)


def expand_terms(terms: Column) -> Column:
    """The terms and those that triggers among them add, in order, 48 at most."""
    out = terms
    for trigger, more in SYNONYMS.items():
        out = F.when(F.array_contains(out, trigger), F.array_distinct(F.concat(out, strings(more)))).otherwise(out)
    return F.slice(out, 1, 48)


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def has_word(content: Column, words: Column, term: Column) -> Column:
    """Whether the term stands between word borders; ``words``: the lower-cased content's words."""
    return F.when(F.regexp_like(term, F.lit("^[a-z0-9_]+$")), F.array_contains(words, term)).otherwise(F.regexp_like(F.lower(content), F.concat(F.lit(r"\b"), _quoted(term), F.lit(r"\b"))))


def ascii_words(content: Column) -> Column:
    return F.split(F.lower(content), "[^a-z0-9_]+")


def bridge_score(content: Column, terms: Column) -> Column:
    words = ascii_words(content)
    return F.size(F.filter(terms, lambda t: has_word(content, words, t)))


def coverage_score(content: Column, terms: Column) -> Column:
    """2 for each term of 7 characters or more that stands in the content, 1 for a shorter; 1 if it has a date."""
    from .dates import date_phrases

    words = ascii_words(content)
    hits = F.filter(terms, lambda t: has_word(content, words, t))
    per_term = F.aggregate(hits, F.lit(0), lambda s, t: s + F.when(F.length(t) >= 7, 2).otherwise(1))
    return per_term + F.when(F.size(date_phrases(content)) > 0, 1).otherwise(0)


def signal_weight(term: Column) -> Column:
    low = F.lower(term)
    dated = F.regexp_like(low, F.lit(r"^\d{4}-\d{2}-\d{2}$")) | F.regexp_like(low, F.lit("^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"))
    return F.when(F.array_contains(strings(HIGH_SIGNAL), low), 100).when(dated, 80).otherwise(F.least(F.lit(40), F.length(low)))


def strong_terms(content: Column, terms: Column) -> Column:
    words = ascii_words(content)
    return F.array_distinct(F.filter(terms, lambda t: (signal_weight(t) >= 50) & has_word(content, words, t)))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(content: Column, terms: Column, most: int) -> Column:
    """A window about the strongest term (the earliest of equals), a third of it before the hit."""
    from .dates import date_phrases

    def about(clean: Column, low: Column) -> Column:
        needles = F.array_distinct(F.concat(F.filter(terms, lambda t: F.length(t) > 0), F.transform(date_phrases(clean), F.lower)))
        hits = F.filter(F.transform(needles, lambda t: F.struct(signal_weight(t).alias("w"), (-F.instr(low, F.lower(t))).alias("p"))), lambda x: x["p"] < 0)
        center = F.coalesce(-F.array_max(hits)["p"] - 1, F.lit(0))
        return named(center - most // 3, lambda start: _window(clean, start, most))

    return named(flat(content), lambda clean: named(F.lower(clean), lambda low: about(clean, low)))


def _window(clean: Column, start: Column, most: int) -> Column:
    start = F.greatest(F.lit(0), start)
    end = F.least(F.length(clean), start + most)
    body = F.trim(F.substring(clean, start + 1, end - start))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(clean), "...").otherwise(""))
    return F.when(F.length(clean) <= most, clean).otherwise(cut)


def date_excerpt(content: Column, date: Column, most: int) -> Column:
    """A window about the date in any of its spellings, 65 % of it before the hit."""
    clean = flat(content)
    low = F.lower(clean)
    spellings = [date, F.replace(date, F.lit(","), F.lit("")), F.replace(date, F.lit("-"), F.lit(" ")), F.replace(date, F.lit(" "), F.lit("-"))]
    hit = F.coalesce(*[F.nullif(F.instr(low, F.lower(s)), F.lit(0)) for s in spellings])
    start = F.greatest(F.lit(0), hit - 1 - int(most * 0.65))
    end = F.least(F.length(clean), start + most)
    body = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(clean, start + 1, end - start)), F.when(end < F.length(clean), "...").otherwise(""))
    return F.when(hit.isNull(), excerpt(content, F.array(date), most)).otherwise(body)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def slugify(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)


def human_size(text: Column) -> Column:
    """8K is 8000: K, M, B (or G) are decimal; null for anything else."""
    form = r"^([0-9.]+)\s*([KkMmBbGg]?)$"
    number = F.regexp_extract(text, form, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, form, 2))
    return F.floor(number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit.isin("b", "g"), 1e9).otherwise(1.0) + 0.5).cast("long")


def intent(query: Column) -> Column:
    """What a question asks for, as flags."""
    q = F.lower(query)
    # The patterns of each intent.
    patterns = {
        "broad_summary": r"\b(summary|summarize|recap|overview|comprehensive|across (our|my|the) (discussion|discussions|conversation|conversations|history))\b",
        "temporal": r"\b(how many (days|weeks|months|years)|duration|between when|between .* and|before|after|earlier|later|when did|timeline|chronological|order)\b",
        "contradiction": r"\b(contradict|contradictory|conflict|inconsistent|which statement is correct|have i .* before|did i .* before)\b",
        "count_like": r"\b(how many|number of|count|different|distinct)\b",
        "user_centric": r"\b(i|my|me|mine)\b",
        "abstention_risk": r"\b(rationale|reason behind|why did|why was|why choose|why choosing|choosing)\b",
    }
    return F.struct(*[F.regexp_like(q, F.lit(p)).alias(n) for n, p in patterns.items()])


#: Fixed value: how a turn is headed.
TURN = r"(?:^|\n)\s*((?:\[[^\]\n]*?\s*\|\s*)?\[?[Tt]urn\s+\d+\]?)"
ROLE = r"(?i)(?:^|\n)\s*(?:\[[^\]\n]*?\s*\|\s*)?\[?Turn\s+\d+\]?\s+(User|Assistant):"


def event_role(content: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(content, ROLE, 1)), F.lit("")), F.lit("memory"))


def turn_label(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, TURN, 1), F.lit(""))


def turn_number(content: Column, event_id: Column) -> Column:
    own = F.nullif(F.regexp_extract(content, r"(?i)\bTurn\s+(\d+)\b", 1), F.lit(""))
    by_id = F.nullif(F.regexp_extract(event_id, r"#turn-(\d+)$", 1), F.lit(""))
    return F.coalesce(own.cast("long"), by_id.cast("long"), F.lit(9007199254740991))


def split_turns(content: Column) -> Column:
    """The turns of a transcript; of one with a single turn or none, nothing."""
    clean = strip(F.regexp_replace(content, "\r\n", "\n"))
    head = r"(?=(?:^|\n)\s*(?:\[[^\]\n]*?\s*\|\s*)?\[?Turn\s+\d+\]?\s+(?:User|Assistant):)"
    parts = F.filter(F.transform(F.split(clean, head), strip), lambda p: F.regexp_like(p, F.lit(r"^(?:\[[^\]\n]*?\s*\|\s*)?\[?Turn\s+\d+\]?\s+(?:User|Assistant):")))
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast(_STRINGS))


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: F.length(s) > 0)


def snippet(event_id: Column, content: Column, terms: Column, most: int = 360) -> Column:
    from .dates import date_phrases

    dates = F.slice(F.array_distinct(date_phrases(content)), 1, 3)
    anchors = F.slice(strong_terms(content, terms), 1, 5)
    return F.concat(
        F.lit("["), event_id, F.lit("] "), F.coalesce(turn_label(content), event_id), F.lit(" "), event_role(content), F.lit(":"),
        F.when(F.size(dates) > 0, F.concat(F.lit(" dates="), F.array_join(dates, ", "), F.lit(";"))).otherwise(""),
        F.when(F.size(anchors) > 0, F.concat(F.lit(" anchors="), F.array_join(anchors, ", "), F.lit(";"))).otherwise(""),
        F.lit(" "), excerpt(content, terms, most),
    )
