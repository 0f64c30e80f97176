"""License scans by an exact set-similarity join, in DataFrame functions only.

A block is a line of a text; its set is that of its words. Every block that
holds at least THRESHOLD of a template's words is found. The words of all
templates are counted over all documents; each template is then ordered from
its rarest word on. To hold ``need`` of n words, a block must hold one of the
first n - need + 1 (prefix filter), have ``need`` words at least (length
filter), and, where its first word in that order is at place p, leave n - p + 1
words from there on, ``need`` of them at least (positional filter). A document
none of whose words is in any prefix has no such block: only the others are
cut into lines. The templates are a short fixed list, so they stand in the
plan as a literal and the documents aren't shuffled.

Notices are also found where line ends cut them: a run is as many consecutive
words of the text as the template has, wherever the lines end, from one of the
template's words on. It matches by the same share. Only texts that hold enough
of a template's words at all, and there only runs about a word of its prefix,
are looked at.

Phrases are a base that doesn't depend on the templates: places where their
words stand consecutively.

Defined results: a null text is empty, without words, labels or score; repeated
rows are scanned each; other columns are ignored; a kept column named as a made
one comes back with ``_kept`` behind its name.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import kept_names, quoted

THRESHOLD = 0.8

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Usual one-line notices and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2.0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("distributed under the terms of the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("distributed under the terms of the gnu lesser general public license", "lgpl"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("licensed under cc by 4.0", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
)

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only) of a text; of null, none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS), "")


def _template_words(text: str) -> list[str]:
    return sorted({w for w in text.replace(".", " ").split()})


def frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Documents that hold each word of the templates; one row per such word comes back."""
    vocabulary = sorted({w for t, _ in TEMPLATES for w in _template_words(t)})
    found = docs.select(F.explode(F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocabulary)))).alias("w"))
    return {w: 0 for w in vocabulary} | {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _ordered(df: dict[str, int], threshold: float) -> list[tuple[str, list[str], int, int]]:
    """Label, words from the rarest on, how many of them a block needs, and the notice's length in words."""
    return [(label, sorted(_template_words(t), key=lambda w: (df[w], w)), ceil(threshold * len(_template_words(t)) - 1e-9), len(t.replace(".", " ").split())) for t, label in TEMPLATES]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _matches(block: Column, number: Column, templates: Column) -> Column:
    """The templates that the block (distinct words) holds enough of."""
    def bound(t: Column) -> Column:
        first = F.array_min(F.transform(F.array_intersect(block, t["prefix"]), lambda w: F.array_position(t["tokens"], w)))
        return F.size(t["tokens"]) - first + 1  # the words from the first match on

    passed = F.filter(templates, lambda t: (F.size(block) >= t["need"]) & F.arrays_overlap(block, t["prefix"]) & (bound(t) >= t["need"]))
    scored = F.transform(passed, lambda t: F.struct(number.alias("block"), t["label"].alias("label"), (F.size(F.array_intersect(block, t["tokens"])) / F.size(t["tokens"])).alias("containment"), t["need"].alias("need"), F.size(t["tokens"]).alias("n")))
    return F.filter(scored, lambda m: F.round(m["containment"] * m["n"]) >= m["need"])


def _runs(all_words: Column, templates: Column) -> Column:
    """The runs of words, across line ends, that hold enough of a template."""
    def starts(t: Column) -> Column:
        rare = F.filter(F.sequence(F.lit(0), F.size(all_words) - 1), lambda i: F.array_contains(t["prefix"], F.get(all_words, i)))
        near = F.array_distinct(F.flatten(F.transform(rare, lambda i: F.sequence(F.greatest(F.lit(0), i - t["length"] + 1), i))))
        return F.filter(near, lambda i: F.array_contains(t["tokens"], F.get(all_words, i)))

    def found(t: Column) -> Column:
        held = lambda i: F.size(F.array_intersect(F.slice(all_words, i + 1, t["length"]), t["tokens"]))
        scored = F.transform(starts(t), lambda i: F.struct(i.alias("start"), t["label"].alias("label"), held(i).alias("held")))
        return F.transform(F.filter(scored, lambda m: m["held"] >= t["need"]), lambda m: F.struct(m["start"].alias("start"), m["label"].alias("label"), (m["held"] / F.size(t["tokens"])).alias("containment")))

    whole = _strings(sorted({w for t, _ in TEMPLATES for w in _template_words(t)}))
    own = F.array(F.array_intersect(all_words, whole))  # one element, so that it's computed once
    return F.flatten(F.transform(own, lambda o: F.flatten(F.transform(F.filter(templates, lambda t: F.size(F.array_intersect(o, t["tokens"])) >= t["need"]), found))))


def scan(docs: DataFrame, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with ``n_words``, ``places`` (start and label of each phrase), ``matches``
    (block, label and containment of each block and template that meet the threshold) and ``runs`` (first
    word, label and containment of each run of words and template that do)."""
    ordered = _ordered(frequencies(docs, text), threshold)
    prefixes = {w: None for _, tokens, need, _ in ordered for w in tokens[: len(tokens) - need + 1]}
    templates = F.array(*[
        F.struct(F.lit(label).alias("label"), _strings(tokens).alias("tokens"), _strings(tokens[: len(tokens) - need + 1]).alias("prefix"), F.lit(need).alias("need"), F.lit(length).alias("length"))
        for label, tokens, need, length in ordered
    ])
    parts = [(p.split(), label) for p, label in PHRASES]
    inner = [f"__{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(quoted(n)).alias(i) for n, i in zip(keep, inner, strict=True)], F.col(quoted(text)).alias("__text"), words(F.col(quoted(text))).alias("__words"))

    def phrase(own: list[str], label: str) -> Column:
        w = F.col("__words")
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - len(own)), lambda i: _all([F.get(w, i + k) == x for k, x in enumerate(own)]))
        there = _all([F.array_contains(w, x) for x in own]) & (F.size(w) >= len(own))
        none = F.array().cast("array<struct<start:int,label:string>>")
        return F.when(there, F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))).otherwise(none)

    any_phrase = F.arrays_overlap("__words", _strings(sorted({own[-1] for own, _ in parts})))
    places = F.when(any_phrase, F.concat(*[phrase(own, label) for own, label in parts])).otherwise(F.array().cast("array<struct<start:int,label:string>>"))
    lines = F.split("__text", "\n")
    blocks = F.transform(lines, lambda line, i: F.struct(F.array_distinct(words(line)).alias("words"), i.alias("i")))
    kind = "array<struct<block:int,label:string,containment:double,need:int,n:int>>"
    any_prefix = F.arrays_overlap("__words", _strings(list(prefixes)))
    found = F.when(any_prefix, F.flatten(F.transform(blocks, lambda b: _matches(b["words"], b["i"], templates)))).otherwise(F.array().cast(kind))
    run_kind = "array<struct<start:int,label:string,containment:double>>"
    runs = F.when(any_prefix, _runs(F.col("__words"), templates)).otherwise(F.array().cast(run_kind))
    made = {"n_words": F.size("__words").cast("long"), "places": places, "matches": F.coalesce(found, F.array().cast(kind)), "runs": runs}
    return rows.select(*inner, *[c.alias(n) for n, c in made.items()]).toDF(*kept_names(keep, list(made)), *made)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
