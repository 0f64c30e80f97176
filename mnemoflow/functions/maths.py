"""Scores, statistics and a counter-based random generator, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def round2(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x * 100 + 0.5) / 100


def fullness(tokens: Column, limit: Column) -> Column:
    return F.when(limit <= 0, 0.0).otherwise(F.least(F.lit(100.0), tokens / limit * 100))


# Upper bounds (exclusive), recommendations and labels.
HEALTH = (
    (55, "continue", "Healthy"),
    (65, "watch", "Watch zone"),
    (75, "split_candidate", "Split candidate"),
    (85, "freeze_recommended", "Freeze zone"),
    (101, "danger_zone", "Danger zone"),
)


def health(pct: Column, name: int = 1) -> Column:
    """The recommendation (1) or label (2) for a fullness."""
    out = F.when(pct < HEALTH[0][0], HEALTH[0][name])
    for row in HEALTH[1:-1]:
        out = out.when(pct < row[0], row[name])
    return out.otherwise(HEALTH[-1][name])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def bm25(tf: Column, df: Column, length: Column, average: Column, documents: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.log((documents - df + 0.5) / (df + 0.5) + 1)
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / average))


def mul32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers below 2 ** 32."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def mulberry32_draws(seed: Column, ks: Column) -> Column:
    """Draws of the stream of a seed, in [0, 1), for an array of their numbers (from 1). Each depends on (seed, number) alone.

    One step per array, so that a step's result is named once and not written out again.
    """
    # The generator's constants.
    step, one, sixty_one = F.lit(0x6D2B79F5).cast("long"), F.lit(1).cast("long"), F.lit(61).cast("long")
    states = F.transform(ks, lambda k: (seed.cast("long") + mul32(k.cast("long").bitwiseAND(F.lit(_MASK)), step)).bitwiseAND(F.lit(_MASK)))
    mixed = F.transform(states, lambda a: mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(one)))
    mixed = F.transform(mixed, lambda t: t.bitwiseXOR((t + mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(sixty_one))).bitwiseAND(F.lit(_MASK))))
    return F.transform(mixed, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296.0)


def mulberry32(seed: Column, k: Column) -> Column:
    """Draw k of the stream of a seed."""
    return mulberry32_draws(seed, F.array(k))[0]


def citation_scores(cited: Column, relevant: Column) -> Column:
    """Precision, recall and F1 of two sets of ids."""
    c, r = F.array_distinct(cited), F.array_distinct(relevant)
    return citation_rates(F.size(c), F.size(r), F.size(F.array_intersect(c, r)))


def citation_rates(cited: Column, relevant: Column, hit: Column) -> Column:
    """Precision, recall and F1 from the numbers of ids cited, relevant and both."""
    p = F.when((cited == 0) & (relevant == 0), 1.0).when((cited == 0) | (relevant == 0), 0.0).otherwise(hit / cited)
    q = F.when(relevant == 0, 1.0).when(cited == 0, 0.0).otherwise(hit / relevant)
    return F.struct(p.alias("precision"), q.alias("recall"), F.when(p + q == 0, 0.0).otherwise(2 * p * q / (p + q)).alias("f1"))


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.when(n >= 2, F.sequence(F.lit(2), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def binomial_p(a_only: Column, b_only: Column) -> Column:
    """Two-sided exact test of equal discordant counts."""
    n = (a_only + b_only).cast("int")
    least = F.least(a_only, b_only).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), least), F.lit(0.0), lambda s, i: s + F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + n * F.log(F.lit(0.5))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def pct_delta(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, old) * 100


def format_tokens(n: Column) -> Column:
    """Thousands, millions or billions, without decimals."""
    unit = lambda size, name: F.concat(F.format_string("%.0f", n / size), F.lit(name))
    return F.when(n >= 1e9, unit(1e9, "B")).when(n >= 1e6, unit(1e6, "M")).when(n >= 1e3, unit(1e3, "K")).otherwise(n.cast("string"))
