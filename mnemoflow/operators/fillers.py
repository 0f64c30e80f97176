"""Filler events: variants of seeds with jittered sums, counts, shares, dates and names."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import draws, fnv1a

# Names that stand for one another.
SWAPS = (
    ("Stripe", "Adyen", "Worldpay", "Braintree", "Checkout"),
    ("Postgres", "MySQL", "CockroachDB", "PlanetScale"),
    ("AWS", "GCP", "Azure", "Fly.io", "Render"),
    ("Datadog", "Honeycomb", "Lightstep", "New Relic"),
    ("Stripe Connect", "Marketplace API", "Connect Express"),
    ("Twilio", "Vonage", "MessageBird", "Plivo"),
    ("Slack", "Discord", "Mattermost", "Zulip"),
    ("v1", "v2", "v3", "v4"),
    ("beta", "alpha", "RC1", "GA"),
    ("MVP", "v0.5", "preview", "0.9"),
    ("P0", "P1", "P2"),
    ("critical", "high", "medium", "low"),
)
# What is counted.
_UNITS = "attempts|seconds|minutes|hours|days|weeks|months|customers|partners|requests|webhooks|engineers|tickets|merchants"
# How counts, sums, shares and dates are written; letters and digits are those of ASCII.
_COUNT = re.compile(rf"\b(\d+)\s+({_UNITS})\b", re.ASCII)
_DOLLAR = re.compile(r"\$(\d+(?:\.\d+)?)\s*([KkMmBb]?)\b", re.ASCII)
_PERCENT = re.compile(r"\b(\d+(?:\.\d+)?)%", re.ASCII)
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MONTH_DAY = re.compile(rf"\b({'|'.join(_MONTHS)})\s+(\d{{1,2}})\b", re.ASCII)
_ISO = re.compile(r"\b(202[5-7])-(\d{2})-(\d{2})\b", re.ASCII)


def _whole(x: float) -> int:
    return int(x + 0.5)


def _tenth(x: float) -> str:
    """To one decimal, exact halves upwards."""
    return str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def _shift(draw: float) -> dt.timedelta:
    return dt.timedelta(days=math.floor((draw - 0.5) * 120))


def mutate(content: str, stream: Iterator[float]) -> str:
    """One variant: each rule draws from the stream in the order of its matches."""
    draw = lambda: next(stream)

    def dollars(m: re.Match) -> str:
        x = float(m[1]) * (0.7 + draw() * 0.6)
        return f"${_tenth(x)}{m[2]}" if x < 10 else f"${_whole(x)}{m[2]}"

    def counts(m: re.Match) -> str:
        n = int(m[1])
        return m[0] if n <= 1 else f"{max(1, _whole(n * (0.5 + draw() * 1.5)))} {m[2]}"

    def percents(m: re.Match) -> str:
        n = float(m[1])
        x = max(0.0, n + (draw() - 0.5) * max(0.5, n * 0.4))
        return f"{_tenth(x)}%" if n < 10 else f"{_whole(x)}%"

    out = _PERCENT.sub(percents, _COUNT.sub(counts, _DOLLAR.sub(dollars, content)))
    shift = _shift(draw())

    def month_day(m: re.Match) -> str:
        day = dt.date(2026, _MONTHS.index(m[1]) + 1, 1) + dt.timedelta(days=int(m[2]) - 1) + shift
        return f"{_MONTHS[day.month - 1]} {day.day}"

    def iso(m: re.Match) -> str:
        try:
            return (dt.date(int(m[1]), int(m[2]), int(m[3])) + shift).isoformat()
        except ValueError:
            return m[0]

    out = _ISO.sub(iso, _MONTH_DAY.sub(month_day, out))
    for group in SWAPS:  # one name of each group, the first that stands there
        for name in group:
            where = re.compile(rf"\b{name}\b", re.ASCII)  # a full stop in a name stands for any character
            if where.search(out):
                others = [x for x in group if x != name]
                new = others[int(draw() * len(others))]
                out = where.sub(lambda _, new=new: new, out)
                break
    return out


def variants(seeds: DataFrame, factor: int, seed: int, tier: int = 2) -> DataFrame:
    """``factor`` variants of each seed event (event_id, shard_id, content, tags, and a timestamp if it has one).

    A stream of each seed's own runs on through its variants, whose dates of their own are shifted last.
    """
    schema = "event_id string, shard_id string, content string, token_count long, is_core boolean, tier int, timestamp string, tags array<string>"

    def make(frames):
        for rows in frames:
            out = []
            for event, shard, content, tags, time in zip(rows["event_id"], rows["shard_id"], rows["content"], rows["tags"], rows["timestamp"], strict=True):
                stream = draws((fnv1a(event) ^ seed) & 0xFFFFFFFF)
                name = re.sub(r"^f\d+-", "", event)
                for k in range(factor):
                    text = mutate(content or "", stream)
                    moved = _moved(time, stream) if time else None
                    out.append((f"f{tier}-{name}-v{k:03d}", shard, text, -(-len(text) // 4), False, tier, moved, tags))
            yield pd.DataFrame(out, columns=["event_id", "shard_id", "content", "token_count", "is_core", "tier", "timestamp", "tags"])

    time = F.col("timestamp").cast("string") if "timestamp" in seeds.columns else F.lit(None).cast("string")
    return seeds.select(F.col("event_id").cast("string").alias("event_id"), "shard_id", "content", "tags", time.alias("timestamp")).mapInPandas(make, schema)


def _moved(time: str, stream: Iterator[float]) -> str:
    """The time some days off, in UTC; what isn't one stays, but draws too."""
    shift = _shift(next(stream))
    try:
        at = dt.datetime.fromisoformat(time)
    except ValueError:
        return time
    at = (at if at.tzinfo else at.replace(tzinfo=dt.UTC)).astimezone(dt.UTC) + shift
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
