"""Order-dependent operators: small ordered lists, folded group by group."""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def draws(seed: int):
    """The seeded stream of numbers in [0, 1)."""
    # The generator's constants.
    state = seed & _MASK
    while True:
        state = (state + 0x6D2B79F5) & _MASK
        t = ((state ^ (state >> 15)) * (state | 1)) & _MASK
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & _MASK)) & _MASK
        yield (t ^ (t >> 14)) / 4294967296


def shuffled(items: list, seed: int) -> list:
    """Fisher-Yates from the end, by the seeded stream."""
    out, stream = list(items), draws(seed)
    for last in range(len(out) - 1, 0, -1):
        other = int(next(stream) * (last + 1))
        out[last], out[other] = out[other], out[last]
    return out


def sample_corpus(corpus: DataFrame, seed: int, targets: list[int], full: float = 0.999) -> DataFrame:
    """(target, event_id, ordinal): all core events, then fillers in shuffled order, each skipped if it would overflow.

    Filling is sequential, so the ids and sizes of one target are one group; texts stay out of it.
    """
    sizes = corpus.select("event_id", "token_count", "is_core")
    grid = sizes.withColumn("target", F.explode(F.array(*map(F.lit, targets)).cast("array<bigint>")))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        target = int(rows["target"].iloc[0])
        rows = rows.sort_values("event_id")
        core, filler = rows[rows["is_core"]], rows[~rows["is_core"]]
        used = int(core["token_count"].sum())
        kept = core["event_id"].tolist()
        if used > target:
            return pd.DataFrame({"target": [target], "event_id": [None], "ordinal": [-1]})
        for event, size in shuffled(list(zip(filler["event_id"], filler["token_count"], strict=True)), seed):
            if used >= full * target:
                break
            if used + size <= target:
                kept.append(event)
                used += size
        return pd.DataFrame({"target": target, "event_id": kept, "ordinal": range(len(kept))})

    return grid.groupBy("target").applyInPandas(fill, "target long, event_id long, ordinal int")


def shuffled_order(events: DataFrame, seed: int, key: str = "shard_id") -> DataFrame:
    """(key, event_id, ordinal): each group's events in the exact seeded order."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        ids = shuffled(sorted(rows["event_id"].tolist()), seed)
        return pd.DataFrame({key: rows[key].iloc[0], "event_id": ids, "ordinal": range(len(ids))})

    return events.select(key, "event_id").groupBy(key).applyInPandas(order, f"{key} string, event_id long, ordinal int")


def expand(base: list, groups: list[tuple], most: int, per_group: int) -> list:
    """``groups``: (anchor, ranked ids). New ids go behind the anchor's last place; a later group on the
    same anchor lands before earlier insertions."""
    if most <= len(base) or per_group <= 0:
        return list(base)
    out, seen = list(base), set(base)
    for anchor, ranked in groups:
        if len(out) >= most:
            break
        if anchor not in seen:
            continue
        at = len(out) - out[::-1].index(anchor)
        room = min(per_group, most - len(out))
        fresh = []
        for x in ranked:
            if len(fresh) == room:
                break
            if x not in seen:
                seen.add(x)
                fresh.append(x)
        out[at:at] = fresh
    return out


def expand_shards(base: DataFrame, groups: DataFrame, most: int, per_group: int) -> DataFrame:
    """(query_id, event_id, place). ``base``: (query_id, event_id, rank); ``groups``: (query_id, anchor, anchor_rank, event_id, rank). Lists are as short as a query's ranks."""
    lists = base.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id"))).alias("base"))
    per = groups.groupBy("query_id", "anchor", "anchor_rank").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id"))).alias("ids"))
    per = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("anchor_rank", "anchor", "ids"))).alias("groups"))

    def fold(frames):
        for rows in frames:
            out = []
            for q, b, g in zip(rows["query_id"], rows["base"], rows["groups"], strict=True):
                order = expand([x["event_id"] for x in b], [(x["anchor"], [y["event_id"] for y in x["ids"]]) for x in (g if g is not None else [])], most, per_group)
                out += [(q, e, i) for i, e in enumerate(order)]
            yield pd.DataFrame(out, columns=["query_id", "event_id", "place"])

    return lists.join(per, "query_id", "left").mapInPandas(fold, "query_id long, event_id long, place int")


def merge_claims(claims: list[tuple[str, list[str], float]]) -> list[tuple[str, list[str], float]]:
    """A claim joins the first bucket whose claim contains it or is contained in it; sources unite, the larger confidence stays."""
    buckets: list[list] = []
    for claim, sources, confidence in claims:
        low = claim.strip().lower()
        home = next((b for b in buckets if low in b[0].lower() or b[0].lower() in low), None)
        if home is None:
            buckets.append([claim.strip(), list(dict.fromkeys(sources)), confidence])
        else:
            home[1] = list(dict.fromkeys([*home[1], *sources]))
            home[2] = max(home[2], confidence)
    return [tuple(b) for b in sorted(buckets, key=lambda b: -b[2])]


def synthesize(recalls: DataFrame, as_json: bool = False) -> DataFrame:
    """(query_id, summary, key_claims, n_claims, context). ``recalls``: (query_id, place, source, answer, confidence, claims);
    a query has a handful of recalls. ``as_json``: key claims as an array in JSON, confidences to two decimals."""
    schema = "query_id long, summary string, key_claims string, n_claims int, context string"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        claims = [(c["claim"], list(c["support"]), c["confidence"]) for cs in rows["claims"] for c in cs]
        merged = merge_claims(claims)
        summary = "\n".join(f"- {c}" for c, _, _ in merged[:3]) or "Recalls returned no concrete claims."
        best = rows.sort_values("confidence", ascending=False, kind="stable").head(2)
        context = "\n\n".join(f"{s}: {a}" for s, a in zip(best["source"], best["answer"], strict=True))
        text = "\n".join(f"{c} <- {','.join(s)}" for c, s, _ in merged)
        if as_json:
            text = json.dumps([{"claim": c, "sources": s, "confidence": int(x * 100 + 0.5) / 100} for c, s, x in merged], ensure_ascii=False)
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "summary": [summary], "key_claims": [text], "n_claims": [len(merged)], "context": [context]})

    return recalls.groupBy("query_id").applyInPandas(fold, schema)


def fnv1a(text: str) -> int:
    """The 32-bit hash of the characters' codes."""
    h = 0x811C9DC5
    for c in text:
        h = ((h ^ ord(c)) * 0x01000193) & _MASK
    return h


def fnv1a_column(text: Column) -> Column:
    """The same hash in the JVM, character by character."""
    from ..functions.maths import mul32

    step = lambda h, c: mul32(h.bitwiseXOR(F.ascii(c).cast("long")), F.lit(0x01000193).cast("long"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("long"), step)
