"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from mnemoflow.llm import catalog, conversations

BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        out[conv]  # noqa: B018
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The best (cost, audit) by a search that tries every edit, with the repaired turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in step[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*made, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in step[state]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], (*made, f"{new}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


RESULT = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def found(df):
    return {r.conv_id: tuple(r[c] for c in RESULT) for r in df.collect()}


def test_query_equals_the_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(catalog.QUERIES["op12_conversations"](spark, sf)) == {c: plain_repair(x) for c, x in plain_damage(rows).items()}


def test_any_rows_in_any_partitions(spark, monkeypatch):
    """Nulls, odd roles, blanks, repeats, ties and long conversations, cut into small blocks."""
    rng = random.Random(3)
    texts = ["Yes.", "no", "  ", "Ends!  ", "", None, "a b", "So?\n"]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.choice([0, 1, 2, 5, 9, 60])):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", None, "", "assistant", "user"]), rng.choice([*texts, f"t{rng.random()}."]), "more"))
    rows += [(99, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.", "x") for k in range(500)] + [(98, 3, "user", "same.", "x")] * 7
    rows = list(dict.fromkeys(rows)) + [r for r in rows if r[0] in (98, 5)]
    by_turn = defaultdict(set)  # ties are ordered by a hash: the plain version sees one row a turn, repeats apart
    for conv, turn, role, text, _ in rows:
        by_turn[conv, turn].add((role, text))
    rows = [r for r in rows if (r[2], r[3]) == min(by_turn[r[0], r[1]], key=str)]
    kind = "conv_id long, turn int, role string, text string, fault string"
    expected = {c: plain_repair(x) for c, x in plain_damage([r[:4] for r in rows]).items()}
    for parts, block in ((1, 16384), (7, 16384), (13, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            monkeypatch.setattr(conversations, "BLOCK", block)
            got = found(conversations.repair(conversations.damaged(spark.createDataFrame(rows, kind))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert got == expected
    assert found(conversations.repair(conversations.damaged(spark.createDataFrame([], kind)))) == {}


def test_costs_of_a_block_join_up():
    rng = random.Random(5)
    for _ in range(200):
        kinds = bytes(rng.randrange(10) for _ in range(rng.randrange(12)))
        cut = rng.randrange(len(kinds) + 1)
        whole = conversations.to_go(conversations.costs_of(kinds), conversations.END)
        assert whole == conversations.to_go(conversations.costs_of(kinds[:cut]), conversations.to_go(conversations.costs_of(kinds[cut:]), conversations.END))
