"""Personal data by weak supervision.

Candidate spans come from broad patterns. Five labelers vote on each (for,
against, silent): a strict check of the kind's own form, the span's borders, a
gazetteer, cue words before it, and the variety of its characters. The votes
of all documents are counted as patterns; expectation-maximisation over the
counts estimates how reliable each labeler is, without a true label, and gives
each pattern a probability. A logistic classifier of the span's kind, votes,
length and make-up is then fitted to these probabilities, each pattern weighted
by its count. Both passes go over whole texts without moving them; only
patterns and counts are shuffled, a few hundred whatever the input.

Base spans (email, ip, card, phone by their exact rules) always stay; the
classifier adds spans of further kinds and drops those that overlap others.

Defined results: a null text is empty and has no span; repeated rows are
searched each; starts and ends count code points, ends exclusive; columns not
asked for are ignored; a kept column named as a made one comes back with
``_kept`` behind its name. No pattern scans a text more than a fixed number of
times, and a candidate is compared with its neighbours only.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import beside, chunks

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "local_phone", "national_id", "iban", "name")
LABELERS = ("form", "borders", "gazetteer", "context", "variety")
#: The least probability at which a span that isn't a base span is kept.
THRESHOLD = 0.5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"[=:][\x20\x09]{0,2}[\"']?([A-Za-z0-9_./+-]{8,})")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
_NAME = re.compile(r"(?<!\w)(?:" + "|".join(_TITLES) + r")\.?[\x20]([^\W\d_]{2,30}(?:[\x20][^\W\d_]{2,30})?)")
_WORD = re.compile(r"[^\W\d_]+")

_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz co ch at it nl".split())
_CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 359".split())
_CARD_STARTS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "6011", "65", "35", "36", "38", "30")
_SECRET_WORDS = frozenset("password passwd pwd pass token secret apikey key auth credential credentials bearer passwort contraseña clave jeton".split())
_CUES = {
    "email": frozenset("email mail e contact write to correo courriel kontakt contacto".split()),
    "ip": frozenset("ip address host server from addr adresse dirección".split()),
    "card": frozenset("card credit visa mastercard karte carte tarjeta payment".split()),
    "phone": frozenset("phone call tel telephone mobile fax telefon téléphone teléfono".split()),
    "secret": _SECRET_WORDS,
    "local_phone": frozenset("phone call tel telephone mobile fax telefon téléphone teléfono".split()),
    "national_id": frozenset("ssn social security id number".split()),
    "iban": frozenset("iban account konto compte cuenta bank".split()),
    "name": frozenset("dear by with from contact sincerely".split()),
}
#: Countries of account numbers, with the length that each has fixed for its own.
_ACCOUNTS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24, "TR": 26}
#: Numbers that were printed as examples and belong to nobody.
_SPECIMENS = frozenset("078-05-1120 219-09-9999 123-45-6789 457-55-5462".split())
_NAMES = frozenset(
    """adams ali anderson anna becker brown carlos chen clark david davies dubois emma fischer garcia gonzalez green hall hans harris hernandez jackson james jean
    john johnson jones jose juan khan kim laura lee lewis lopez maria marie martin martinez mary meyer michael miller mohamed moore muller müller nguyen patel
    paul perez peter pierre robert robinson rodriguez rossi sanchez sarah schmidt schneider scott singh smith sofia taylor thomas thompson walker wang weber white williams wilson wright young""".split()
)
_AGAINST = frozenset("version release isbn issn page chapter section order invoice sku http https".split())


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern: from each @ the local part is read backwards, so that long runs cost their length once."""
    out, free, at = [], 0, 0
    for m in _DOMAIN.finditer(t):
        p = m.start()
        at = t.rfind("@", free, p) + 1
        low = max(free, at)
        head = t[low:p]
        n = len(head) - len(head.rstrip(_LOCAL))
        if n:
            out.append((p - n, m.end()))
            free = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """The exact spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(t)] if "@" in t else []
    if not _DIGIT.search(t):
        return out
    if t.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x[-4:] if len(x) > 4 else x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in t:
        out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def more_candidates(t: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in t or ":" in t:
        out += [("secret", *m.span(1)) for m in _SECRET.finditer(t)]
    if _DIGIT.search(t):
        out += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(t)]
        if "-" in t:
            out += [("national_id", *m.span()) for m in _NATIONAL.finditer(t)]
        out += [("iban", *m.span()) for m in _IBAN.finditer(t)]
    if any(x in t for x in _TITLES):
        out += [("name", *m.span(1)) for m in _NAME.finditer(t)]
    return out


def _form(kind: str, s: str) -> int:
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "email":
        return 1 if s.rpartition(".")[2].isalpha() else -1
    if kind == "ip":
        return 1 if digits.strip("0") else -1
    if kind == "card":
        return 1 if len(digits) in (14, 15, 16) else -1
    if kind in ("phone", "local_phone"):
        return 1 if 9 <= len(digits) <= 13 else -1
    if kind == "secret":
        return 1 if digits and any(c.isalpha() for c in s) else -1
    if kind == "national_id":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "iban":
        x = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 else -1
    return 1 if s.istitle() else -1


def _gazetteer(kind: str, s: str, before: list[str]) -> int:
    if kind == "email":
        return 1 if s.rpartition(".")[2].lower() in _ENDINGS else 0
    if kind == "card":
        return 1 if s.startswith(_CARD_STARTS) else -1
    if kind == "phone":
        return 1 if s[1:].lstrip("( ").startswith(_CALLING) else -1
    if kind == "ip":
        return -1 if s.startswith(("0.", "127.", "255.")) else 1
    if kind == "secret":
        return 1 if before and before[-1] in _SECRET_WORDS else -1
    if kind == "local_phone":  # codes of areas start at 2 and don't end in 11
        area = s.lstrip("(")[:3]
        return -1 if area[0] in "01" or area[1:] == "11" else 1
    if kind == "national_id":
        return -1 if s in _SPECIMENS else 1
    if kind == "iban":
        return 1 if len(s.replace(" ", "")) == _ACCOUNTS.get(s[:2]) else -1
    return 1 if any(w.lower() in _NAMES for w in s.split()) else 0


def votes(kind: str, t: str, start: int, end: int) -> tuple[int, ...]:
    s = t[start:end]
    before = [w.lower() for w in _WORD.findall(t[max(0, start - 32) : start])][-4:]
    left, right = t[start - 1 : start], t[end : end + 1]
    cues = _CUES[kind] & set(before)
    kinds = len(set(s)) / min(len(s), 16)
    return (
        _form(kind, s),
        -1 if left.isalnum() or right.isalnum() else 1,
        _gazetteer(kind, s, before),
        -1 if _AGAINST & set(before) and not cues else 1 if cues else 0,
        1 if kinds >= 0.4 else -1 if kinds <= 0.2 else 0,
    )


def pattern(kind: str, t: str, start: int, end: int) -> str:
    s = t[start:end]
    share = sum(c in "0123456789" for c in s) * 4 // len(s)
    return "|".join([kind, "".join("-0+"[v + 1] for v in votes(kind, t, start, end)), str(min(len(s).bit_length(), 7)), str(share)])


@dataclass
class SpanClassifier:
    """Probability of each pattern, by the weights of its features."""

    weights: dict[str, float] = field(default_factory=dict)
    #: Of each labeler: the chance of each vote given that a span is personal, and that it isn't.
    reliability: dict[str, dict[str, list[float]]] = field(default_factory=dict)

    def probability(self, p: str) -> float:
        z = sum(self.weights.get(f, 0.0) for f in features(p))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(p: str) -> list[str]:
    kind, v, size, share = p.split("|")
    return ["bias", f"kind={kind}", f"size={size}", f"digits={share}", *(f"{name}={x}" for name, x in zip(LABELERS, v, strict=True)), *(f"{kind}:{name}={x}" for name, x in zip(LABELERS[:3], v, strict=False))]


def estimate(counts: dict[str, int], rounds: int = 50) -> SpanClassifier:
    """EM for the labelers' reliabilities, then the classifier, both over pattern counts."""
    if not counts:
        return SpanClassifier({"bias": -5.0})
    names = sorted(counts)
    n = np.array([counts[p] for p in names], float)
    v = np.array([["-0+".index(c) for c in p.split("|")[1]] for p in names])
    kinds = [p.split("|")[0] for p in names]
    kind = np.array([KINDS.index(k) for k in kinds])
    # the first guess is the vote; a kind's prior is its own
    q = 1 / (1 + np.exp(-1.2 * (v - 1).sum(1)))
    for _ in range(rounds):
        table = np.ones((2, len(LABELERS), 3)) * 0.5
        for y, w in ((1, n * q), (0, n * (1 - q))):
            for j in range(len(LABELERS)):
                table[y, j] += np.bincount(v[:, j], w, 3)
        # a labeler is taken to be better than chance: a vote for never tells against
        table /= table.sum(2, keepdims=True)
        for j in range(len(LABELERS)):
            if table[1, j, 2] < table[0, j, 2]:
                table[:, j] = table[:, j].mean(0)
        prior = np.array([(1 + (n * q)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        z = np.log(prior[kind] / (1 - prior[kind])) + sum(np.log(table[1, j, v[:, j]] / table[0, j, v[:, j]]) for j in range(len(LABELERS)))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    columns = {f: k for k, f in enumerate(sorted({f for p in names for f in features(p)}))}
    x = np.zeros((len(names), len(columns)))
    for i, p in enumerate(names):
        x[i, [columns[f] for f in features(p)]] = 1
    w, share = np.zeros(len(columns)), np.maximum(n / n.sum(), 1e-6)
    for _ in range(30):  # Newton's steps for the weighted, ridged logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (share * (q - p)) - 1e-4 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return SpanClassifier({f: float(w[k]) for f, k in columns.items()}, {name: {"personal": table[1, j].tolist(), "other": table[0, j].tolist()} for j, name in enumerate(LABELERS)})


def fit(docs: DataFrame, text: str = "text") -> SpanClassifier:
    """Counts the vote patterns of all documents and estimates the classifier."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in chunks(batches):
            for t in batch.column("text").to_pylist():
                if t:
                    total.update(pattern(k, t, a, b) for k, a, b in base_spans(t) + more_candidates(t))
        yield pa.RecordBatch.from_pydict({"p": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect()
    return estimate({r.p: r.n for r in rows})


def all_spans(t: str, accepted: dict[str, bool], classifier: SpanClassifier) -> tuple[list, list]:
    """Base spans, and those with the accepted others, by kind as listed, then start."""
    base = base_spans(t)
    starts: list[int] = []  # of what is taken, apart from each other, by place
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for kind, a, b in more_candidates(t):
        p = pattern(kind, t, a, b)
        if p not in accepted:
            accepted[p] = classifier.probability(p) >= THRESHOLD
        if not accepted[p]:
            continue
        at = bisect_left(starts, b)  # those before it start before the end of this one
        if at and ends[at - 1] > a:
            continue
        added.append((kind, a, b))
        starts.insert(at, a)
        ends.insert(at, b)
    return base, base + sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, classifier: SpanClassifier, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``base`` and ``spans``, arrays of (kind, start, end), and ``masked``, the
    text with each span replaced by its kind in brackets."""
    span = "array<struct<kind:string,start:int,`end`:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        accepted: dict[str, bool] = {}
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

        def make(texts: pa.Array) -> list[pa.Array]:
            exact, full, masked = [], [], []
            for t in texts.to_pylist():
                x, y = all_spans(t or "", accepted, classifier)
                exact.append(as_rows(x))
                full.append(as_rows(y))
                masked.append(mask(t, y))
            return [pa.array(exact, kind), pa.array(full, kind), pa.array(masked, pa.string())]

        return make

    return beside(docs, keep, text, f"base {span}, spans {span}, masked string", start)


def mask(t: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    if not t or not spans:
        return t
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [t[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + t[at:]
