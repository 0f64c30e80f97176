"""Sorted fingerprints in few bytes, and their exchange by ranges of the hash.

Texts are taken in segments. A segment sorts its fingerprints and cuts them
by their top bits into ranges; a row per range holds the fingerprints as
differences, byte plane by byte plane, compressed, beside what they point to.
A range then meets in one task. As hashes are spread evenly, ranges are
even whatever the texts; how often a fingerprint repeats within a segment
doesn't matter, since a segment sends it once or with all its places packed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the texts of a segment, at least; a longer text is a segment of its own.
SEGMENT_WORDS = 1 << 20
#: Bytes of text whose fingerprints meet in one range, at least.
RANGE_BYTES = 6 << 20
#: Fingerprints that a segment has in each range, at least, at about.
ROW = 256


def packed(x: np.ndarray) -> bytes:
    """Whole numbers that compress well when they're small: planes of bytes, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    planes = x.view(np.uint8).reshape(-1, 8).T
    used = 8 if not len(x) else max(1, (int(x.max()).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(planes[:used]).tobytes()
    return len(x).to_bytes(8, "little") + bytes([used]) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(b: bytes) -> np.ndarray:
    n, used = int.from_bytes(b[:8], "little"), b[8]
    planes = np.zeros((8, n), np.uint8)
    if n:
        planes[:used] = np.frombuffer(pa.decompress(b[9:], n * used, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


@dataclass(frozen=True)
class Layout:
    """How an exchange is cut. Segments and ranges both grow with the root of the text, so that a
    row holds ROW fingerprints at least: at 100 TB, some 300,000 ranges of 370 MB and segments of
    70 million words. A collision of fingerprints of ``bits`` only costs time."""

    ranges: int
    segment_words: int
    bits: int

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - self.bits)


def layout_for(docs: DataFrame, text: str = "text", growth: int = 1) -> Layout:
    """For ``growth`` times the text of ``docs``."""
    total = growth * (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    ranges = 1 << max(7, (total // max(RANGE_BYTES, isqrt(1365 * total))).bit_length())
    return Layout(ranges, max(SEGMENT_WORDS, ROW * ranges), min(64, max(40, total.bit_length() + 16)))


#: Bits of a map for each thing in it, and the least and most that a map has (8 and 64 MB, the bound of its broadcast).
MAP_SHARE, LEAST_MAP, MOST_MAP = 64, 1 << 26, 1 << 29


def map_bits(things: int) -> int:
    """Bits, a power of two, of a map that few others pass for; past MOST_MAP more do, which an exact join removes."""
    return min(MOST_MAP, max(LEAST_MAP, 1 << (MAP_SHARE * things).bit_length()))


def split(sorted_keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The slice of each range that has keys; keys have 64 bits."""
    bits = ranges.bit_length() - 1
    edges = np.searchsorted(sorted_keys >> np.uint64(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(edges)):
        yield int(r), slice(int(edges[r]), int(edges[r + 1]))


def home(seg: int, ranges: int) -> int:
    """The range with which a segment's table of documents goes; those of all segments are spread evenly."""
    return ((seg >> 32) * 0x9E3779B1 + (seg & 0xFFFFFFFF)) % ranges


class SegmentNumber:
    """Numbers that no other task gives and a task that runs again gives again."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 32

    def __call__(self) -> int:
        self.next += 1
        return self.next
