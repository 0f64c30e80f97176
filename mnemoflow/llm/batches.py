"""Arrow batches of texts, cut into chunks of bounded size, and byte-level words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one chunk holds; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

#: A-Z to a-z; what no word holds to a blank. Words are runs of
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lowering.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    column = batch.column(text)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Lower-cased words, as WORD_TABLE cuts them."""
    return text.translate(WORD_TABLE).split()


def kept_names(keep: list[str], made: list[str]) -> list[str]:
    """Names for the kept columns: one that a made column has too, in any case, gets ``_kept`` behind it."""
    taken, out = {m.lower() for m in made}, []
    for name in keep:
        while name.lower() in taken:
            name += "_kept"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def beside(docs: DataFrame, keep: list[str], text: str, made: str, start: Callable[[], Callable[[pa.Array], list[pa.Array]]], most: int = CHUNK_BYTES) -> DataFrame:
    """The ``keep`` columns and, beside them, the ``made`` ones (names and types).

    ``start`` is called once a task and gives the function that makes them of the texts of a chunk.
    """
    kinds = T.StructType.fromDDL(made)
    inner = [f"__{k}" for k in range(len(keep))]
    base = docs.select(*[F.col(quoted(n)).alias(i) for n, i in zip(keep, inner, strict=True)], F.col(quoted(text)).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in chunks(batches, "__text", most):
            columns = [batch.column(i) for i in inner] + make(batch.column("__text"))
            yield pa.RecordBatch.from_arrays(columns, names=inner + kinds.names)

    out = base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], *kinds.fields]))
    return out.toDF(*kept_names(keep, kinds.names), *kinds.names)


def arrow(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

#: Bytes of [\x20\x09-\x0D], which part words that are kept unchanged.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: A number for each byte at each of PLACES places, in two independent tables. A word's hash is the sum of those of
#: its bytes; of bytes further on they're mixed with how far, so no two places have numbers that depend on each other.
PLACES = 64
_RANDOM = np.random.Generator(np.random.PCG64(20240101))
_OF_BYTE = _RANDOM.integers(0, 1 << 64, (2, PLACES * 256), dtype=np.uint64)
_FURTHER = np.uint64(0xD1B54A32D192ED03)


#: Bytes that are hashed at a time.
_HASHED = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows, without a copy; a null is empty."""
    n = len(column)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset : column.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts: where each starts and ends in the bytes, its 64-bit hash, its text's number; how many
    each text has. ``check`` is a second hash, independent of the first, if asked for."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    count: np.ndarray
    check: np.ndarray | None = None


def _numbers(data: np.ndarray, place: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The number of each byte at its place in its word."""
    value = table[(place & (PLACES - 1)) << 8 | data]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value[far] = mixed(value[far] + (place[far] // PLACES).astype(np.uint64) * _FURTHER)
    return value


def words_of(column: pa.Array, fold: np.ndarray = SAME, checked: bool = False, blank: np.ndarray = BLANK) -> Words:
    """Runs of bytes that aren't ``blank``; ``fold`` maps each byte before it's hashed. ``checked``: with the second hash."""
    data, offsets = byte_view(column)
    n = len(offsets) - 1
    solid = ~blank[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        none = np.zeros(0, np.uint64)
        return Words(start, end, none, text, np.zeros(n, np.int64), none)
    hashes = np.empty((1 + checked, len(start)), np.uint64)
    at = 0
    while at < len(start):  # a few bytes at a time, which bounds the memory and stays in the cache
        stop = max(at + 1, int(np.searchsorted(start, start[at] + _HASHED)))
        low, high, own = start[at], end[stop - 1], start[at:stop] - start[at]
        place = np.arange(high - low) - np.repeat(own, np.diff(np.append(own, high - low)))
        folded = fold[data[low:high]]
        for row, table in zip(hashes, _OF_BYTE, strict=False):
            value = _numbers(folded, place, table)
            value[~solid[low:high]] = 0
            row[at:stop] = np.add.reduceat(value, own)
        at = stop
    return Words(start, end, mixed(hashes[0]), text, np.bincount(text, minlength=n), mixed(hashes[1]) if checked else None)


def window_hashes(words: Words, size: int, everywhere: bool = False, factor: int = 0x9E3779B97F4A7C15, check: bool = False):
    """Hashes of ``size`` consecutive words of one text, and the number of the word where each starts.

    ``everywhere``: the hashes alone, from every word on, across the ends of texts too. ``check``: of the words' second hash.
    """
    n = len(words.hash) - size + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none if everywhere else (none, np.zeros(0, np.int64))
    out = np.zeros(n, np.uint64)
    own = words.check if check else words.hash
    for k in range(size):
        out = out * np.uint64(factor) + own[k : k + n]
    if everywhere:
        return mixed(out)
    at = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    return mixed(out[at]), at
