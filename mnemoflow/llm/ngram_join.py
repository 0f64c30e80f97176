"""N-gram Jaccard join by prefix trees.

1. Every text's set of word n-grams is hashed. A text whose set holds too many
   n-grams that no other text has can't meet the threshold: of n, at least
   ``need`` percent would have to be shared. Which n-grams are unique is told by
   an exchange of short fingerprints; a collision only keeps a text longer.
2. Texts with equal sets form a class; its smallest id stands for it. The sets
   of the classes left are counted exactly, by an exchange of 64-bit hashes.
   By ascending count each set has a prefix of which linked sets share one
   n-gram at least; chains of shared prefix n-grams make blocks.
3. A block's sets go into a prefix tree in one global order, the most frequent
   n-gram first, so that near copies share long paths. The tree is walked once
   for all sets of the block: the overlap of each with the path so far is
   counted once per node; a set leaves a subtree when the overlap plus the
   longest remainder can't reach the threshold. A block of over CHUNK sets is
   cut into chunks and each pair of chunks walked, so that a task stays bounded.
   A walk returns a spanning forest and link counts, never pairs of all.
4. Components come from propagating the smallest id over the forest.

A bit map of the ids left, of bounded size, lets the second reading of the
texts skip most others; what it lets through in error is removed by an exact
join.

Defined results: a null text, or one without words, has an empty set and links
with nothing; one of fewer than n words has its whole sequence as its only
member; equal sets link; repeated rows are copies. A null id is larger than any
other: a component of rows without an id has a null one. Rows that share an id
but not their set are judged each. Columns not asked for are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import LOWER, chunks, mixed, window_hashes, words_of
from .fingerprints import Layout, SegmentNumber, home, layout_for, map_bits, packed, packed_sorted, split, unpacked, unpacked_sorted
from .scratch import stored

#: Sets of a block that one walk takes.
CHUNK = 2048
#: Tasks, at least, that the nodes of one hub are dealt to.
SALTS = 8
#: The number that stands for a null id; a row with this id of its own is told apart by ``given``.
LAST = np.iinfo(np.int64).max
_CHUNK_BYTES = 1 << 20
_EXCHANGE = "`range` int, seg bigint, keys binary, refs binary, meta binary"


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = words_of(column, LOWER)
    hashes, at = window_hashes(words, size)
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    starts = np.cumsum(words.count) - words.count
    whole = []
    for t in few:  # fewer words than the n-gram's: one member, hashed with its length
        h = np.full(1, words.count[t], np.uint64)
        for k in range(words.count[t]):
            h = mixed(h * np.uint64(31) + words.hash[starts[t] + k])
        whole.append(h)
    of = words.text[at]
    ends = np.cumsum(np.bincount(of, minlength=len(words.count)))
    out = [np.unique(hashes[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(ends) else []
    for t, h in zip(few, whole, strict=True):
        out[t] = h
    return out


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _segments(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple[list[tuple[int, int, bool]], list[np.ndarray]]]:
    ids: list[tuple[int, int, bool]] = []
    sets: list[np.ndarray] = []
    held = 0
    for batch in chunks(batches, most=_CHUNK_BYTES):
        keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "given")), strict=True)
        for key, own in zip(keys, sets_of(batch.column("text"), size), strict=True):
            if ids and held + len(own) > most:
                yield ids, sets
                ids, sets, held = [], [], 0
            ids.append(key)
            sets.append(own)
            held += len(own)
    if ids:
        yield ids, sets


_META = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("given", pa.bool_()), ("n", pa.int64()), ("digest", pa.binary())])


def _meta(ids: list[tuple[int, int, bool]], sets: list[np.ndarray]) -> tuple[bytes, list[bytes]]:
    digests = [digest(s) for s in sets]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in ids], _META.field(k).type) for k in (0, 1, 2)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())], schema=_META)
    with pa.ipc.new_stream(sink, _META) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes(), digests


def _read_meta(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _exchanged(keys: np.ndarray, refs: np.ndarray, seg: int, meta: bytes, ranges: int, shift: np.uint64) -> pa.RecordBatch:
    """A segment's rows; ``keys`` sorted. The meta goes with the segment's home."""
    at_home = home(seg, ranges)
    rows: list[tuple] = []
    for r, at in split(keys, ranges):
        rows.append((r, seg, packed_sorted(keys[at] >> shift), packed(refs[at]), meta if r == at_home else None))
    if all(r[0] != at_home for r in rows):
        rows.append((at_home, seg, packed(np.zeros(0, np.uint64)), packed(np.zeros(0, np.uint64)), meta))
    kinds = [("range", pa.int32()), ("seg", pa.int64()), ("keys", pa.binary()), ("refs", pa.binary()), ("meta", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _gathered(table: pa.Table) -> tuple[list[int], list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    """Segments and their metas; all keys, with their segment's place and what they refer to."""
    keys = [unpacked_sorted(x.as_py()) for x in table["keys"]]
    refs = [unpacked(x.as_py()) for x in table["refs"]]
    of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return table["seg"].to_pylist(), table["meta"].to_pylist(), np.concatenate(keys), of, np.concatenate(refs).astype(np.int64)


def _survey(docs: DataFrame, size: int, layout: Layout) -> DataFrame:
    """Per document: doc_id, text_hash, given, n, digest and ``alone``, how many of its n-grams no other set has, at least."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = SegmentNumber()
        for ids, sets in _segments(batches, size, layout.segment_words):
            meta, digests = _meta(ids, sets)
            first: dict[bytes, int] = {}
            lead = np.array([first.setdefault(d, i) for i, d in enumerate(digests)])
            own = [i for i in range(len(sets)) if lead[i] == i]
            keys = np.concatenate([sets[i] for i in own])
            refs = np.repeat(np.array(own), [len(sets[i]) for i in own])
            order = np.argsort(keys)
            keys, refs = keys[order], refs[order] + 1
            first_of = np.ones(len(keys), bool)
            first_of[1:] = keys[1:] != keys[:-1]
            last_of = np.ones(len(keys), bool)
            last_of[:-1] = first_of[1:]
            refs[~(first_of & last_of)] = 0  # more than one set of this segment has it
            yield _exchanged(keys[first_of], refs[first_of], number(), meta, layout.ranges, layout.shift)

    def count(table: pa.Table) -> pa.Table:
        segs, metas, keys, of, refs = _gathered(table)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lone = np.ones(len(keys), bool)
        lone[1:] &= keys[1:] != keys[:-1]
        lone[:-1] &= keys[1:] != keys[:-1]
        at = order[lone]
        at = at[refs[at] > 0]
        out = [packed(np.bincount(refs[at[of[at] == i]] - 1)) for i in range(len(segs))]
        return pa.table({"seg": pa.array(segs, pa.int64()), "alone": pa.array(out, pa.binary()), "meta": pa.array(metas, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        meta = _read_meta(next(x for x in table["meta"].to_pylist() if x is not None))
        total = np.zeros(meta.num_rows, np.int64)
        for x in table["alone"]:
            part = unpacked(x.as_py()).astype(np.int64)
            total[: len(part)] += part
        first: dict[bytes, int] = {}
        lead = np.array([first.setdefault(d, i) for i, d in enumerate(meta["digest"].to_pylist())])
        return meta.append_column("alone", pa.array(total[lead]))

    sent = docs.mapInArrow(send, _EXCHANGE)
    counted = sent.groupBy("range").applyInArrow(count, "seg bigint, alone binary, meta binary")
    return counted.groupBy("seg").applyInArrow(add, "doc_id bigint, text_hash bigint, given boolean, n bigint, digest binary, alone bigint")


def _id_map(ids: DataFrame, size: int) -> np.ndarray:
    """A bit map of the hashed ids."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    words = ids.select(F.floor(h / 64).cast("int").alias("w"), F.pmod(h, F.lit(64)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def _sets_left(docs: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """(rep, digest, n, members) of the classes in ``left``, from a second reading."""
    many = map_bits(left.count())
    bits = docs.sparkSession.sparkContext.broadcast(_id_map(left.select(F.col("rep").alias("doc_id")), many))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).astype(np.uint64)
            keep = (bits.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)
            for part in chunks([batch.filter(pa.array(keep.astype(bool)))], most=_CHUNK_BYTES):
                sets = sets_of(part.column("text"), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([packed_sorted(s) for s in sets], pa.binary())],
                    names=["rep", "digest", "members"],
                )

    h = F.pmod(F.xxhash64("doc_id"), F.lit(many)).alias("h")
    found = docs.select("doc_id", "text", h).mapInArrow(read, "rep bigint, digest binary, members binary")
    return found.join(left.select("rep", "digest", "n"), ["rep", "digest"]).dropDuplicates(["digest"])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(sets: DataFrame, percent: int, layout: Layout) -> DataFrame:
    """(digest, rep, token) of each prefix n-gram that at least two of the sets have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = SegmentNumber()
        ids: list[int] = []
        digests: list[bytes] = []
        members: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(m) for m in members], pa.int64()), "digest": pa.array(digests, pa.binary())})
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            keys = np.concatenate(members)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(first)
            times = np.diff(np.append(starts, len(keys)))
            # an n-gram that several sets of the segment have is sent once; its other places share the answer
            leaders = np.repeat(order[starts], times)[~first]
            meta = sink.getvalue().to_pybytes()
            parts = [meta, packed(order[~first]), packed(leaders)]
            refs = order[starts] | times << 32
            return _exchanged(keys[first], refs, number(), b"".join(len(x).to_bytes(8, "little") + x for x in parts), layout.ranges, np.uint64(0))

        for batch in batches:
            for rep, d, m in zip(batch.column("rep").to_pylist(), batch.column("digest").to_pylist(), batch.column("members").to_pylist(), strict=True):
                ids.append(rep)
                digests.append(d)
                members.append(unpacked_sorted(m))
                held += len(members[-1])
                if held > layout.segment_words:
                    yield segment()
                    ids, digests, members, held = [], [], [], 0
        if ids:
            yield segment()

    def count(table: pa.Table) -> pa.Table:
        segs, metas, keys, of, refs = _gathered(table)
        _, back = np.unique(keys, return_inverse=True)
        df = np.bincount(back, refs >> 32).astype(np.int64)[back]
        refs = refs & 0xFFFFFFFF
        shared = df > 1
        out = {"seg": [], "keys": [], "refs": [], "df": [], "meta": []}
        for i, seg in enumerate(segs):
            at = np.flatnonzero(shared & (of == i))
            for name, v in (("seg", seg), ("keys", packed_sorted(keys[at])), ("refs", packed(refs[at])), ("df", packed(df[at])), ("meta", metas[i])):
                out[name].append(v)
        return pa.table({"seg": pa.array(out["seg"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("keys", "refs", "df", "meta")}})

    def cut(table: pa.Table) -> pa.Table:
        raw, parts = next(x for x in table["meta"].to_pylist() if x is not None), []
        while raw:
            size = int.from_bytes(raw[:8], "little")
            parts.append(raw[8 : 8 + size])
            raw = raw[8 + size :]
        meta, followers, leaders = _read_meta(parts[0]), unpacked(parts[1]).astype(np.int64), unpacked(parts[2]).astype(np.int64)
        keys = np.concatenate([unpacked_sorted(x.as_py()) for x in table["keys"]])
        places = np.concatenate([unpacked(x.as_py()) for x in table["refs"]]).astype(np.int64)
        df = np.concatenate([unpacked(x.as_py()) for x in table["df"]]).astype(np.int64)
        by_place = np.argsort(places)
        like = by_place[np.searchsorted(places, leaders, sorter=by_place)] if len(leaders) else leaders
        keys, df, places = np.concatenate([keys, keys[like]]), np.concatenate([df, df[like]]), np.concatenate([places, followers])
        n = meta["n"].to_numpy()
        refs = np.searchsorted(np.cumsum(n), places, side="right")
        order = np.lexsort((keys, df, refs))
        keys, refs = keys[order], refs[order]
        shared = np.bincount(refs, minlength=len(n))
        place = np.arange(len(refs)) - np.repeat(np.cumsum(shared) - shared, shared)
        room = np.array([prefix_length(int(x), percent) for x in n]) - (n - shared)  # what n-grams of its own leave
        at = np.flatnonzero(place < room[refs])
        return pa.table({"digest": meta["digest"].take(pa.array(refs[at])), "rep": meta["doc_id"].take(pa.array(refs[at])), "token": pa.array(keys[at].view(np.int64))})

    sent = sets.select("rep", "digest", "members").mapInArrow(send, _EXCHANGE)
    counted = sent.groupBy("range").applyInArrow(count, "seg bigint, keys binary, refs binary, df binary, meta binary")
    return counted.groupBy("seg").applyInArrow(cut, "digest binary, rep bigint, token bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest label that each node reaches. ``edges``: (node, hub, label); a node and a hub are linked.

    Labels go from nodes to hubs and back until none changes; each round is a written table.
    """
    # a hub of many nodes is dealt to several tasks: its nodes by a salt, its label to each
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    edges = stored(edges.withColumn("salt", salt), f"{name}-edges")
    labels = stored(edges.groupBy("node").agg(F.min("label").alias("label")), f"{name}-labels")
    while True:
        hubs = edges.select("node", "hub").join(labels, "node").groupBy("hub").agg(F.min("label").alias("label"))
        hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        new = edges.select("node", "hub", "salt").join(hubs, ["hub", "salt"]).groupBy("node").agg(F.min("label").alias("new"))
        new = stored(labels.join(new, "node").select("node", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), f"{name}-labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


class PrefixTree:
    """Ordered sets as paths; a node holds the run of members up to the next branch."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        """``sets``: members as places in the global order, ascending."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sets = sets
        #: (members of the run, depth before it, sets that end here, children, least and largest size below)
        self.root = self._node(order, 0)

    def _node(self, own: list[int], depth: int) -> tuple:
        work = [(own, depth, None)]
        root = None
        while work:
            own, depth, parent = work.pop()
            a, b = self.sets[own[0]], self.sets[own[-1]]
            k = min(len(a), len(b)) - depth  # in sorted order, the first and the last set share what all share
            differ = np.flatnonzero(a[depth : depth + k] != b[depth : depth + k])
            stop = depth + (int(differ[0]) if len(differ) else k)
            ended = [i for i in own if len(self.sets[i]) == stop]
            rest = [i for i in own if len(self.sets[i]) > stop]
            sizes = [len(self.sets[i]) for i in own]
            node = (a[depth:stop], depth, ended, [], min(sizes), max(sizes))
            if parent is None:
                root = node
            else:
                parent[3].append(node)
            at = 0
            while at < len(rest):
                end = at
                while end < len(rest) and self.sets[rest[end]][stop] == self.sets[rest[at]][stop]:
                    end += 1
                work.append((rest[at:end], stop, node))
                at = end
        return root

    def walk(self, probes: list[np.ndarray], members: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each set of the tree with the probes that meet the threshold with it."""
        sizes = np.array([len(p) for p in probes])
        flat = np.concatenate(probes)
        who = np.repeat(np.arange(len(probes)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        edges = np.searchsorted(flat, np.arange(members + 1))
        work = [(self.root, np.zeros(len(probes), np.int64), np.arange(len(probes)))]
        while work:
            (run, depth, ended, children, low, high), overlap, active = work.pop()
            if len(run):
                got = np.concatenate([who[edges[m] : edges[m + 1]] for m in run])
                overlap = overlap + np.bincount(got, minlength=len(probes))
            done = depth + len(run)
            last = int(run[-1]) if len(run) else -1
            if ended:
                b = len(self.sets[ended[0]])
                hit = active[100 * overlap[active] >= percent * (sizes[active] + b - overlap[active])]
                for i in ended:
                    yield i, hit
            if children:
                mine = np.array([len(p) - np.searchsorted(p, last, side="right") for p in (probes[i] for i in active)])
                most = overlap[active] + np.minimum(mine, high - done)
                # a set below that holds ``most`` has as many members at least
                ok = (100 + percent) * most >= percent * (sizes[active] + np.maximum(low, most))
                active = active[ok]
                if len(active):
                    work += [(c, overlap, active) for c in children]


def _join_block(table: pa.Table, percent: int) -> pa.Table:
    """One walk: (node, hub, label, links) of each set; ``hub`` is the digest of its tree's root in the forest."""
    sets = [unpacked_sorted(x.as_py()) for x in table["members"]]
    digests, reps, side = table["digest"].to_pylist(), table["rep"].to_numpy(), table["side"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    universe, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(universe), np.int64)
    place[np.lexsort((universe, -n))] = np.arange(len(universe))
    ends = np.cumsum([len(s) for s in sets])
    ordered = [np.sort(x) for x in np.split(place[back], ends[:-1])]
    left = np.flatnonzero(side == i)
    right = np.flatnonzero(side == j)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = np.zeros(len(sets), np.int64)
    if len(left) and len(right):
        tree = PrefixTree([ordered[x] for x in right])
        for at, hit in tree.walk([ordered[x] for x in left], len(universe), percent):
            a, others = int(right[at]), left[hit]
            others = others[others != a]
            links[a] += len(others)
            if i != j:
                links[others] += 1
            for b in others:
                x, y = find(a), find(int(b))
                if x != y:
                    if (reps[y], y) < (reps[x], x):
                        x, y = y, x
                    root[y] = x
    hubs = [digests[find(x)] for x in range(len(sets))]
    return pa.table({"node": pa.array(digests, pa.binary()), "hub": pa.array(hubs, pa.binary()), "label": pa.array(reps), "links": pa.array(links)})


def _with_names(of_class: DataFrame) -> DataFrame:
    """The classes with ``named``: whether a row of their component has an id of its own, which counts if the component's is LAST."""
    last = of_class.where(F.col("component_id") == int(LAST))
    if not last.where("given").limit(1).count():
        return of_class.withColumn("named", F.lit(False))
    key = F.coalesce("leader", "digest").alias("at")
    named = last.groupBy(key).agg(F.bool_or("given").alias("named"))
    return of_class.withColumn("at", key).join(named, "at", "left").withColumn("named", F.coalesce("named", F.lit(False))).drop("at")


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: n_shingles, component_id and ``n_links``, the links of its class to other classes;
    ``text_hash``, which tells rows that share an id apart, ``set_digest``, the class, and ``leads``, whether
    the row has the id and the set that stand for its component.

    Two sets link when 100 * intersection >= percent * union.
    """
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST))).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), F.col(doc_id).isNotNull().alias("given"), F.col(text).alias("text"))
    layout = layout_for(base)
    surveyed = stored(_survey(base, size, layout), "survey")
    full = surveyed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("alone").alias("alone"), F.bool_or("given").alias("given"))
    classes = stored(full, "classes")
    left = classes.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    sets = stored(_sets_left(base, left, size), "sets")
    prefixes = _prefixes(sets, percent, layout)
    blocks = components(prefixes.select(F.col("digest").alias("node"), F.col("token").alias("hub"), F.col("rep").alias("label")), "blocks")
    sizes = blocks.groupBy("label").agg(F.count("*").alias("many")).where("many > 1")
    parts = F.ceil(F.col("many") / chunk).cast("int")
    dealt = blocks.join(sizes, "label").select("node", F.col("label").alias("block"), parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("side"))
    paired = (
        sets.join(dealt, sets.digest == dealt.node)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("block", "rep", "digest", "members", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    )
    found = stored(paired.groupBy("block", "i", "j").applyInArrow(lambda t: _join_block(t, percent), "node binary, hub binary, label bigint, links bigint"), "links")
    # classes that share their smallest id are told apart by their digests too
    alike = bool(left.groupBy("rep").count().where("count > 1").limit(1).count())
    joined = components(found.select("node", "hub", F.struct("label", "node").alias("label") if alike else "label"), "components")
    leader = [F.col("label.label").alias("component"), F.col("label.node").alias("leader")] if alike else [F.col("label").alias("component"), F.lit(None).cast("binary").alias("leader")]
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = stored(joined.join(counts, "node").select(F.col("node").alias("digest"), *leader, "n_links"), "linked")
    leads = F.when(F.col("component").isNull(), True).when(F.col("leader").isNotNull(), F.col("leader") == F.col("digest")).otherwise(F.col("component") == F.col("rep"))
    of_class = classes.join(linked, "digest", "left").select("digest", "rep", "given", "leader", leads.alias("class_leads"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_class = _with_names(stored(of_class, "of-class"))
    some, none = surveyed.where("n > 0"), surveyed.where("n = 0")
    out = some.join(of_class.drop("given"), "digest").select("doc_id", "n", "component_id", "n_links", "text_hash", "digest", "given", "named", (F.col("class_leads") & (F.col("doc_id") == F.col("rep"))).alias("leads"))
    alone = none.select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", "digest", "given", F.col("given").alias("named"), F.lit(True).alias("leads"))
    own = lambda c, known: F.when((F.col(c) != int(LAST)) | F.col(known), F.col(c)).alias(c)
    return out.unionByName(alone).select(own("doc_id", "given"), F.col("n").alias("n_shingles"), own("component_id", "named"), "n_links", "text_hash", F.col("digest").alias("set_digest"), "leads")
