"""Diffusion of whole sparse vectors over the notes' graph, feature by feature.

Rounds of (1 - alpha) * own + alpha * the mean of the neighbours' vectors join features only through the lengths of three vectors of each note, and those follow from two sums
over its features: near * near and own * near. So no vector is sent along an edge. The vectors are turned once into blocks of features (each feature in one block, with its notes
and whole-number weights, some 2 bytes an entry on disk); a round reads the blocks, works out own and near there and hands on the sums of each note alone, and the next round or the result
works the blocks' weights out again. What is rebuilt costs time, not disk.

The graph is held by the driver and each Python worker: 4 bytes an edge, 40 bytes a note.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..session import cut, swept
from ..tables import spread

#: all weights of features are multiples of this
STEP = 0.05
#: notes a block, at most; entries worked on at once, and while rows are written, when the JVM has most of the memory; packed bytes that a task gathers before it hands them on; notes a row of sums; rows a batch of the result
NOTES_A_BLOCK, PIECE, WRITTEN, HELD, RANGE, ROWS = 4_000, 1_000_000, 250_000, 1 << 25, 65_536, 200_000

_PARTS = "block int, names binary, sizes binary, at binary, units binary"
_SUMS = "range int, sums binary"


@dataclass
class Graph:
    """Sorted note ids; the notes that take from a note, at ``start[i]`` to ``start[i + 1]`` of ``takers``; the length of each note's own vector; own and near factors of the rounds so far."""

    ids: np.ndarray
    start: np.ndarray
    takers: np.ndarray
    length: np.ndarray | None = None
    factors: tuple = ()

    @property
    def notes(self) -> int:
        return len(self.ids)

    def __getstate__(self) -> tuple:
        """Packed: what is broadcast lies on the driver's and on each executor's disk."""
        squares = None if self.length is None else _pack(np.rint(self.length**2).astype(np.int64))
        return _pack(np.diff(self.ids.astype(np.int64), prepend=0).view(np.uint64)), _pack(np.diff(self.start)), _pack(self.takers), squares, self.factors

    def __setstate__(self, state: tuple) -> None:
        ids, degrees, takers, squares, self.factors = state
        self.ids, self.start, self.takers = np.cumsum(_unpack(ids)), np.concatenate(([0], np.cumsum(_unpack(degrees)))), _unpack(takers).astype(np.int32)
        self.length = None if squares is None else np.sqrt(_unpack(squares))


def graph(ids: DataFrame, edges: DataFrame) -> Graph:
    """Of all distinct note ids (note_id) and the directed pairs (src, dst): src takes from dst."""
    with swept(ids.sparkSession):
        known = np.unique(ids.where("note_id is not null").select("note_id").distinct().toArrow()["note_id"].to_numpy())
        e = edges.select("src", "dst").toArrow()
    src, dst = (np.searchsorted(known, e[c].to_numpy()).astype(np.int32) for c in ("src", "dst"))
    start = np.zeros(len(known) + 1, np.int64)
    np.cumsum(np.bincount(dst, minlength=len(known)), out=start[1:])
    return Graph(known, start, src[np.argsort(dst, kind="stable")])


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes as the greatest takes, byte by byte of all of them, compressed."""
    width = np.min_scalar_type(int(a.max(initial=0))).itemsize
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return width.to_bytes() + len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(pa.decompress(b[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.int64)


def _strings(names: pa.Array) -> bytes:
    """Strings, nulls among them, compressed: loose in a row each would take 16 bytes besides its own."""
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([names], names=["name"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _names(b: bytes) -> pa.Array:
    return pa.ipc.open_stream(b).read_all()["name"].combine_chunks()


def _gaps(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each feature's rising places the first, then the steps between them."""
    out = np.diff(at, prepend=0)
    first = np.cumsum(sizes) - sizes
    out[first] = at[first]
    return out


def _places(sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    total, first = np.cumsum(gaps), np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - gaps[first], sizes)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, rising, and where each was; equal ones in their order. Key and place in one number where both fit: that sorts several times as fast as places by key."""
    low, bits = int(keys.min()), len(keys).bit_length()
    if (int(keys.max()) - low).bit_length() + bits <= 63:
        both = keys - low  # in place from here: these arrays are the most that a worker holds
        both <<= bits
        both |= np.arange(len(keys))
        both.sort()
        place = both & ((1 << bits) - 1)
        both >>= bits
        both += low
        return both, place
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def _starts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and the sums of their values."""
    if not len(keys):
        return keys, values
    k, order = _sorted(keys)
    first = _starts(k)
    return k[first], np.add.reduceat(values[order], first)


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield at, stop
        at = stop


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    block, names, sizes, at, units = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(pa.array(x, pa.binary()) for x in (names, sizes, at, units))], names=["block", "names", "sizes", "at", "units"])


def _parts(ids: np.ndarray, lists: pa.Array, blocks: int, known: np.ndarray) -> list[tuple]:
    """A row for each block that the notes have features of, and row -1 with the squared lengths of their vectors."""
    flat, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    d = pc.dictionary_encode(flat.field("feature"), null_encoding="encode")
    names = d.dictionary.to_pylist()
    weights = flat.field("weight").to_numpy(zero_copy_only=False) / STEP
    units = np.rint(weights).astype(np.int64)
    if len(units) and np.abs(weights - units).max() > 1e-6:
        raise ValueError(f"a weight that is no multiple of {STEP}")
    of = np.array([zlib.crc32(x.encode()) % blocks if x is not None else 0 for x in names], np.int64)
    by_block = np.argsort(of, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[by_block] = np.arange(len(names))
    at = np.searchsorted(known, ids)
    key, units = _added(rank[d.indices.to_numpy(zero_copy_only=False)] * len(known) + np.repeat(at, lengths), units)
    code, note = key // len(known), key % len(known)
    squares = _squares(note, units, at)
    order = np.argsort(at)
    out = [(-1, b"", b"", _pack(at[order]), _pack(squares[order]))]
    sizes, of = np.bincount(code, minlength=len(names)), of[by_block]
    feature_cuts = np.searchsorted(of, np.arange(blocks + 1))
    entry_cuts = np.concatenate(([0], np.cumsum(sizes)))[feature_cuts]
    for b in range(blocks):
        (f0, f1), (e0, e1) = feature_cuts[b : b + 2], entry_cuts[b : b + 2]
        if f1 > f0:
            out.append((b, _strings(d.dictionary.take(pa.array(by_block[f0:f1]))), _pack(sizes[f0:f1]), _pack(_gaps(sizes[f0:f1], note[e0:e1])), _pack(units[e0:e1])))
    return out


def _squares(note: np.ndarray, units: np.ndarray, at: np.ndarray) -> np.ndarray:
    k, s = _added(note, units * units)
    out = np.zeros(len(at), np.int64)
    place = np.searchsorted(k, at)
    ok = (place < len(k)) & (k[np.minimum(place, len(k) - 1)] == at) if len(k) else np.zeros(len(at), bool)
    out[ok] = s[place[ok]]
    return out


def _one(rows: list[tuple]) -> tuple:
    """One row of a block's rows."""
    if len(rows) == 1:
        return rows[0]
    block, names, sizes, at, units = rows[0][0], *([row[k] for row in rows] for k in range(1, 5))
    at, units = [_unpack(x) for x in at], [_unpack(x) for x in units]
    if block < 0:
        at, units = np.concatenate(at), np.concatenate(units)
        order = np.argsort(at)
        return block, b"", b"", _pack(at[order]), _pack(units[order])
    sizes = [_unpack(x) for x in sizes]
    d = pc.dictionary_encode(pa.concat_arrays([_names(x) for x in names]), null_encoding="encode")
    code = np.repeat(d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(sizes))
    note = np.concatenate([_places(s, a) for s, a in zip(sizes, at, strict=True)])
    key, units = _added(code * (span := int(note.max()) + 1) + note, np.concatenate(units))
    sizes = np.bincount(key // span, minlength=len(d.dictionary))
    return block, _strings(d.dictionary), _pack(sizes), _pack(_gaps(sizes, key % span)), _pack(units)


def _merged(t: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_rows([_one(list(zip(*t.to_pydict().values(), strict=True)))])])


def _gathered(pieces: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows of many pieces, one for each block: what is shuffled has a feature's name once a task, not once a piece."""
    held, size = defaultdict(list), 0
    for rows in pieces:
        for row in rows:
            held[row[0]].append(row)
            size += sum(map(len, row[1:]))
        if size > HELD:
            yield _rows([_one(x) for x in held.values()])
            held, size = defaultdict(list), 0
    if held:
        yield _rows([_one(x) for x in held.values()])


def _count(spark: SparkSession, g: Graph) -> int:
    """How many blocks the features of a graph's notes are in."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-g.notes // NOTES_A_BLOCK))


def blocks(vectors: DataFrame, g: Graph) -> tuple[DataFrame, Graph]:
    """The blocks of rows (note_id, features: array<struct<feature, weight>>, not yet added up) of one row a note, written to the shared folder, and the graph with the vectors' lengths."""
    spark = vectors.sparkSession
    shared, count = spark.sparkContext.broadcast(g.ids), _count(spark, g)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for b in batches:
            lengths = b["features"].value_lengths().to_numpy(zero_copy_only=False)
            for at, stop in _pieces(lengths):
                yield _parts(b["note_id"][at:stop].to_numpy(), b["features"][at:stop], count, shared.value)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(pieces(batches))

    with swept(spark):
        table = cut(vectors.where("note_id is not null").select("note_id", "features").mapInArrow(parts, _PARTS).groupBy("block").applyInArrow(_merged, _PARTS), "blocks")
    shared.destroy()
    squares = np.zeros(g.notes)
    for r in table.where("block = -1").select("at", "units").toArrow().to_pylist():
        squares[_unpack(r["at"])] = _unpack(r["units"])
    return table, replace(g, length=np.sqrt(squares))


def _joined(g: Graph, key: np.ndarray, weight: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key (feature * notes + note), own and near weight wherever the note or one of its neighbours has the feature; in pieces of whole features. A feature meets an edge once at most.
    One that is larger than a piece and met by much of the graph is added up over all notes, unsorted: that takes a third of the memory."""
    note, feature = key % g.notes, key // g.notes
    degree = g.start[note + 1] - g.start[note]
    load, at = np.cumsum(degree + 1), 0
    while at < len(key):
        done = load[at - 1] if at else 0
        stop = int(np.searchsorted(load, done + piece, "right"))
        if stop < len(key):
            whole = int(np.searchsorted(feature, feature[stop], "left"))
            stop = whole if whole > at else int(np.searchsorted(feature, feature[stop], "right"))
        n, w = degree[at:stop], weight[at:stop]
        edge = np.repeat(g.start[note[at:stop]] - (np.cumsum(n) - n), n)
        edge += np.arange(len(edge))
        if feature[at] == feature[stop - 1] and load[stop - 1] - done > max(piece, g.notes // 4):
            taker, own, has = g.takers[edge], np.zeros(g.notes), np.zeros(g.notes, bool)
            del edge
            has[note[at:stop]], has[taker], own[note[at:stop]] = True, True, w
            near, k = np.bincount(taker, np.repeat(w, n), g.notes), np.flatnonzero(has)
            own, near = own[k], near[k]
            k += feature[at] * g.notes
            del taker, has
            yield k, own, near
            at = stop
            continue
        keys = np.concatenate((key[at:stop], np.repeat(feature[at:stop] * g.notes, n)))
        keys[len(w) :] += g.takers[edge]
        del edge
        k, order = _sorted(keys)
        del keys
        first, both = _starts(k), np.concatenate((w, np.repeat(w, n)))[order]
        own = np.where(order[first] < len(w), both[first], 0.0)  # a note's own weight comes before what it takes
        near = np.add.reduceat(both, first)
        near -= own
        k = k[first]
        del order, first, both  # the rounds within each other each stop at the yield
        yield k, own, near
        at = stop


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks, one at a time."""
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b[c][k].as_py() for c in ("block", "names", "sizes", "at", "units")}
            if row["block"] >= 0:
                yield row


def _rounds(g: Graph, row: dict, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key, own and near weight of a block before the round that has no factors yet."""
    sizes = _unpack(row["sizes"])
    note = _places(sizes, _unpack(row["at"]))
    weight = _unpack(row["units"]) / g.length[note]

    def walk(key: np.ndarray, weight: np.ndarray, k: int):
        for key, own, near in _joined(g, key, weight, piece):
            if k == len(g.factors):
                yield key, own, near
            else:
                a, b = g.factors[k]
                note = key % g.notes
                own *= a[note]
                near *= b[note]
                own += near
                del note, near
                yield from walk(key, own, k + 1)

    return walk(np.repeat(np.arange(len(sizes)), sizes) * g.notes + note, weight, 0)


def _factors(own: np.ndarray, near: np.ndarray, both: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors of own and near weights in the round's vectors of unit length: from the squared length of own and near and their product."""
    length = np.sqrt(near)
    has = length > 0
    safe = np.where(has, length, 1.0)
    a, b = np.where(has, 1 - alpha, 1.0), np.where(has, alpha / safe, 0.0)
    norm = np.sqrt(a * a * own + 2 * a * b * both + b * b * near)
    norm = np.where(norm > 0, norm, 1.0)
    return a / norm, b / norm


def _sums(table: DataFrame, g: Graph) -> tuple[DataFrame, Broadcast]:
    """range, sums: near * near and own * near over all features of each note of a range; and the shared graph, to be destroyed once they are there."""
    spark = table.sparkSession
    shared, n = spark.sparkContext.broadcast(g), g.notes

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, n))
        for row in _read(batches):
            for key, own, near in _rounds(shared.value, row):
                note = key % n
                out[0] += np.bincount(note, near * near, n)
                out[1] += np.bincount(note, own * near, n)
        for k, at in enumerate(range(0, n, RANGE)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out[:, at : at + RANGE].tobytes()], pa.binary())], names=["range", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(x) for x in t["sums"].to_pylist()))
        return pa.table({"range": t["range"][:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    return spread(table).coalesce(spark.sparkContext.defaultParallelism).mapInArrow(part, _SUMS).groupBy("range").applyInArrow(add, _SUMS), shared


def _collected(sums: DataFrame, g: Graph, wide: int) -> np.ndarray:
    out = np.zeros((wide, g.notes))
    with swept(sums.sparkSession):
        rows = sums.select("*").toArrow().to_pylist()
    for r in rows:
        part = np.frombuffer(r["sums"]).reshape(wide, -1)
        out[:, r["range"] * RANGE : r["range"] * RANGE + part.shape[1]] = part
    return out


def _own(g: Graph) -> np.ndarray:
    """The squared length of each note's vector in any round: 1, or 0 of one without features that has taken none yet."""
    own = (g.length > 0).astype(float)
    for _, b in g.factors:
        own = np.maximum(own, b > 0)
    return own


def _after(table: DataFrame, g: Graph, rounds: int, alpha: float) -> Graph:
    """The graph with the factors of so many rounds more."""
    for _ in range(rounds):
        sums, shared = _sums(table, g)
        near, both = _collected(sums, g, 2)
        shared.destroy()
        g = replace(g, factors=(*g.factors, _factors(_own(g), near, both, alpha)))
    return g


def vectors(table: DataFrame, g: Graph, steps: int = 2, alpha: float = 0.35) -> DataFrame:
    """note_id, feature, weight of the diffused vectors, whole, to six decimals (rounding a column of doubles is the slower part of the JVM's work here). At least one round.
    Each block is a task of its own: the rows are some 100 times the blocks' bytes, so a split of the scan would be written as one file of up to a GB, in minutes."""
    g = _after(table, g, steps, alpha)
    *before, (last_a, last_b) = g.factors
    shared = table.sparkSession.sparkContext.broadcast((replace(g, factors=tuple(before)), last_a, last_b))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, a, b = shared.value
        for row in _read(batches):
            names = _names(row["names"])
            for key, own, near in _rounds(h, row, WRITTEN):
                for k in range(0, len(key), ROWS):
                    note, feature = key[k : k + ROWS] % h.notes, key[k : k + ROWS] // h.notes
                    weight = a[note] * own[k : k + ROWS] + b[note] * near[k : k + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(h.ids[note], pa.int64()), names.take(pa.array(feature)), pa.array(np.floor(weight * 1e6 + 0.5) / 1e6)], names=["note_id", "feature", "weight"])

    return table.where("block >= 0").repartitionById(_count(table.sparkSession, g), "block").mapInArrow(emit, "note_id bigint, feature string, weight double")
