"""Near-duplicate texts by a generalised pigeonhole over partitions of a binary code.

A text's key becomes the set of its three-character substrings, the set a binary code: min-wise values (one-permutation hashing, several functions of 32 bins
each), whose bits agree or differ together. Two codes whose sets have a Jaccard similarity s agree in a value with probability s.

1. Grouping. Which values agree together is measured over all records: how many records of its batch share each value of a record, and how these numbers go together
   from value to value. Boilerplate makes some values agree in many records at once; correlated ones are grouped into one partition, so what many records share ends up
   in few partitions and the others tell records apart. Where records are made of many overlapping templates no grouping does that for all of them at once; so values of different
   functions, spread at random, are the other grouping, and the one whose allocation is estimated to cost less is taken.
2. Allocating. The candidates that each partition gives, with all of its values equal (threshold 0) or all but one (1), are estimated over all records. A
   partition of w values differs in at most t of them with a known probability, and the misses of the partitions multiply: the budget is that they leave at most
   ``miss`` of the pairs at the threshold unfound. Dynamic programming gives each partition its threshold (-1: not probed), at the least cost in candidates and
   signatures.
3. Probing. Each record leaves a signature for each way to meet a partition's threshold, in hash buckets; records of a bucket with equal signatures are candidates.
4. Verifying. Candidates are made distinct and their similarity computed from the keys.

Scale: copies of one key are represented once, by the least id. Signatures travel as packed arrays, six bytes each, one row for each batch and bucket, so the JVM sorts
buckets, not signatures; buckets grow with the records, what a batch sends doesn't. A signature of very many records is known from the estimate and never enters a bucket, one shared by more
than ``HOT`` isn't paired off there: its records are searched again among themselves with fresh functions, and groups that stay together through ``DEPTH`` such
searches (which are almost surely alike) are compared in pairs of blocks, each a task of its own that gives off similar pairs only. Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard

BINS = 32
SLOTS = 512
VALUE_SLOTS = 4096
HOT = 256
DEPTH = 2
BLOCK = 2000
BUCKET_SIGNATURES = 1_500_000
PAIRS_AT_ONCE = 500_000
#: a signature of one record in so many or more is kept out of the buckets
OFTEN = 128
#: fewer records of a batch are not looked at for that
FEW = 8
#: in pairs that are compared: what a signature of a record costs, its share of a sort, beside a candidate with its part in two joins
SIGNATURE_COST = 0.1
_EMPTY = np.uint32(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def gram_codes(keys: list[str], q: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit code of every q-character substring, and the row of each. A key shorter than that is one substring by itself."""
    lengths = np.fromiter((len(k) for k in keys), np.int64, len(keys))
    c = np.frombuffer(("".join(keys) + "\x00" * q).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[: len(c) - q + 1].copy()
    for j in range(1, q):
        h = _mix(h * np.uint32(0x9E3779B1) + c[j : len(c) - q + 1 + j])
    counts = np.maximum(lengths - q + 1, np.minimum(lengths, 1))
    row = np.repeat(np.arange(len(keys)), counts)
    starts = np.cumsum(lengths) - lengths
    return h[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], row


def values(codes: np.ndarray, row: np.ndarray, n: int, functions: range, seed: int) -> np.ndarray:
    """n rows of min-wise values: ``BINS`` for each function; an empty bin borrows from the next one that has a value."""
    out = np.empty((n, len(functions), BINS), np.uint32)
    base = row * BINS
    weights = (np.uint64(1) << np.arange(BINS, dtype=np.uint64)).astype(np.uint64)
    for k, f in enumerate(functions):
        h = _mix(codes * np.uint32(2 * f + 1) + np.uint32((0x51ED27 * (f + 1) + 0x2545F491 * seed) & 0xFFFFFFFF))
        m = np.full(n * BINS, _EMPTY, np.uint32)
        np.minimum.at(m, base + (h >> np.uint32(27)).astype(np.int64), h & np.uint32(0x07FFFFFF))
        m = m.reshape(n, BINS)
        empty = m == _EMPTY
        r, b = np.nonzero(empty)
        if len(r):
            held = (~empty) @ weights
            shift = ((b + 1) % BINS).astype(np.uint64)
            x = ((held[r] >> shift) | (held[r] << (np.uint64(BINS) - shift))) & np.uint64(0xFFFFFFFF)
            step = np.log2((x & (~x + np.uint64(1))).astype(np.float64), where=x > 0, out=np.zeros(len(x))).astype(np.int64)
            m[r, b] = _mix(m[r, (b + 1 + step) % BINS] + (step + 1).astype(np.uint32))
        out[:, k] = m
    return out.reshape(n, -1)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Partitions:
    """Partitions of the code: each takes ``width`` values."""

    def __init__(self, columns: list[list[int]], functions: int, seed: int = 0):
        self.columns, self.functions, self.seed = columns, functions, seed
        self.width = len(columns[0])

    def values(self, keys: list[str]) -> np.ndarray:
        codes, row = gram_codes(keys)
        return values(codes, row, len(keys), range(self.functions), self.seed)

    def mixed(self, v: np.ndarray) -> np.ndarray:
        """(records, partitions, values): a 64-bit hash of each value, whose sums are signatures."""
        at = np.array(self.columns)
        salted = v[:, at.ravel()].astype(np.uint64) + (at.ravel().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return _mix64(salted).reshape(len(v), *at.shape)

    def signatures(self, mixed: np.ndarray, scope: np.ndarray, part: int, drop: int | None = None) -> np.ndarray:
        """A signature of a partition's values (but the one at place ``drop``), of the scope and of which partition it is."""
        h = mixed[:, part].sum(axis=1)
        if drop is not None:
            h = h - mixed[:, part, drop]
        own = np.uint64(((part * 16 + 1 + (0 if drop is None else drop + 1)) * 0xD6E8FEB86659FD93 + self.seed) & 0xFFFFFFFFFFFFFFFF)
        return _mix64(h + _mix64(scope + own))


def grouped(correlation: np.ndarray, level: np.ndarray, width: int) -> list[list[int]]:
    """Partitions of ``width`` columns each: the column left that agrees most often, with those that are most correlated with the ones taken."""
    rest, out = set(range(len(level))), []
    while len(rest) >= width:
        part = [max(rest, key=lambda c: (level[c], -c))]
        rest.discard(part[0])
        while len(part) < width:
            near = correlation[part].sum(axis=0)
            part.append(max(rest, key=lambda c: (near[c], -c)))
            rest.discard(part[-1])
        out.append(part)
    return out


def spread_out(functions: int, width: int, seed: int) -> list[list[int]]:
    """Partitions of ``width`` columns of different functions, their bins at random."""
    rng = np.random.default_rng(101 + seed)
    bins = np.stack([rng.permutation(BINS) for _ in range(functions)])
    flat = [f * BINS + int(bins[f, i]) for i in range(BINS) for f in range(functions)]
    return [flat[i : i + width] for i in range(0, len(flat) - width + 1, width)]


def passes(width: int, t: int, similarity: float) -> float:
    """The probability that at most ``t`` of a partition's values differ."""
    return sum(comb(width, k) * similarity ** (width - k) * (1 - similarity) ** k for k in range(t + 1))


def allocate(candidates: list[list[float]], width: int, threshold: float, miss: float, signature_cost: float) -> list[int]:
    """The threshold of each partition, from -1 up; candidates: the estimated ones of each partition at 0, 1 and so on.

    Dynamic programming over the budget -log(miss), in 400 steps: the least sum of candidates and of ``signature_cost`` for each signature of all records. A budget that no
    allocation meets raises a ValueError.
    """
    steps = 400
    unit = -log(miss) / steps
    gain = [int(-log(1 - passes(width, t, threshold)) / unit) for t in range(len(candidates[0]))]
    best = np.full(steps + 1, np.inf)
    best[0] = 0.0
    came: list[list[tuple[int, int]]] = []  # for each partition and level: the threshold taken and the level before it
    for costs in candidates:
        new, how = best.copy(), [(-1, level) for level in range(steps + 1)]
        for t, cost in enumerate(costs):
            cost = cost + signature_cost * comb(width, t)
            for level in np.flatnonzero(np.isfinite(best)).tolist():
                to = min(steps, level + gain[t])  # the last level stands for any more
                if best[level] + cost < new[to]:
                    new[to], how[to] = best[level] + cost, (t, level)
        best = new
        came.append(how)
    if not np.isfinite(best[steps]):
        raise ValueError("these partitions can't keep the misses within the budget: more functions are needed")
    out, level = [], steps
    for how in reversed(came):
        t, level = how[level]
        out.append(t)
    return out[::-1]


def functions_for(width: int, threshold: float, miss: float, least: int) -> int:
    """As many functions as keep the misses within the budget twice over with thresholds of 1, and at least ``least``."""
    needed = -log(miss) / -log(1 - passes(width, 1, threshold))
    return max(least, ceil(2 * needed * width / BINS))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    rec = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    scope = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return rec, scope, batch.column(2).to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            end, chars = at, 0
            sizes = pc.utf8_length(batch.column(2).slice(at, rows)).to_pylist()
            while end < batch.num_rows and end - at < len(sizes) and (end == at or chars + sizes[end - at] <= 2_000_000):
                chars += sizes[end - at]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def _added(df: DataFrame) -> DataFrame:
    """Rows (at, s, sums) of every task added up by ``at`` and ``s``."""

    def add(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1)
        return pa.table({"at": first.column("at"), "s": first.column("s"), "sums": pa.array([np.sum([np.array(x) for x in t.column("sums").to_pylist()], axis=0)], pa.list_(pa.float64()))})

    return df.groupBy("at", "s").applyInArrow(add, "at int, s bigint, sums array<double>")


def _sums(rows: dict[int, np.ndarray], probe: int = 0, often: np.ndarray | None = None, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of sums by number, or the counts of a probe's signatures with a negative number."""
    at, s, sums = list(rows), [0] * len(rows), list(rows.values())
    if often is not None:
        at, s, sums = [-1 - probe] * len(often), often.view(np.int64), [[float(c)] for c in counts]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(s, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["at", "s", "sums"])


def correlations(reps: DataFrame, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The correlation of the code's values with each other, and how often each is shared, over all records: for each record and value the logarithm of how many
    records of its batch have the same one."""
    n_columns = functions * BINS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, n = np.zeros((n_columns, n_columns)), np.zeros(n_columns), 0
        base = np.arange(n_columns, dtype=np.int64) * VALUE_SLOTS
        for batch in _slices(batches):
            keys = batch.column(2).to_pylist()
            codes, row = gram_codes(keys)
            slots = (values(codes, row, len(keys), range(functions), seed) % np.uint32(VALUE_SLOTS)).astype(np.int64) + base
            shared = np.log(np.maximum(np.bincount(slots.ravel(), minlength=n_columns * VALUE_SLOTS), 1).astype(np.float32))[slots]
            products += shared.T @ shared
            sums += shared.sum(axis=0)
            n += len(keys)
        yield _sums({c: np.r_[products[c], sums[c], n] for c in range(n_columns)})

    # as many rows as there are values, whatever the number of records
    rows = {r[0]: r[1] for r in _added(reps.select("rec", "scope", "key").mapInArrow(count, "at int, s bigint, sums array<double>")).select("at", "sums").collect()}
    table = np.array([rows[c] for c in range(n_columns)]) if rows else np.zeros((n_columns, n_columns + 2))
    n = max(1.0, table[0, -1])
    mean = table[:, -2] / n
    covariance = table[:, :n_columns] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    return covariance / np.outer(spread, spread), mean


def _ways(parts: Partitions, t: int) -> list[int | None]:
    """The values left out to meet a threshold: none, or each in turn."""
    return [None] if t == 0 else list(range(parts.width))


def _probes(parts: Partitions, thresholds: list[int]) -> list[tuple[int, int | None]]:
    return [(p, d) for p, t in enumerate(thresholds) if t >= 0 for d in _ways(parts, t)]


Costs = list[list[float]]


def estimated(reps: DataFrame, groupings: list[Partitions]) -> tuple[list[Costs], int, list[dict[tuple[int, int | None], list[int]]]]:
    """For each grouping and partition the candidates over all records at thresholds 0 and 1, the number of records, and for each grouping and probe the signatures that about one
    record in ``OFTEN`` has.

    A signed count sketch of each signature's records gives the number of pairs. A signature that frequent makes up half as much of some batches, which hold most of its records; those batches
    count it. There are at most 2 * OFTEN of a probe.
    """
    probes = [(g, p, d) for g, parts in enumerate(groupings) for p in range(len(parts.columns)) for d in (None, *range(parts.width))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((len(probes), SLOTS)), 0
        for batch in _slices(batches):
            _, scope, keys = _unpacked(batch)
            v = groupings[0].values(keys)
            mixed = [parts.mixed(v) for parts in groupings]
            least = max(FEW, len(keys) / (2 * OFTEN))
            for k, (g, p, d) in enumerate(probes):
                s = groupings[g].signatures(mixed[g], scope, p, d)
                slot = (s >> np.uint64(55)).astype(np.int64)
                sums[k] += np.bincount(slot, np.where((s >> np.uint64(20)) & np.uint64(1), 1.0, -1.0), SLOTS)
                full = np.bincount(slot, minlength=SLOTS) >= least + len(keys) / SLOTS
                if full.any():
                    often, c = np.unique(s[full[slot]], return_counts=True)
                    often, c = often[c >= least], c[c >= least]
                    if len(often):
                        yield _sums({}, k, often, c)
            seen += len(keys)
        yield _sums({**{k: sums[k] for k in range(len(probes))}, len(probes): np.array([float(seen)])})

    table = cut(reps.select("rec", "scope", "key").mapInArrow(count, "at int, s bigint, sums array<double>"), "estimates")
    rows = {r[0]: np.array(r[1]) for r in _added(table.where("at >= 0")).select("at", "sums").collect()}
    n = int(rows[len(probes)][0]) if rows else 0
    counted = table.where("at < 0").groupBy("at", "s").agg(F.sum(F.col("sums")[0]).alias("c"))
    often = counted.where(F.col("c") * 2 * OFTEN >= max(n, 2 * OFTEN * HOT)).select("at", "s").collect()
    discard(table)
    pairs = {x: max(0.0, ((rows[k] ** 2).sum() - n) / 2) if rows else 0.0 for k, x in enumerate(probes)}
    costs = [[[pairs[g, p, None], sum(pairs[g, p, d] for d in range(parts.width))] for p in range(len(parts.columns))] for g, parts in enumerate(groupings)]
    by_probe: list[dict[tuple[int, int | None], list[int]]] = [{} for _ in groupings]
    for r in often:
        g, p, d = probes[-1 - r[0]]
        by_probe[g].setdefault((p, d), []).append(r[1])
    return costs, n, by_probe


def _emitter(parts: Partitions, thresholds: list[int], buckets: int, often: np.ndarray):
    probes = _probes(parts, thresholds)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rec, scope, keys = _unpacked(batch)
            n = len(keys)
            m = parts.mixed(parts.values(keys))
            s = np.empty((n, len(probes)), np.uint64)
            for i, (p, d) in enumerate(probes):
                s[:, i] = parts.signatures(m, scope, p, d)
            s, local = s.ravel(), np.repeat(np.arange(n, dtype=np.uint16), len(probes))
            where, at, sigs, hot = [], [], [], []
            if len(often):
                k = np.clip(np.searchsorted(often, s), 0, len(often) - 1)
                hot = often[k] == s
                for x in np.unique(s[hot]):  # a row for each, with no signatures beside it
                    where.append(int(x.view(np.int64))), at.append(local[hot & (s == x)].tobytes()), sigs.append(None)
                s, local = s[~hot], local[~hot]
            bucket = ((s & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
            order = np.argsort(bucket, kind="stable")
            local, short = local[order], (s[order] >> np.uint64(32)).astype(np.uint32)
            held, starts = np.unique(bucket[order], return_index=True)
            for b, lo, hi in zip(held.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
                where.append(b), at.append(local[lo:hi].tobytes()), sigs.append(short[lo:hi].tobytes())
            runs = np.flatnonzero(np.r_[True, np.diff(rec) != 1])
            first, size = rec[runs].tolist(), np.diff(np.r_[runs, n]).tolist()
            k = len(where)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int64()), pa.array([first] * k, pa.list_(pa.int64())), pa.array([size] * k, pa.list_(pa.int32())), pa.array(at, pa.binary()), pa.array(sigs, pa.binary())],
                names=["bucket", "first", "size", "at", "sigs"],
            )

    return emit


def _records(first: list[int], size: list[int], at: bytes) -> np.ndarray:
    return np.concatenate([np.arange(f, f + n) for f, n in zip(first, size)])[np.frombuffer(at, np.uint16)]


def _pairs(a: np.ndarray, b: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    rows = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)] if not len(hot) else [a, hot], axis=1), axis=0)
    rows = rows[rows[:, 0] != rows[:, 1]] if not len(hot) else rows
    none = pa.array(np.zeros(len(rows), np.int64), mask=np.ones(len(rows), bool))
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), none if len(hot) else pa.array(rows[:, 1]), pa.array(rows[:, 1]) if len(hot) else none], names=["a", "b", "hot"])


def _paired(hot: int):
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recs, sigs, bucket = [], [], 0
        for batch in batches:
            for b, first, size, at, sig in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "size", "at", "sigs"))):
                recs.append(_records(first, size, at)), sigs.append(np.frombuffer(sig, np.uint32))
                bucket = b
        rec, sig = np.concatenate(recs), np.concatenate(sigs)
        order = np.argsort(sig, kind="stable")
        rec, sig = rec[order], sig[order]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        none = np.empty(0, np.int64)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= hot)]).tolist():
            every = starts[sizes == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, PAIRS_AT_ONCE // len(i))
            for k in range(0, len(every), step):
                at = every[k : k + step, None]
                yield _pairs(rec[(at + i).ravel()], rec[(at + j).ravel()], none)
        for at, size in zip(starts[sizes > hot].tolist(), sizes[sizes > hot].tolist()):
            yield _pairs(rec[at : at + size], none, np.full(size, (bucket << 32) | int(sig[at])))

    return pair


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of frequent signatures, a row for each."""
    for batch in batches:
        for bucket, first, size, at in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "size", "at"))):
            rec = _records(first, size, at)
            yield pa.RecordBatch.from_arrays([pa.array(rec), pa.array(np.full(len(rec), bucket))], names=["rec", "scope"])


@dataclass
class Plan:
    """The partitions of records, the threshold of each, the estimates that they go by, the number of records, and the signatures that are too frequent for a bucket."""

    parts: Partitions
    thresholds: list[int]
    costs: list[list[float]]
    records: int
    often: np.ndarray

    @property
    def probes(self) -> list[tuple[int, int | None]]:
        return _probes(self.parts, self.thresholds)

    def candidates(self) -> float:
        return sum(c[t] for c, t in zip(self.costs, self.thresholds) if t >= 0)


def planned(reps: DataFrame, threshold: float, miss: float, functions: int, width: int, seed: int = 0) -> Plan:
    """Partitions and thresholds for records (rec, scope, key)."""
    functions = functions_for(width, threshold, miss, functions)
    groupings = [Partitions(grouped(*correlations(reps, functions, seed), width), functions, seed), Partitions(spread_out(functions, width, seed), functions, seed)]
    costs, n, often = estimated(reps, groupings)
    plans = []
    for parts, own, frequent in zip(groupings, costs, often):
        thresholds = allocate(own, width, threshold, miss, SIGNATURE_COST * n)
        kept = [s for x in _probes(parts, thresholds) for s in frequent.get(x, [])]
        plans.append(Plan(parts, thresholds, own, n, np.sort(np.array(kept, np.int64).view(np.uint64))))
    return min(plans, key=lambda p: p.candidates() + SIGNATURE_COST * n * len(p.probes))


def similar_pairs(reps: DataFrame, threshold: float, miss: float, functions: int = 8, width: int = 5, depth: int = 0) -> DataFrame:
    """(a, b, similarity), a < b, of records (rec, scope, key) at or above the threshold; a pair may come twice."""
    plan = planned(reps, threshold, miss, functions, width, depth)
    parts, thresholds, n, often = plan.parts, plan.thresholds, plan.records, plan.often
    buckets = max(8, ceil(n * len(plan.probes) / BUCKET_SIGNATURES))
    emitted = reps.select("rec", "scope", "key").mapInArrow(_emitter(parts, thresholds, buckets, often), "bucket bigint, first array<bigint>, size array<int>, at binary, sigs binary")
    hot = None
    if len(often):
        emitted = cut(emitted, "signatures")
        hot = emitted.where("sigs is null").mapInArrow(_listed, "rec bigint, scope bigint")
    found = cut(emitted.where("sigs is not null").groupBy("bucket").applyInArrow(_paired(HOT), "a bigint, b bigint, hot bigint"), "candidates")
    keys = reps.select("rec", "key")
    left, right = keys.select(F.col("rec").alias("a"), F.col("key").alias("key_a")), keys.select(F.col("rec").alias("b"), F.col("key").alias("key_b"))
    out = _similarity(found.where("b is not null").select("a", "b").distinct().join(left, "a").join(right, "b"), threshold)
    shared = found.where("hot is not null").select(F.col("a").alias("rec"), F.col("hot").alias("scope"))
    if shared.limit(1).count() or hot is not None:
        again = cut((shared if hot is None else shared.unionAll(hot)).join(keys, "rec"), "hot")
        out = out.unionAll(similar_pairs(again, threshold, miss, functions, width, depth + 1) if depth < DEPTH else _by_blocks(again, threshold))
    return out


def _by_blocks(hot: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """The similar pairs within each scope of (rec, scope, key): a scope is cut into blocks, and each pair of blocks compared in a task of its own."""
    n = hot.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = hot.join(n, "scope").withColumn("own", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("scope", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rec", "key")
    check = _measured(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, own, rec, keys = t.column("i")[0].as_py(), t.column("own").to_numpy(), t.column("rec").to_numpy(), np.array(t.column("key").to_pylist(), object)
        same = t.column("j")[0].as_py() == i
        first, second = np.flatnonzero(own == i), np.flatnonzero(own != i)
        for k, at in enumerate(first.tolist()):
            mate = first[k + 1 :] if same else second
            a, b = np.minimum(rec[at], rec[mate]), np.maximum(rec[at], rec[mate])
            yield check(pa.array(a), pa.array(b), [keys[at]] * len(mate), keys[mate].tolist())

    return rows.groupBy("scope", "i", "j").applyInArrow(compare, "a bigint, b bigint, similarity double")


def _most_similar(x: list[str], y: list[str], rows: int = 2048) -> np.ndarray:
    """An upper bound of the similarity of each pair: substrings folded into 256 bits; a bit that one side only has is a substring that one side only has."""
    out = np.empty(len(x))
    for at in range(0, len(x), rows):
        bits, sizes = [], []
        for keys in (x[at : at + rows], y[at : at + rows]):
            codes, row = gram_codes(keys)
            flags = np.zeros(len(keys) * 256, bool)
            flags[row * 256 + (codes >> np.uint32(24))] = True
            bits.append(np.packbits(flags).view(np.uint64).reshape(len(keys), 4))
            sizes.append(np.bincount(row, minlength=len(keys)))
        apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(float)
        total = (sizes[0] + sizes[1]).astype(float)  # at least the distinct ones, so the bound stays one
        out[at : at + rows] = np.maximum(0.0, total - apart) / np.maximum(1.0, total + apart)
    return out


def _measured(threshold: float):
    def check(a: pa.Array, b: pa.Array, x: list[str], y: list[str]) -> pa.RecordBatch:
        s = np.zeros(len(x))
        for i in np.flatnonzero(_most_similar(x, y) >= threshold).tolist():
            p, q = x[i], y[i]
            g, h = {p[k : k + 3] for k in range(max(1, len(p) - 2))}, {q[k : k + 3] for k in range(max(1, len(q) - 2))}
            both = len(g & h)
            s[i] = both / (len(g) + len(h) - both)
        ok = pa.array((s >= threshold) & (np.asarray(a) != np.asarray(b)))
        return pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok), pa.array(s).filter(ok)], names=["a", "b", "similarity"])

    return check


def _similarity(df: DataFrame, threshold: float) -> DataFrame:
    """Rows of (a, b, key_a, key_b) with a similarity of at least the threshold, and that similarity."""
    check = _measured(threshold)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield check(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())

    return df.select("a", "b", "key_a", "key_b").mapInArrow(measure, "a bigint, b bigint, similarity double")


class NearDuplicates:
    """The near-duplicates among rows of (scope, id, key).

    representatives: (rec, scope, id, last, key), one row for each distinct key of a scope, id and last being the least and the greatest of its copies
    members: (id, representative) of every key that several ids have
    pairs: (a, b, similarity) between representatives, a < b, at or above the threshold
    """

    def __init__(self, rows: DataFrame, threshold: float = 0.65, least: int = 20, miss: float = 1e-3):
        """``miss``: the share of pairs just at the threshold that may stay unfound; functions are added until it can be met. Rows whose id or key is null, or whose key has under ``least`` characters, take no part. Equal (scope, id, key) rows count once, scopes aren't mixed;
        a null scope is one of its own. Keys of any length are read whole. No rows give no pairs.
        """
        usable = rows.where("id is not null and key is not null").where(F.length("key") >= least)
        hashed = usable.select(F.xxhash64("scope").alias("scope"), F.col("id").cast("bigint").alias("id"), "key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
        hashed = cut(hashed, "keyed")  # keys are made once: representatives and members read them
        distinct = hashed.groupBy("scope", "h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("key").alias("key"))
        self.representatives = cut(distinct.withColumn("rec", F.monotonically_increasing_id()), "representatives")
        repeated = self.representatives.where("last > id").select("scope", "h1", "h2", F.col("id").alias("representative"))
        self.members = hashed.select("scope", "h1", "h2", "id").join(repeated, ["scope", "h1", "h2"]).select("id", "representative").distinct()
        reps = self.representatives.select("rec", "scope", "key")
        similar = cut(similar_pairs(reps, threshold, miss).dropDuplicates(["a", "b"]), "similar")
        ids = self.representatives.select("rec", "id")
        self.pairs = (
            similar.join(ids.select(F.col("rec").alias("a"), F.col("id").alias("id_a")), "a")
            .join(ids.select(F.col("rec").alias("b"), F.col("id").alias("id_b")), "b")
            .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")
        )

    def all_pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b, of every pair of ids: those of the pairs' copies, and those within a group of copies."""
        m = self.members
        x, y = m.select(F.col("id").alias("p"), "representative"), m.select(F.col("id").alias("q"), "representative")
        within = x.join(y, "representative").where("p < q").select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))
        across = (
            self.pairs.join(m.select(F.col("representative").alias("a"), F.col("id").alias("p")), "a", "left")
            .join(m.select(F.col("representative").alias("b"), F.col("id").alias("q")), "b", "left")
            .select(F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))
            .select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
        )
        return within.unionAll(across)
