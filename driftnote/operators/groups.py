"""What two rounds of diffusion make of a query over the graph of links and whole groups: every two notes that share a tag or a folder are neighbours, however large the group.

The pairs are never made. Notes with the same groups are a class. The sum over all notes that share a group with a class, each once, is that of inclusion and exclusion over the sets of
its groups, whose own sums every class shares; links within a group are counted by it, and what is left of the links is added edge by edge. A round of one feature takes some numbers a note, in place of one a pair.

A round needs near * near and own * near of each note, over all features. A feature that more than one note has is worked out over all notes. Those that only one note has are most of
all features and need no work each: their squared weights add up to one number a note, and all notes of a class are worked out together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut, swept
from ..tables import spread
from . import diffusion as D

#: a class of many groups takes sums over sets of them up to so many, or as many as there are classes; else the sum over the classes themselves. Pairs of notes two links apart worked on at once. What a list has in columns
SETS, PAIRS, COLUMNS = 255, 1_000_000, 12


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_held: dict[tuple, np.ndarray] = {}


def _taken(x: np.ndarray, at: np.ndarray, name: str) -> np.ndarray:
    """x[at], in a worker's own memory of that name: new memory for each of these would cost several times the work. Good until it is next taken."""
    out = _held.get((name, len(at)))
    if out is None:
        out = _held[name, len(at)] = np.empty(len(at))
    return np.take(x, at, out=out, mode="clip")


def _by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where each begins, and the values in their order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = D._starts(keys) if len(keys) else np.zeros(0, np.int64)
    return keys[first], first, values[order]


def _sum_at(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else np.zeros(0)


class _Sums:
    """Sums over lists of places, the longest first: of short ones column by column, of what the others have besides at once."""

    def __init__(self, first: np.ndarray, at: np.ndarray, weight: np.ndarray | None = None):
        size = np.diff(np.append(first, len(at)))
        self.order = np.argsort(-size, kind="stable")
        size, first = size[self.order], first[self.order]
        each = [first[size > k] + k for k in range(min(COLUMNS, int(size.max(initial=0))))]
        more = size > COLUMNS
        rest, long = size[more] - COLUMNS, _ranges(first[more] + COLUMNS, size[more] - COLUMNS)
        self.columns = [(at[x], None if weight is None else weight[x]) for x in each]
        self.rest, self.rest_at, self.count = (at[long], None if weight is None else weight[long]), np.cumsum(rest) - rest, len(size)

    def of(self, x: np.ndarray, out: np.ndarray) -> None:
        out[:] = 0
        for at, weight in self.columns:
            part = _taken(x, at, "column")
            if weight is not None:
                part *= weight
            out[: len(at)] += part
        if len(self.rest_at):
            part = _taken(x, self.rest[0], "rest")
            if self.rest[1] is not None:
                part *= self.rest[1]
            out[: len(self.rest_at)] += np.add.reduceat(part, self.rest_at)


class Classes:
    """The classes' sets of groups, ``groups[start[c] : start[c + 1]]`` rising, and the sums over all classes that share a group with each."""

    def __init__(self, start: np.ndarray, groups: np.ndarray):
        self.start, self.groups, self.count, size = start, groups, len(start) - 1, np.diff(start)
        span, small = int(groups.max(initial=0)) + 1, (size > 0) & (2.0 ** np.minimum(size, 60) - 1 <= max(self.count, SETS))
        of = {int(k): np.flatnonzero(small & (size == k)) for k in np.unique(size[small])}
        sets = {k: np.zeros((2**k, len(c)), np.int64) for k, c in of.items()}  # of each choice of a class's groups its number, the same in every class
        parent, last, total = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        for level in range(1, max(of, default=0) + 1):
            at = [(k, m, m.bit_length() - 1) for k in of if k >= level for m in range(2**k) if m.bit_count() == level]
            keys = np.concatenate([sets[k][m ^ (1 << top)] * span + groups[start[of[k]] + top] for k, m, top in at])
            distinct, number = np.unique(keys, return_inverse=True)
            for (k, m, _), part in zip(at, np.split(number, np.cumsum([len(of[k]) for k, _, _ in at])[:-1]), strict=True):
                sets[k][m] = part + total
            parent.append(distinct // span)
            last.append(distinct % span)
            total += len(distinct)
        has, near = [(np.tile(c, 2**k - 1), sets[k][1:].ravel() - 1) for k, c in of.items()], []
        for c in np.flatnonzero((size > 0) & ~small):
            mine = np.zeros(span, bool)
            mine[groups[start[c] : start[c + 1]]] = True
            holds, at = np.zeros(total, bool), 1
            holds[0] = True
            for p, g in zip(parent[1:], last[1:], strict=True):
                holds[at : at + len(p)] = holds[p] & mine[g]
                at += len(p)
            held = np.flatnonzero(holds[1:])
            has.append((np.full(len(held), c), held))
            shared = np.zeros(self.count, bool)
            shared[np.repeat(np.arange(self.count), size)[mine[groups]]] = True
            near.append((np.full(int(shared.sum()), c), np.flatnonzero(shared)))
        cls, number = (np.concatenate(x) for x in zip(*has, strict=True)) if has else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        _, sets_at, members = _by(number, cls)
        self.sets = _Sums(sets_at, members)
        rank = np.empty(total - 1, np.int64)
        rank[self.sets.order] = np.arange(total - 1)
        self.small = [(c, [(m.bit_count() % 2 == 0, rank[sets[k][m] - 1]) for m in range(1, 2**k)]) for k, c in of.items()]
        big, near = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.big, self.big_at, self.near = _by(big, near)

    def around(self, w: np.ndarray) -> np.ndarray:
        """Of the classes' numbers the sum over all classes that share a group with each, itself among them."""
        out = np.zeros(self.count)
        sums = np.empty(self.sets.count)
        self.sets.of(w, sums)
        for c, terms in self.small:
            part = np.zeros(len(c))
            for minus, at in terms:
                (np.subtract if minus else np.add)(part, _taken(sums, at, "term"), out=part)
            out[c] = part
        if len(self.big):
            out[self.big] = _sum_at(w[self.near], self.big_at)
        return out

    def share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the classes of each pair share a group."""
        span, size = int(self.groups.max(initial=0)) + 1, np.diff(self.start)
        keys = np.repeat(np.arange(self.count), size) * span + self.groups
        n = size[a]
        wanted = np.repeat(b, n) * span + self.groups[_ranges(self.start[a], n)]
        place = np.searchsorted(keys, wanted)
        hit = keys[np.minimum(place, len(keys) - 1)] == wanted if len(keys) else np.zeros(0, bool)
        return np.bincount(np.repeat(np.arange(len(a)), n), hit, len(a)) > 0


@dataclass
class Whole:
    """The notes in the order of their classes: ids, the place of each note of the blocks, the class and where classes begin; links between notes without a shared group, at ``link_at``
    of ``link_to`` for each of ``linked``; the length of each note's own vector; own and near factors of the first round and what a note's own features that no other has weigh."""

    ids: np.ndarray
    place: np.ndarray
    cls: np.ndarray
    first: np.ndarray
    classes: Classes
    linked: np.ndarray
    link_at: np.ndarray
    link_to: np.ndarray
    grouped: np.ndarray
    length: np.ndarray
    factors: tuple = ()
    alone: np.ndarray | None = None

    @property
    def notes(self) -> int:
        return len(self.ids)

    def around(self, w: np.ndarray) -> np.ndarray:
        """Of the notes' numbers, added up by class, the sums over all notes that share a group with each, itself among them."""
        return self.classes.around(w)[self.cls]

    def besides(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Onto ``out``: what links add, less each note itself where its groups count it."""
        out -= x if self.grouped.all() else np.where(self.grouped, x, 0.0)
        if len(self.linked):
            out[self.linked] += np.add.reduceat(x[self.link_to], self.link_at)
        return out

    def by_class(self, x: np.ndarray) -> np.ndarray:
        return _sum_at(x, self.first)

    def near(self, x: np.ndarray) -> np.ndarray:
        """The sum over each note's neighbours."""
        return self.besides(x, self.around(self.by_class(x)))

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As rows of a sparse matrix, ``besides``: start, columns, values."""
        own = np.flatnonzero(self.grouped)
        sizes = np.diff(np.append(self.link_at, len(self.link_to)))
        row = np.concatenate((np.repeat(self.linked, sizes), own))
        order = np.argsort(row, kind="stable")
        col, value = np.concatenate((self.link_to, own))[order], np.concatenate((np.ones(len(self.link_to)), np.full(len(own), -1.0)))[order]
        return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=self.notes)))), col, value


def whole(g: D.Graph, groups: DataFrame) -> Whole:
    """Of the links' graph, with the vectors' lengths, and the distinct (note_id, g) of all groups."""
    with swept(groups.sparkSession):
        t = groups.where("note_id is not null and g is not null").select("note_id", "g").toArrow().combine_chunks()
    names = t["g"].combine_chunks().dictionary_encode()
    note, group = np.searchsorted(g.ids, t["note_id"].to_numpy()), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((group, note))
    note, group, span = note[order], group[order], len(names.dictionary) + 1
    size = np.bincount(note, minlength=g.notes)
    start, key, cls = np.concatenate(([0], np.cumsum(size))), np.zeros(g.notes, np.int64), np.zeros(g.notes, np.int64)
    for k in range(int(size.max(initial=0))):
        key[:] = cls * span
        has = size > k
        key[has] += group[start[:-1][has] + k] + 1
        cls = np.unique(key, return_inverse=True)[1]
    order = np.argsort(cls, kind="stable")
    place = np.empty(g.notes, np.int64)
    place[order] = np.arange(g.notes)
    cls = cls[order]
    first = D._starts(cls) if g.notes else np.zeros(0, np.int64)
    one = order[first]  # a note of each class
    classes = Classes(np.concatenate(([0], np.cumsum(size[one]))), group[_ranges(start[one], size[one])])
    src, dst = place[g.takers], place[np.repeat(np.arange(g.notes), np.diff(g.start))]
    loose = ~classes.share(cls[src], cls[dst])
    linked, link_at, link_to = _by(src[loose], dst[loose])
    return Whole(g.ids[order], place, cls, first, classes, linked, link_at, link_to, size[order] > 0, g.length[order])


def _features(w: Whole, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of a block's features; notes and weights of their entries."""
    sizes = D._unpack(row["sizes"])
    note = w.place[D._places(sizes, D._unpack(row["at"]))]
    return sizes, note, D._unpack(row["units"]) / w.length[note]


def _many(sizes: np.ndarray, note: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(sizes > 1):
        at = slice(ends[k] - sizes[k], ends[k])
        yield note[at], weight[at]


class _Task:
    """What a task works with. A note's weight of a feature after a round is that of its class, less its own, and its links': the class's is worked out once for all its notes, the links' for the
    notes that have some, and what a note and those up to two links apart have of the feature themselves is added where there is any. So are their squares: with u and v the classes' weights
    in the first and the second round and f the links', (v - b * u + f) ** 2 is added up term by term, and b comes in at the end."""

    def __init__(self, w: Whole):
        self.w, self.count = w, w.classes.count
        self.start, self.col, self.value = w.steps()
        self.x, self.seen = np.zeros(w.notes), np.zeros(w.notes, bool)
        self.uu, self.uv, self.vv, self.uz, self.vz = np.zeros((5, self.count))

    def links(self) -> None:
        """For the second round: the notes with links, as their sums are in order, and what their terms add up in."""
        w, b = self.w, self.w.factors[1]
        self.sums = _Sums(w.link_at, w.cls[w.link_to], b[w.link_to])
        self.notes = w.linked[self.sums.order]
        self.of, self.f = w.cls[self.notes], np.zeros(len(self.notes) + 1)
        self.spot = np.full(w.notes, len(self.notes))  # of the others the last, which stays 0
        self.spot[self.notes] = np.arange(len(self.notes))
        self.ff, self.fu, self.fv, self.fz = np.zeros((4, len(self.notes)))
        self.room = np.zeros(len(self.notes))

    def linked(self, u: np.ndarray) -> np.ndarray:
        """What links bring in the second round of the classes' weights in the first."""
        self.sums.of(u, self.f[:-1])
        return self.f[:-1]

    def beside(self, n: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct notes among n and one link from them, rising, and what links add to each and it takes off itself."""
        size = self.start[n + 1] - self.start[n]
        at = _ranges(self.start[n], size)
        to = self.col[at]
        np.add.at(self.x, to, self.value[at] * np.repeat(v, size))
        self.seen[to] = self.seen[n] = True
        found = np.flatnonzero(self.seen)
        out = self.x[found]
        self.seen[found], self.x[found] = False, 0
        return found, out

    def squares(self, u: np.ndarray, v: np.ndarray, f: np.ndarray, times: float = 1.0) -> None:
        """Add the terms of the second round but those of a note's own features."""
        for total, x, y in ((self.uu, u, u), (self.uv, u, v), (self.vv, v, v)):
            total += times * x * y
        for total, y in ((self.ff, f), (self.fu, _taken(u, self.of, "u")), (self.fv, _taken(v, self.of, "v"))):
            np.multiply(f, y, out=self.room)
            if times != 1:
                self.room *= times
            total += self.room

    def added(self, out: np.ndarray) -> np.ndarray:
        """The terms onto near * near and own * near of the second round."""
        c, b = self.w.cls, self.w.factors[1]
        out[0] += self.vv[c] - 2 * b * self.uv[c] + b * b * self.uu[c] + 2 * (self.vz[c] - b * self.uz[c])
        out[1] += b * (self.uv[c] - b * self.uu[c] + self.uz[c])
        n = self.notes
        out[0, n] += self.ff + 2 * (self.fv - b[n] * self.fu + self.fz)
        out[1, n] += b[n] * self.fu
        return out


def _first(w: Whole, query: dict[str, float], rows: Iterable[dict]) -> np.ndarray:
    """near * near and own * near of the first round, over features of more than one note; own squared over the others; own times the query's weight."""
    out, task = np.zeros((4, w.notes)), _Task(w)
    for row in rows:
        sizes, note, weight = _features(w, row)
        lone = np.repeat(sizes == 1, sizes)
        out[2] += np.bincount(note[lone], weight[lone] ** 2, w.notes)
        asked = np.repeat(np.array([query.get(f, 0.0) for f in D._names(row["names"]).to_pylist()]), sizes)
        on = np.flatnonzero(asked)
        out[3] += np.bincount(note[on], weight[on] * asked[on], w.notes)
        for n, x in _many(sizes, note, weight):
            u = w.classes.around(np.bincount(w.cls[n], x, task.count))
            task.uu += u * u
            found, s = task.beside(n, x)
            near = u[w.cls[found]]
            out[0, found] += s * (2 * near + s)
            near += s
            out[1, n] += x * near[np.searchsorted(found, n)]
    out[0] += task.uu[w.cls]
    return out


def _second(w: Whole, rows: Iterable[dict]) -> np.ndarray:
    """near * near and own * near of the second round, over features of more than one note."""
    out, task, (a, b) = np.zeros((2, w.notes)), _Task(w), w.factors
    task.links()
    weight = w.by_class(b)
    for row in rows:
        for n, x in _many(*_features(w, row)):
            u = w.classes.around(np.bincount(w.cls[n], x, task.count))
            notes, r = task.beside(n, x)
            r *= b[notes]
            r[np.searchsorted(notes, n)] += a[n] * x
            v = w.classes.around(weight * u + np.bincount(w.cls[notes], r, task.count))
            f = task.linked(u)
            task.squares(u, v, f)
            found, s = task.beside(notes, r)
            own = np.zeros(len(found))
            own[np.searchsorted(found, notes)] = r
            c = w.cls[found]
            bu = b[found] * u[c]
            near = v[c] - bu + task.f[task.spot[found]]
            out[0, found] += s * (2 * near + s)
            out[1, found] += bu * s + own * (near + s)
    return task.added(out)


def _lone(w: Whole, share: Iterable[int]) -> np.ndarray:
    """near * near and own * near of the second round over the features of one note each, of the classes that are this task's.

    With s for what links add and a note takes off: the weight that note i takes of note j's own is far[i, class of j] + taken[j, class of i] + (s * b * s + s * a)[i, j], of which the first two
    are worked out a class at a time and the last only for notes at most two links apart.
    """
    out, task, (a, b), q = np.zeros((2, w.notes)), _Task(w), w.factors, w.alone
    task.links()
    start, col, value = task.start, task.col, task.value
    reach = np.concatenate(([0], np.cumsum(np.diff(start)[col])))
    load = 1 + reach[start[1:]] - reach[start[:-1]]
    weight, rest, ends, pick = w.by_class(b), w.by_class(q * (a - b) ** 2), np.append(w.first, w.notes), np.zeros(task.count)
    q_linked, ab_linked = q[task.notes], 2 * q[task.notes] * (a - b)[task.notes]
    for d in share:
        members = np.arange(ends[d], ends[d + 1])
        pick[d] = 1
        u = w.classes.around(pick)
        pick[d] = 0
        v, f = w.classes.around(weight * u), task.linked(u)
        notes, r = task.beside(members, q[members])
        r *= b[notes]
        r[np.searchsorted(notes, members)] += a[members] * q[members]
        z = w.classes.around(np.bincount(w.cls[notes], r, task.count))
        task.squares(u, v, f, q[members].sum())
        task.uz += u * z
        task.vz += v * z
        np.multiply(f, _taken(z, task.of, "z"), out=task.room)
        task.fz += task.room
        np.multiply(f, q_linked, out=task.room)
        out[0, members] += rest @ (u * u) + task.room @ f
        np.multiply(f, ab_linked, out=task.room)
        out[0, members] += task.room @ _taken(u, task.of, "u")
        loads = np.cumsum(load[members])
        for part in np.split(members, np.unique(np.searchsorted(loads, np.arange(PAIRS, loads[-1], PAIRS)))):
            if not len(part):
                continue
            n = start[part + 1] - start[part]
            at = _ranges(start[part], n)
            m, k, s = np.repeat(part, n), col[at], value[at]
            n = start[k + 1] - start[k]
            at = _ranges(start[k], n)
            two = np.repeat(m, n), col[at], np.repeat(s * b[k], n) * value[at], np.zeros(len(at)), np.zeros(len(at))
            zero = np.zeros(len(part))
            # m, other note, s * b * s, s, whether they are the same
            m, o, ss, s, same = (np.concatenate(x) for x in zip(two, (m, k, np.zeros(len(m)), s, np.zeros(len(m))), (part, part, zero, zero, zero + 1), strict=True))
            keys, order = D._sorted(m * w.notes + o)
            first = D._starts(keys)
            m, o = keys[first] // w.notes, keys[first] % w.notes
            ss, s, same = (np.add.reduceat(x[order], first) for x in (ss, s, same))
            c, brought = w.cls[o], task.f[task.spot[o]]
            bu = b[o] * u[c]
            far, taken = v[c] - bu + brought, a[o] * u[c] - bu + brought
            x, own = ss + s * a[m], a[o] * same + b[o] * s  # o takes of m's own
            np.add.at(out[0], o, q[m] * x * (2 * far + x))
            np.add.at(out[1], o, q[m] * (x * bu + own * (far + x)))
            x, own = ss + s * a[o], a[m] * same + b[m] * s  # m takes of o's own
            np.add.at(out[0], m, 2 * q[o] * x * taken)
            np.add.at(out[1], m, own * q[o] * taken)
    return task.added(out)


def _total(rows: DataFrame, w: Whole, wide: int, work: Callable[[Whole, Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sums of every task's work, a row of numbers for each note."""
    shared, n = rows.sparkSession.sparkContext.broadcast(w), w.notes

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work(shared.value, batches)
        for k, at in enumerate(range(0, n, D.RANGE)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out[:, at : at + D.RANGE].tobytes()], pa.binary())], names=["range", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(x) for x in t["sums"].to_pylist()))
        return pa.table({"range": t["range"][:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    out = D._collected(rows.mapInArrow(part, D._SUMS).groupBy("range").applyInArrow(add, D._SUMS), w, wide)
    shared.destroy()
    return out


def similarities(table: DataFrame, w: Whole, query: dict[str, float], alpha: float = 0.35) -> DataFrame:
    """note_id, similarity of the vectors after two rounds with a query's vector, where it is above 0, and centrality: the note's share of the highest degree, null without neighbours."""
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = spread(table).coalesce(cores)
    near, both, w.alone, own_q = _total(blocks, w, 4, lambda w, batches: _first(w, query, D._read(batches)))
    own = (w.length > 0).astype(float)
    has = w.near(own) > 0.5  # a neighbour with a vector: counts are exact, near's sums may be off 0 by their rounding
    w.factors = D._factors(own, np.where(has, near + w.near(w.alone), 0.0), both, alpha)
    own_q = w.factors[0] * own_q + w.factors[1] * w.near(own_q)

    own = np.maximum(own, has)
    has = w.near(own) > 0.5
    count = w.classes.count
    turns = spark.range(0, cores, 1, cores)
    near, both = _total(blocks, w, 2, lambda w, batches: _second(w, D._read(batches))) + _total(turns, w, 2, lambda w, batches: _lone(w, [d for b in batches for k in b["id"].to_pylist() for d in range(k, count, cores)]))
    a, b = D._factors(own, np.where(has, near, 0.0), both, alpha)
    similar, degree = a * own_q + b * w.near(own_q), np.rint(w.near(np.ones(w.notes)))
    on = similar > 0
    central = degree[on] / max(degree.max(initial=0), 1)
    found = pa.table({"note_id": pa.array(w.ids[on], pa.int64()), "similarity": similar[on], "centrality": pa.array(central, mask=central == 0)})
    with swept(spark):
        return cut(spark.createDataFrame(found), "similar")
