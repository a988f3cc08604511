"""Test items in training text, by q-gram lemma filtering and banded alignment.

A passage of ``run`` characters of an item that occurs in a document with at most ``edits`` edits leaves at least
``run + 1 - q - edits * q`` of its q-grams unharmed (the q-gram lemma), all on diagonals (document position minus
item position) that differ by at most ``edits``. So every document's q-grams are looked up among those of all
items; hits are counted in overlapping bands of diagonals, as wide as the edits allow; stretches of a band that reach the bound are
retained, and verified by a banded alignment of the stretch. Positions are those of the text keys.

The items are a stated query set of bounded size (the size is checked); their q-gram index goes to every task, in
blocks of items if it is larger than a block, each with a scan of its own. Documents are read whole, once a block, without a shuffle; of the corpus nothing is sent
to the driver, and only documents with a retained stretch leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.keys import text_key

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITMAP = 22
BLOCK_CHARS = 2_000_000
MAX_ITEM_CHARS = 50_000_000


def rolling(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points that begin at each place, by doubling."""
    c = c.astype(np.uint64) + np.uint64(1)
    powers, hashes, n = {1: _BASE}, {1: c}, 1
    while n * 2 <= q:
        hashes[n * 2] = hashes[n][: max(0, len(hashes[n]) - n)] * powers[n] + hashes[n][n:]
        powers[n * 2] = np.uint64(int(powers[n]) ** 2 % 2**64)
        n *= 2
    out, have = hashes[n], n
    for k in sorted(hashes, reverse=True):
        while have + k <= q:
            out = out[: max(0, len(out) - k)] * powers[k] + hashes[k][have : have + max(0, len(out) - k)]
            have += k
    return out


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class ItemIndex:
    """The q-grams of some items: their hashes in order, and the item and place of each."""

    keys: list[str]
    ids: list[int]
    q: int

    def __post_init__(self) -> None:
        grams = [rolling(_codes(k), self.q) for k in self.keys]
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order].astype(np.int64), at[order].astype(np.int64)
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[(self.hash >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in the item) of every q-gram of the code points that some item has."""
        h = rolling(c, self.q)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITMAP)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        place = np.repeat(at, n)
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return place, self.item[k], self.at[k]


def longest_runs(group: np.ndarray, diagonal: np.ndarray, place: np.ndarray, q: int) -> dict[int, int]:
    """For each group the longest run of equal characters that its q-gram hits make on one diagonal."""
    order = np.lexsort((place, diagonal, group))
    g, d, p = group[order], diagonal[order], place[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    starts = np.flatnonzero(new)
    out: dict[int, int] = {}
    for k, n in zip(g[starts].tolist(), np.diff(np.r_[starts, len(g)]).tolist()):
        out[k] = max(out.get(k, 0), n + q - 1)
    return out


def stretches(group: np.ndarray, diagonal: np.ndarray, place: np.ndarray, run: int, edits: int, q: int) -> list[tuple[int, int, int, int, int]]:
    """(group, first diagonal, last diagonal, first place, last place) of the stretches that meet the q-gram bound in some band.

    Bands are ``edits + 1`` diagonals wider than their distance, so any ``edits + 1`` neighbouring diagonals lie in one.
    """
    bound = run + 1 - q - edits * q
    if bound < 1:
        raise ValueError("run is too short for so many edits and so long a q-gram")
    step = edits + 1
    band = diagonal // step
    both = np.r_[band, band - 1]  # each band has the diagonals of two steps
    g, d, p = np.r_[group, group], np.r_[diagonal, diagonal], np.r_[place, place]
    order = np.lexsort((d, p, both, g))
    g, b, d, p = g[order], both[order], d[order], p[order]
    # one hit for each place of a band: q-grams repeated within the band don't count twice
    once = np.ones(len(g), bool)
    once[1:] = (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1])
    g, b, d, p = g[once], b[once], d[once], p[once]
    if len(g) < bound:
        return []
    end = np.arange(len(g) - bound + 1) + bound - 1
    first = end - bound + 1
    ok = (g[first] == g[end]) & (b[first] == b[end]) & (p[end] - p[first] <= run + edits - q)
    out: list[list[int]] = []
    for f, e in zip(first[ok].tolist(), end[ok].tolist()):
        if out and out[-1][0] == g[f] and out[-1][5] == b[f] and p[f] <= out[-1][4]:
            out[-1][4] = int(p[e])
            out[-1][1], out[-1][2] = min(out[-1][1], int(d[f : e + 1].min())), max(out[-1][2], int(d[f : e + 1].max()))
        else:
            out.append([int(g[f]), int(d[f : e + 1].min()), int(d[f : e + 1].max()), int(p[f]), int(p[e]), int(b[f])])
    return [tuple(x[:5]) for x in out]


def banded(pairs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[np.ndarray]:
    """For each (a, b, low, high): for each character of ``a`` whether a cheapest alignment with ``b`` edits there.

    The alignment stays within the diagonals low..high (place in b minus place in a), and the ends of ``b`` are free: what stands before and
    after the aligned part costs nothing. All pairs advance together, a character of ``a`` at a time.
    """
    r, n = len(pairs), max((len(p[0]) for p in pairs), default=0)
    w, big = max((p[3] - p[2] + 1 for p in pairs), default=1), 1 << 20
    lengths = np.array([len(p[0]) for p in pairs])
    ends = np.array([len(p[1]) for p in pairs])[:, None]
    low = np.array([p[2] for p in pairs])[:, None]
    used = np.arange(w)[None, :] <= np.array([p[3] - p[2] for p in pairs])[:, None]
    x = np.zeros((r, n), np.uint32)
    y = np.zeros((r, max(1, int(ends.max(initial=0)))), np.uint32)
    for i, (a, b, _, _) in enumerate(pairs):
        x[i, : len(a)] = a
        y[i, : len(b)] = b
    rows = np.arange(r)[:, None]
    j0 = np.arange(w)[None, :] + low
    cost = np.where((j0 >= 0) & (j0 <= ends) & used, 0, big)
    last = cost.copy()
    moves = np.zeros((n + 1, r, w), np.int8)
    for i in range(1, n + 1):
        j = i + j0
        inside = (j >= 0) & (j <= ends) & used
        same = inside & (j >= 1) & (y[rows, np.clip(j - 1, 0, y.shape[1] - 1)] == x[:, i - 1 : i])
        diagonal = np.where(j >= 1, cost + ~same, big)
        up = np.full_like(cost, big)
        up[:, :-1] = cost[:, 1:] + 1
        best = np.where(inside, np.minimum(diagonal, up), big)
        move = np.where(up < diagonal, 2, np.where(same, 0, 1)).astype(np.int8)
        for k in range(1, w):
            less = inside[:, k] & (best[:, k - 1] + 1 < best[:, k])
            best[less, k] = best[less, k - 1] + 1
            move[less, k] = 3
        moves[i], cost = move, best
        over = lengths == i
        last[over] = cost[over]
    edited = np.zeros((r, n), bool)
    at, k, every = lengths.copy(), last.argmin(axis=1), np.arange(r)
    while (at > 0).any():
        live = every[at > 0]
        m = moves[at[live], live, k[live]]
        edited[live, at[live] - 1] |= m != 0
        k[live] += (m == 2).astype(np.int64) - (m == 3)
        at[live[m != 3]] -= 1
    return [edited[i, :size] for i, size in enumerate(lengths)]


def merged(found: list[tuple[int, int, int, int, int]], reach: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches of one group on neighbouring diagonals that overlap become one: bands overlap, so most are found twice."""
    out: list[list[int]] = []
    for g, low, high, first, last in sorted(found, key=lambda s: (s[0], s[3], s[1])):
        for o in reversed(out):
            if o[0] != g:
                out.append([g, low, high, first, last])
                break
            if first <= o[4] + reach and low <= o[2] + reach and high >= o[1] - reach and max(high, o[2]) - min(low, o[1]) <= 4 * reach:
                o[1], o[2], o[4] = min(o[1], low), max(o[2], high), max(o[4], last)
                break
        else:
            out.append([g, low, high, first, last])
    return [tuple(o) for o in out]


def verified(found: list[tuple[str, str, int, int, int, int]], run: int, edits: int, q: int) -> list[tuple[int, int, int] | None]:
    """For each (item, text, low, high, first, last): (start in the item, end in the item, edits) of the longest part of the stretch of which every
    ``run`` characters have at most ``edits`` edits, if any."""
    pairs, starts = [], []
    for item, text, low, high, first, last in found:
        i0, i1 = max(0, first - high - edits), min(len(item), last - low + q + edits)
        t0, t1 = max(0, i0 + low - edits), min(len(text), i1 + high + edits)
        pairs.append((_codes(item[i0:i1]), _codes(text[t0:t1]), low - edits + i0 - t0, high + edits + i0 - t0))
        starts.append(i0)
    marks: list[np.ndarray] = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pairs[order[end]][0]) * 12 <= 20_000_000:
            end += 1
        for k, e in zip(order[at:end], banded([pairs[k] for k in order[at:end]])):
            marks[k] = e
        at = end
    out: list[tuple[int, int, int] | None] = []
    for i0, edited in zip(starts, marks):
        sums = np.r_[0, np.cumsum(edited)]
        ok = np.flatnonzero(sums[run:] - sums[:-run] <= edits) if len(edited) >= run else []
        if not len(ok):
            out.append(None)
            continue
        best = max(np.split(ok, np.flatnonzero(np.diff(ok) > 1) + 1), key=len)
        s, e = int(best[0]), int(best[-1]) + run
        out.append((i0 + s, i0 + e, int(sums[e] - sums[s])))
    return out


def _search(keys: list[str | None], index: ItemIndex, run: int, edits: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(row, item, item start, item end, place in the text, edits, longest exact run)."""
    at = 0
    while at < len(keys):
        end, size = at, 0
        while end < len(keys) and (end == at or size + len(keys[end] or "") <= BLOCK_CHARS):
            size += len(keys[end] or "") + 1
            end += 1
        part = [k or "" for k in keys[at:end]]
        starts = np.r_[0, np.cumsum([len(k) + 1 for k in part])]
        place, item, where = index.hits(_codes("\n".join(part)))  # keys hold no line end, so no q-gram spans two
        if len(place):
            row = np.searchsorted(starts, place, "right") - 1
            group = row * len(index.keys) + item
            local = place - starts[row]
            diagonal = local - where
            runs = longest_runs(group, diagonal, local, index.q)
            best: dict[int, tuple[int, int, int, int]] = {}
            kept = merged(stretches(group, diagonal, local, run, edits, index.q), edits + 1)
            pairs = [(index.keys[g % len(index.keys)], part[g // len(index.keys)], *rest) for g, *rest in kept]
            for (g, _, _, first, _), found in zip(kept, verified(pairs, run, edits, index.q)):
                if found and (g not in best or found[1] - found[0] > best[g][1] - best[g][0]):
                    best[g] = (*found, first)
            for g, (s, e, n, first) in best.items():
                r, k = divmod(g, len(index.keys))
                yield at + r, k, s, e, first, n, runs[g]
        at = end


def leaked_passages(documents: DataFrame, id_column: str, text: str, items: list[tuple[int, str]], run: int = 40, edits: int = 1, q: int = 8) -> DataFrame:
    """id, item_id, item_start, item_end, text_start, edits, exact_run: a row for each document and item of which a passage leaked.

    A passage has at least ``run`` characters of the item's text key, any ``run`` of them with at most ``edits`` edits, in the document's text
    key; item_start, item_end bound the longest, text_start is where it is met, exact_run the longest run of equal
    characters. Null and empty texts, and items under ``run`` characters, have none; repeated rows come out repeatedly; the id keeps its type.
    """
    # an item shorter than a passage can't leak one
    known = [(int(i), k) for i, t in items if (k := text_key(t)) and len(k) >= run]
    if sum(len(k) for _, k in known) > MAX_ITEM_CHARS:
        raise ValueError(f"more than {MAX_ITEM_CHARS} characters of items: call it for parts of them and union the results")
    kind = documents.schema[id_column].dataType.simpleString()
    blocks: list[list[tuple[int, str]]] = [[]]
    for x in known:
        if sum(len(k) for _, k in blocks[-1]) > BLOCK_CHARS:
            blocks.append([])
        blocks[-1].append(x)

    def scan(index: ItemIndex) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [text_key(t) for t in batch.column(1).to_pylist()]
                found = [(r, index.ids[k], s, e, p, n, m) for r, k, s, e, p, n, m in _search(keys, index, run, edits)] if index.keys else []
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(columns[0])), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                        names=["id", "item_id", "item_start", "item_end", "text_start", "edits", "exact_run"],
                    )

        return documents.select(id_column, text).mapInArrow(search, f"id {kind}, item_id bigint, item_start bigint, item_end bigint, text_start bigint, edits bigint, exact_run bigint")

    # a scan for each block, so no task holds more than one
    return reduce(DataFrame.unionAll, [scan(ItemIndex([k for _, k in b], [i for i, _ in b], q)) for b in blocks])
