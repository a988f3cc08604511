"""Filling containers of fixed capacity with texts measured in tokens.

Pattern packing by non-negative least squares. The sizes of all pieces form a histogram with at most ``capacity`` entries, whatever
the number of texts. Patterns of up to four bins of sizes that fill a container are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded down. A pattern takes the greatest sizes there are of its bins, and for the last two of them a pair that fills the container to the last token;
one that can't be filled so any more is left. The fit is repeated on what remains until no pattern is filled; what the patterns don't cover is packed by best fit, decreasing, a whole run of equal sizes at a time.
As no container of a pattern has room left, they cost nothing against best fit alone. So the plan is made on the driver from the bounded histogram
alone, in time that doesn't grow with the texts. Each piece is then numbered within its size, and looks its container up in the plan.

Scale: counting tokens is a scan; the numbering sorts within (size, salt), so one size may hold a third of all texts; the plan (a few entries
for each size) goes to the tasks, and assigning is a map over the numbered pieces.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: how byte-level BPE vocabularies of this kind split text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_A_SALT = 1_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A tokenizer of a file of ranks: its encode function, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(df: DataFrame, id_column: str, text: str, capacity: int, path: str = TOKENIZER) -> DataFrame:
    """id, piece, size: the tokens of each text; a text longer than the capacity is cut into full pieces and a rest. Null texts have none.

    ``path`` is read by the driver, which sends the file along with the job: executors need not have it.
    """
    kind = df.schema[id_column].dataType.simpleString()
    df.sparkSession.sparkContext.addFile(path)
    name = path.rstrip("/").rpartition("/")[2]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            n = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(capacity, sizes[row] - piece * capacity)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(size, pa.int32())], names=["id", "piece", "size"])

    return df.where(F.col(text).isNotNull()).select(id_column, text).mapInArrow(count, f"id {kind}, piece int, size int")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets: until no column would lower it, or none does any more."""
    x, right = np.zeros(a.shape[1]), a.T @ b
    at: list[int] = []  # the passive columns, and their products with each other
    gram = np.zeros((0, 0))
    least = np.inf
    while True:
        rest = b - a @ x
        w = a.T @ rest
        w[at] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-7 * max(1.0, np.abs(b).max()) or rest @ rest >= least:
            break
        least = (rest @ rest) * (1 - 1e-12)
        cross = a[:, at].T @ a[:, j] if at else np.zeros(0)
        own = a[:, j] @ a[:, j] + 1e-9  # patterns may depend on each other
        gram = np.block([[gram, cross[:, None]], [cross[None, :], np.array([[own]])]])
        at.append(j)
        while at:
            s = np.linalg.solve(gram, right[at])
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            now, low = x[at], s <= 0
            step = (now[low] / np.maximum(now[low] - s[low], 1e-300)).min()
            now = now + step * (s - now)
            stay = np.flatnonzero(now > 1e-12)
            x[:] = 0
            at = [at[k] for k in stay]
            x[at] = now[stay]
            gram = gram[np.ix_(stay, stay)]
    return x


def patterns(bins: int, most: int = 4) -> list[tuple[int, ...]]:
    """Every multiset of up to ``most`` bins, in falling order, that adds up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def more(left: int, top: int, k: int, so_far: tuple[int, ...]) -> None:
        if left == 0:
            out.append(so_far)
        elif k:
            for b in range(min(top, left), -(-left // k) - 1, -1):
                more(left - b, b, k - 1, (*so_far, b))

    more(bins, bins, most, ())
    return out


def _fitted(left: dict[int, int], every: list[tuple[int, ...]], bins: int, width: int, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups of containers that patterns fill to the last token, taken out of ``left``: repeat counts are fitted to what is left, rounded down, and filled with sizes of the bins."""
    target = np.zeros(bins)
    for size, n in left.items():
        if n and -(-size // width) <= bins:
            target[-(-size // width) - 1] += n
    used = [p for p in every if all(target[b - 1] > 0 for b in p)]
    if not used:
        return []
    a = np.zeros((bins, len(used)))
    for j, p in enumerate(used):
        np.add.at(a[:, j], np.array(p) - 1, 1)
    repeats, groups = nnls(a, target), []

    def of(b: int, most: int, taken: Counter) -> Iterator[int]:
        """The sizes of a bin that are left, the greatest first."""
        return (x for x in range(min(b * width, most), (b - 1) * width, -1) if left.get(x, 0) > taken[x])

    for j in np.argsort(-repeats, kind="stable").tolist():
        repeat, pattern = int(repeats[j] + 1e-9), used[j]
        while repeat > 0:
            taken: Counter = Counter()
            room = capacity
            for b in pattern[:-2]:
                if (size := next(of(b, room, taken), None)) is None:
                    break
                taken[size] += 1
                room -= size
            if sum(taken.values()) < len(pattern) - 2:
                break
            # the last two together fill what is left
            pair = next(((x, room - x) for x in of(pattern[-2], room - 1, taken) if left.get(room - x, 0) > taken[room - x] + (2 * x == room)), None) if len(pattern) > 1 else None
            if pair is None:
                break
            taken.update(pair)
            n = min(repeat, *(left[x] // k for x, k in taken.items()))  # as many at once as all of them last
            for x, k in taken.items():
                left[x] -= n * k
            groups.append((tuple(sorted(taken.elements(), reverse=True)), n))
            repeat -= n
    return groups


def plan(histogram: dict[int, int], capacity: int, width: int | None = None, most: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, containers): how many containers hold pieces of these sizes. Sizes are from 1 to the capacity; the plan holds every piece.

    Where lengths leave no small pieces, filling by patterns may need more containers than best fit alone would; then the plan is that of best fit, so it never has more.
    """
    width = width or max(1, capacity // 64)
    left = {s: n for s, n in histogram.items() if n > 0}
    full = [((capacity,), left.pop(capacity))] if left.get(capacity) else []
    rest, groups = dict(left), list(full)
    bins = capacity // width
    every = patterns(bins, most)
    while fitted := _fitted(rest, every, bins, width, capacity):
        groups += fitted
    by_patterns, by_fit = _best_fit(groups, rest, capacity), _best_fit(full, left, capacity)
    return min(by_patterns, by_fit, key=lambda groups: sum(n for _, n in groups))


def _best_fit(groups: list[tuple[tuple[int, ...], int]], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The groups with what is left added, best fit, decreasing, first into the room that they leave."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for sizes, n in groups:
        rooms.setdefault(capacity - sum(sizes), []).append((sizes, n))
    for s in sorted(left, reverse=True):
        n = left[s]
        while n > 0:
            room = min((r for r, g in rooms.items() if r >= s and g), default=None)
            if room is None:
                k = min(n, capacity // s)
                full = n // k
                rooms.setdefault(capacity - k * s, []).append(((s,) * k, full))
                n -= full * k
                continue
            sizes, have = rooms[room].pop()
            k = min(n, have)
            if have > k:
                rooms[room].append((sizes, have - k))
            rooms.setdefault(room - s, []).append(((*sizes, s), k))
            n -= k
    return [g for r in sorted(rooms) for g in rooms[r]]


def _slots(groups: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (size, first rank, first container, position, start, unused), by size and first rank: who of which size goes where."""
    out, ranks, base = [], {}, 0
    for sizes, n in groups:
        start = 0
        for position, s in enumerate(sizes):
            r = ranks.get(s, 0)
            out.append((s, r, base, position, start, capacity - sum(sizes)))
            ranks[s] = r + n
            start += s
        base += n
    rows = np.array(out, np.int64).reshape(-1, 6)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def pack(pieces: DataFrame, capacity: int, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """id, piece, size, container, position, start, unused for pieces (id, piece, size).

    container counts from 0, position within it from 0, start is the first token's place and unused what the whole container leaves empty. Pieces of no
    tokens take no room: their container, position, start and unused are null. Equal rows are separate pieces; no pieces give no rows.
    """
    pieces = cut(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("size").count().collect()}  # at most capacity + 1 rows
    if any(s is None or s > capacity or s < 0 for s in histogram):
        raise ValueError("a piece has no size from 0 to the capacity")
    kind = pieces.schema["id"].dataType.simpleString()
    slots = _slots(plan({s: n for s, n in histogram.items() if s}, capacity), capacity)
    salts = max(8, -(-sum(histogram.values()) // rows_a_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each size and salt, so this window's groups have as many rows as there are salts
    offsets = salted.groupBy("size", "salt").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = (
        salted.withColumn("n", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "piece")) - 1)
        .join(offsets, ["size", "salt"])
        .select("id", "piece", "size", (F.col("n") + F.col("offset")).alias("rank"))
    )
    most = max(histogram.values(), default=0) + 1
    keys = slots[:, 0] * most + slots[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            none = size == 0
            if len(keys):
                at = np.clip(np.searchsorted(keys, size * most + rank, "right") - 1, 0, None)
                s = slots[at]
            else:
                s = np.zeros((len(size), 6), np.int64)
            values = (s[:, 2] + rank - s[:, 1], s[:, 3], s[:, 4], s[:, 5])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(v, pa.int64(), mask=none) for v in values)],
                names=["id", "piece", "size", "container", "position", "start", "unused"],
            )

    return ranked.mapInArrow(assign, f"id {kind}, piece int, size int, container bigint, position bigint, start bigint, unused bigint")
