"""Languages of documents and of their segments.

The model is averaged hashed subword embeddings with a linear softmax: every character 1-, 2- and 3-gram of
the text (NFKC, lower case) is hashed into one of 2**16 rows of an embedding table, the rows are averaged, and a linear
layer turns the average into a language. Table and layer are trained together by stochastic gradient descent in numpy,
on a bounded sample of labelled texts; rows that the first model firmly contradicts (wrong labels) are left out of the
second's training. Documents are held out whole, with all of their rows, rightly labelled or not: they give the temperature that calibrates the confidence, together with the share of wrong
labels among them, and the rejection threshold, the least confidence above which the model meets the labels as often, to the share asked for, as in its surer half.

Being linear, table and layer fold into one table of a score per n-gram and language, so a text is scored by lookups
and a sum: additive, in blocks of fixed size, over the whole text however long it is. Scoring is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
BLOCK = 1 << 20
SAMPLE_ROWS = 3000
SAMPLE_SEGMENTS = 700
_BREAK = re.compile(r"\n\s*\n")
_OTHER = re.compile(r"[\W\d_]+")
_M2, _M3, _M4, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(32 - BITS)


@cache
def letter_table() -> np.ndarray:
    """For each code point whether its category is L."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def segments(text: str | None, least: int = 40) -> list[tuple[int, int, str]]:
    """(number, letters, piece) of the counted segments: those with enough letters that are no code or front matter."""
    if not text:
        return []
    table = letter_table()
    out = []
    for k, piece in enumerate(_BREAK.split(text)):
        if len(piece) >= least and not piece.startswith(("```", "---")) and (n := int(table[code_points(piece)].sum())) >= least:
            out.append((k, n, piece))
    return out


def folded(text: str) -> str:
    """What is read of a text: NFKC, lower case, each run of other signs and digits one space."""
    return _OTHER.sub(" ", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def features(c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of the 1-grams, 2-grams and 3-grams that begin at each place of the code points."""
    one = (c * _M4) >> _SHIFT
    a = c[:-1] * _M2 + c[1:]
    two = (a * _M3) >> _SHIFT
    three = ((a[:-1] * _M3 + c[2:]) * _M2) >> _SHIFT
    return one, two, three


def _bags(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        out.append(np.concatenate(features(code_points(folded(t)))).astype(np.int64))
    return out


@dataclass
class LanguageModel:
    """scores: what each n-gram row adds for each language; the mean over a text's n-grams, divided by the temperature, goes into the softmax."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    wrong_labels: float = 0.0
    #: of the held-out rows by confidence: (from, to, rows, mean confidence, share whose label the model gives)
    reliability: list[tuple[float, float, int, float, float]] = field(default_factory=list)

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row for each text; a text of under two characters gets the bias."""
        if not texts:
            return np.empty((0, len(self.languages)))
        texts = [folded(t) for t in texts]
        c = code_points("\n\n\n".join(texts))
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 3) - 3
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        of = np.repeat(np.arange(len(texts), dtype=np.int32), np.r_[lengths[:-1] + 3, lengths[-1:]])
        for at in range(0, len(c), BLOCK):
            part = c[at : at + BLOCK + 2]
            for n, rows in enumerate(features(part), 1):
                rows = rows[:BLOCK]
                own = of[at : at + len(rows)]
                inside = np.arange(at, at + len(rows)) + n <= ends[own]
                rows, own = rows[inside], own[inside]
                if len(rows):
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    sums[own[starts]] += np.add.reduceat(self.scores[rows], starts, axis=0, dtype=np.float64)
                    counts[own[starts]] += np.diff(np.r_[starts, len(own)])
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its calibrated confidence."""
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p = p / p.sum(axis=1, keepdims=True) if len(z) else p
        return p.argmax(axis=1) if len(z) else np.empty(0, np.int64), p.max(axis=1) if len(z) else np.empty(0)


def _descend(bags: list[np.ndarray], labels: np.ndarray, k: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent on the cross entropy, in batches of 16 texts, with a falling step."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (1 << BITS, dim))
    layer, bias = rng.normal(0, 0.3, (dim, k)), np.zeros(k)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 16)):
            rows = np.concatenate([bags[i] for i in at])
            sizes = np.array([len(bags[i]) for i in at])
            mean = np.add.reduceat(table[rows], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p /= len(at)
            back = (p @ layer.T) / sizes[:, None]
            layer -= step * mean.T @ p
            bias -= 0.1 * step * p.sum(axis=0)
            u, inverse = np.unique(rows, return_inverse=True)
            of = np.repeat(np.arange(len(at)), sizes)
            # how often each text holds each n-gram row, then one product: the sum of the gradients by row
            held = np.bincount(inverse * len(at) + of, minlength=len(u) * len(at)).reshape(len(u), len(at))
            table[u] -= step * 20 * (held @ back)
    return table, layer, bias


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature and the share of wrong labels under which held-out logits give their labels best.

    A label is the text's language, or with the share of wrong labels any other. One row more stands in whose language the model gets wrong by a middling margin, so a model
    without errors isn't certain of everything.
    """
    k = z.shape[1]
    if k < 2 or not len(z):
        return 1.0, 0.0
    order = np.argsort(z, axis=1)
    rows = np.arange(len(z))
    middle = np.argsort(z[rows, order[:, -1]] - z[rows, order[:, -2]])[len(z) // 2]
    z, y = np.vstack([z, z[middle]]), np.r_[y, order[middle, -2]]
    doubtful = np.arange(len(z)) == len(z) - 1
    best = (np.inf, 1.0, 0.0)
    for t in np.geomspace(0.002, 5, 60):
        q = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        own = (q / q.sum(axis=1, keepdims=True))[np.arange(len(z)), y]
        for wrong in (0.0, 0.002, 0.005, *np.arange(0.01, 0.31, 0.01)):
            p = np.where(doubtful, own, (1 - wrong) * own + wrong * (1 - own) / (k - 1))
            best = min(best, (float(-np.log(np.maximum(p, 1e-300)).mean()), float(t), float(wrong)))
    return best[1], best[2]


def train(texts: list[str], labels: list[str], documents: list[int] | None = None, dim: int = 10, epochs: int = 10, rate: float = 1.0, window: int = 300, precision: float = 0.99, seed: int = 7) -> LanguageModel:
    """Fit a model on labelled texts of at least two characters, some of whose labels may be wrong.

    A fifth of the documents (``documents``: the one of each text; else each is its own) is held out for the temperature, the rejection threshold and the reliability. ``window`` characters from the
    middle of each text are trained on; scoring reads whole texts. With no usable text at all a ValueError is raised.
    """
    rows = [(t, y, d) for t, y, d in zip(texts, labels, documents or range(len(texts))) if t and len(t) >= 3 and y]
    if not rows:
        raise ValueError("no labelled text to train on")
    languages = sorted({y for _, y, _ in rows})
    number = {y: i for i, y in enumerate(languages)}
    mid = [t[max(0, len(t) // 2 - window // 2) :][:window] for t, _, _ in rows]
    bags, y = _bags(mid), np.array([number[v] for _, v, _ in rows])
    _, document = np.unique(np.array([d for _, _, d in rows]), return_inverse=True)
    held = (np.random.default_rng(seed).random(document.max() + 1) < 0.2)[document]
    if held.all() or not held.any() or len(rows) < 20:
        held[:] = False
    keep = ~held

    def model(keep: np.ndarray) -> LanguageModel:
        at = np.flatnonzero(keep)
        table, layer, bias = _descend([bags[i] for i in at], y[at], len(languages), dim, epochs, rate, seed)
        return LanguageModel(languages, (table @ layer).astype(np.float32), bias.astype(np.float64))

    m = model(keep)
    got, sure = m.predict(mid)
    wrong = keep & (got != y) & (sure > 0.5)
    if wrong.any() and len(np.unique(y[keep & ~wrong])) == len(np.unique(y)):
        m = model(keep & ~wrong)
    if held.any():
        at = np.flatnonzero(held)
        m.temperature, m.wrong_labels = calibrated(m.logits([mid[i] for i in at]), y[at])
        got, sure = m.predict([mid[i] for i in at])
        agreed = got == y[at]
        order = np.argsort(-sure)
        # of labels that are wrong in part the model can only meet the others: those of its surer half that it meets stand for all it could
        right = np.cumsum(agreed[order]) / np.arange(1, len(at) + 1) / max(agreed[order][: max(1, len(at) // 2)].mean(), 1e-9)
        good = np.flatnonzero(right >= precision)
        # never below an even chance
        m.reject_below = max(0.5, float(sure[order][good[-1]]) if len(good) and good[-1] + 1 < len(at) else 0.0)
        edges = [0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0 + 1e-9]
        for low, high in zip(edges, edges[1:]):
            own = (sure >= low) & (sure < high)
            if own.any():
                m.reliability.append((low, min(high, 1.0), int(own.sum()), float(sure[own].mean()), float(agreed[own].mean())))
    return m


def labelled_sample(documents: DataFrame, id_column: str, text: str, language: Column, rows: int = SAMPLE_ROWS, most: int = SAMPLE_SEGMENTS) -> tuple[list[str], list[str], list[int]]:
    """Segments of at most ``rows`` labelled documents, those with the least hash of their id, their labels, and the document of each: at most ``most`` of a label and four of a document."""
    usable = documents.select(F.col(text).alias("text"), language.alias("language"), F.xxhash64(id_column).alias("h")).where("language is not null and text is not null and length(text) >= 40")
    # hashes are spread evenly: below this bound lie about twice as many as are wanted, so what reaches the driver doesn't grow with the number of tasks
    share = min(1.0, 2.0 * rows / max(1, documents.select(language.alias("language")).where("language is not null").count()))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    picked = usable.where(F.col("h") <= F.lit(bound)).orderBy("h", "text").limit(rows).select("text", "language").collect()
    texts, labels, own, have = [], [], [], Counter()
    for i, (t, y) in enumerate(picked):
        for _, _, piece in segments(t)[:4]:
            if have[y] < most:
                have[y] += 1
                texts.append(piece)
                labels.append(y)
                own.append(i)
    return texts, labels, own


def detect_languages(df: DataFrame, id_column: str, text: str, model: LanguageModel, named: str | None = None) -> DataFrame:
    """id, segment_no, lang, confidence, accepted, letters, named: a row for each counted segment, and one with segment_no -1 for each
    text that has any, whose language is the one with most letters (ties: the first by name) and whose confidence is that share
    of letters times the segments' mean confidence. ``named`` is passed through. Null and empty texts and those without a counted segment give no
    rows; repeated rows come out repeatedly; the id keeps its type and other columns are not read.
    """
    kind = df.schema[id_column].dataType.simpleString()
    m = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(at, 500)
                row, number, letters, texts = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for k, n, piece in segments(t):
                        row.append(i), number.append(k), letters.append(n), texts.append(piece)
                if not row:
                    continue
                lang, sure = m.predict(texts)
                row, number, letters = map(np.array, (row, number, letters))
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                doc = np.cumsum(np.r_[False, row[1:] != row[:-1]])
                share = np.zeros((len(starts), len(m.languages)))
                np.add.at(share, (doc, lang), letters)
                best = share.argmax(axis=1)
                mean = np.zeros(len(starts))
                np.add.at(mean, doc, np.where(lang == best[doc], sure * letters, 0))
                total = np.add.reduceat(letters, starts)
                r = np.r_[row, row[starts]]
                conf = np.r_[sure, mean / total]
                names = pa.array(m.languages, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(r)),
                        pa.array(np.r_[number, np.full(len(starts), -1)], pa.int64()),
                        names.take(pa.array(np.r_[lang, best])),
                        pa.array(conf, pa.float64()),
                        pa.array(conf >= m.reject_below, pa.bool_()),
                        pa.array(np.r_[letters, total], pa.int64()),
                        part.column(2).take(pa.array(r)),
                    ],
                    names=["id", "segment_no", "lang", "confidence", "accepted", "letters", "named"],
                )

    given = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"), (F.col(named) if named else F.lit(None)).cast("string").alias("named"))
    return given.mapInArrow(score, f"id {kind}, segment_no bigint, lang string, confidence double, accepted boolean, letters bigint, named string")
