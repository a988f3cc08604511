"""Normalised keys of terms, links and texts, as Arrow functions.

Spark has no Unicode normalisation, so these run in Python, over Arrow arrays:
each batch's values are dictionary-encoded first, so a spelling is worked on once
a batch however often it occurs.

* term key: NFKC, lower case, white space and invisible format characters (Cf) removed
* link key: cut at the first ``#``, ``|`` or ``^``, trimmed, what follows the last ``/``,
  without a final ``.md``, then the term key; links holding ``://`` have none
* text key: NFKC, lower case, only letters and digits
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s+")
_CUT = re.compile(r"[#|^]")
_NOT_WORD = re.compile(r"[\W_]+")


def term_key(value: str | None) -> str | None:
    """The term key of a value; None for null and for keys that come out empty."""
    if value is None:
        return None
    if value.isascii():
        return _SPACE.sub("", value.lower()) or None
    s = _SPACE.sub("", unicodedata.normalize("NFKC", value).lower())
    if not s.isprintable():
        s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    return s or None


def link_key(value: str | None) -> str | None:
    """The key that a written link refers to; None where it is no reference."""
    if value is None or "://" in value:
        return None
    s = _CUT.split(value, maxsplit=1)[0].strip().rpartition("/")[2]
    if s[-3:].lower() == ".md":
        s = s[:-3]
    return term_key(s)


def text_key(value: str | None) -> str | None:
    """Letters and digits only, NFKC, lower case; None stays None."""
    if value is None:
        return None
    return _NOT_WORD.sub("", value.lower() if value.isascii() else unicodedata.normalize("NFKC", value).lower())


def _encoded(values: pa.Array, f: Callable[[str | None], str | None]) -> tuple[np.ndarray, list[str | None]]:
    """Codes into a list of keys; -1 where the value or its key is null."""
    d = values.dictionary_encode()
    keys = [f(x) for x in d.dictionary.to_pylist()]
    codes = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ok = np.fromiter((k is not None for k in keys), bool, len(keys))
    if len(keys):
        codes = np.where((codes >= 0) & ok[codes], codes, -1)
    return codes, keys


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of a list array's elements; a null list has none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def keyed_rows(lists: pa.Array, f: Callable[[str | None], str | None]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Row number and key code of every element that has a key, in order, with the keys."""
    rows, values = flat(lists)
    codes, keys = _encoded(values, f)
    ok = codes >= 0
    return rows[ok], codes[ok], keys


def _distinct_lists(lists: pa.Array, f: Callable[[str | None], str | None]) -> pa.Array:
    """For each row the distinct keys in code-point order; an empty list where there are none."""
    rows, codes, keys = keyed_rows(lists, f)
    names = sorted({k for k in keys if k is not None})
    rank = {k: i for i, k in enumerate(names)}
    of = np.array([rank[k] if k is not None else -1 for k in keys], dtype=np.int64)
    pairs = np.unique(rows * max(1, len(names)) + of[codes]) if len(rows) else np.empty(0, np.int64)
    r, c = np.divmod(pairs, max(1, len(names)))
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(np.bincount(r, minlength=len(lists)), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names, pa.string()).take(pa.array(c)))


def term_keys(column: Column | str) -> Column:
    """array<string> -> the distinct term keys of its elements in code-point order, empty for null."""

    @F.arrow_udf("array<string>")
    def keys(v: pa.Array) -> pa.Array:
        return _distinct_lists(v, term_key)

    return keys(column)


def link_keys(column: Column | str) -> Column:
    """array<string> -> the distinct link keys of its elements in code-point order, empty for null."""

    @F.arrow_udf("array<string>")
    def keys(v: pa.Array) -> pa.Array:
        return _distinct_lists(v, link_key)

    return keys(column)


def _mapped(v: pa.Array, f: Callable[[str | None], str | None]) -> pa.Array:
    return pa.array([f(x) for x in v.to_pylist()], pa.string())


def title_key(column: Column | str) -> Column:
    """string -> its term key, null where there is none."""

    @F.arrow_udf("string")
    def key(v: pa.Array) -> pa.Array:
        return _mapped(v, term_key)

    return key(column)


def text_keys(column: Column | str) -> Column:
    """string -> its text key."""

    @F.arrow_udf("string")
    def key(v: pa.Array) -> pa.Array:
        return _mapped(v, text_key)

    return key(column)
