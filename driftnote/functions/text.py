"""Text as columns: normalising, blocks, snippets, links, tags, shingles, all JVM-side; only the scan for the words of lexicons is an Arrow function."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]+"
WORD_BREAK = r"[^\p{L}\p{N}_]+"


def normalized(text: Column, link: str = "target") -> Column:
    """Without front matter, code fences, embeds and URLs; ``[[target|alias]]`` becomes its target, its alias where link is ``alias``, or the target
    without heading where it is ``page``. ``alias`` and ``page`` collapse white space too."""
    t = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    t = F.regexp_replace(t, r"(?s)```.*?```", "")
    t = F.regexp_replace(t, r"!\[\[.*?\]\]", "")
    if link == "alias":
        t = F.regexp_replace(t, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
        t = F.regexp_replace(t, r"\[\[([^\]|]+)\]\]", "$1")
    elif link == "page":
        t = F.regexp_replace(t, r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]", "$1")
    else:
        t = F.regexp_replace(t, r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1")
    t = F.regexp_replace(t, r"https?://\S+", "")
    return collapsed(t) if link in ("alias", "page") else t


def collapsed(text: Column) -> Column:
    """White space in runs of one, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def blocks(text: Column, least: int = 4, marks: str = r"[\n。！？!?；;]+") -> Column:
    """The normalised text split at sentence marks; pieces trimmed of space, hyphen and tab, short ones dropped."""
    pieces = F.transform(F.split(text, marks), lambda b: F.btrim(F.regexp_replace(b, SPACE, " "), F.lit(" -\t")))
    return F.filter(pieces, lambda b: F.length(b) >= least)


def snippet(text: Column, limit: int = 96) -> Column:
    """White space collapsed, cut to ``limit`` characters with an ellipsis."""
    t = collapsed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def wikilinks(text: Column) -> Column:
    """Distinct link targets (before alias and heading) in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)(?:[^\]]*)\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def hashtags(text: Column) -> Column:
    """Distinct tags that begin after white space or at the start and don't begin with a digit."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([\p{L}_][\p{L}\p{N}_/\-]*)"), 1)
    return F.array_distinct(found)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def quoted(word: str) -> str:
    """A word as a literal of Spark SQL."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(lowered: Column, lexicon: list[str]) -> Column:
    """Whether lower-cased text holds any of the words. The lexicon is a folded literal that a small loop runs over: a chain of
    comparisons would grow the generated code past what the JVM compiles."""
    words = F.expr("array(" + ", ".join(quoted(w.lower()) for w in dict.fromkeys(lexicon)) + ")")
    return F.exists(words, lambda w: F.contains(lowered, w))


def matched(lowered: Column, lexicon: list[str]) -> Column:
    """The words that lower-cased text holds, distinct, in the lexicon's order."""
    words = F.expr("array(" + ", ".join(f"named_struct('l', {quoted(w.lower())}, 'w', {quoted(w)})" for w in dict.fromkeys(lexicon)) + ")")
    return F.transform(F.filter(words, lambda w: F.contains(lowered, w["l"])), lambda w: w["w"])


@lru_cache(maxsize=32)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, w in enumerate(words):
        a.add_word(w, k)
    a.make_automaton()
    return a


def found(lowered: Column, *lexicons: list[str]) -> Column:
    """The words of the lexicons that lower-cased text holds, lower-cased and distinct; none of null.

    One automaton of all the words runs once over each text, in an Arrow function: as expressions every word is a scan of its own, and a pattern of alternatives tries them all at every place.
    ``held`` and ``holds`` then look single lists up in what was found, which has to be a column of its own (``tables.bound``).
    """
    words = tuple(dict.fromkeys(w.lower() for x in lexicons for w in x))

    @F.arrow_udf("array<string>")
    def scan(v: pa.Array) -> pa.Array:
        search = _automaton(words).iter
        hits = [{k for _, k in search(t)} if t else () for t in v.to_pylist()]
        offsets = np.zeros(len(hits) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, hits), np.int32, len(hits)), out=offsets[1:])
        codes = pa.array(np.fromiter(chain.from_iterable(hits), np.int32, int(offsets[-1])))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(words, pa.string()).take(codes))

    return scan(lowered)


def holds(words: Column, lexicon: list[str]) -> Column:
    """Whether any of the lexicon is among the found words."""
    return F.arrays_overlap(words, F.expr("array(" + ", ".join(quoted(w) for w in dict.fromkeys(w.lower() for w in lexicon)) + ")"))


def held(words: Column, lexicon: list[str]) -> Column:
    """The lexicon's words that are among the found ones, distinct, in the lexicon's order and spelling."""
    each = F.expr("array(" + ", ".join(f"named_struct('l', {quoted(w.lower())}, 'w', {quoted(w)})" for w in dict.fromkeys(lexicon)) + ")")
    hits = F.transform(F.filter(each, lambda w: F.array_contains(words, w["l"])), lambda w: w["w"])
    return F.when(holds(words, lexicon), hits).otherwise(F.expr("cast(array() as array<string>)"))  # most texts hold no word of most lists


def specificity(text: Column, number: float = 0.12, upper: float = 0.10, symbol: float = 0.12, symbols: list[str] | None = None) -> Column:
    """How much a text names: numbers, words in capitals and symbols, capped at 1."""
    from ..lexicon import SYMBOLS

    capitals = F.size(F.filter(words(text), lambda w: F.rlike(w, F.lit("^[A-Z]{2,}$"))))
    signs = F.lit(0)
    for s in symbols or SYMBOLS:
        signs = signs + F.contains(text, F.lit(s)).cast("int")
    return F.least(F.regexp_count(text, F.lit(r"[0-9]+(?:\.[0-9]+)?")) * number + capitals * upper + signs * symbol, F.lit(1.0))


def cjk_shingles(text: Column, least: int = 2, most: int = 3, whole: int = 4) -> Column:
    """The n-grams of each run of Han characters; runs of up to ``whole`` characters come as a whole too, before their n-grams."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), 1)

    nothing = F.array().cast("array<string>")

    def of(run: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))
        return F.when(F.length(run) >= n, cut).otherwise(nothing)

    def grams(run: Column) -> Column:
        return F.concat(F.when(F.length(run) <= whole, F.array(run)).otherwise(nothing), *[of(run, n) for n in range(least, most + 1)])

    return F.flatten(F.transform(runs, grams))


def named_terms(text: Column) -> Column:
    """The n-grams of 2 to 6 of each run of Han characters but generic ones, and Latin phrases of up to four words, cleaned of signs at their ends; repeated as they occur."""
    from ..lexicon import GENERIC, GENERIC_PIECES

    generic = F.expr("array(" + ", ".join(quoted(w) for w in GENERIC) + ")")
    han = F.filter(cjk_shingles(text, 2, 6, 0), lambda t: ~F.array_contains(generic, t) & ~F.rlike(t, F.lit("|".join(GENERIC_PIECES))))
    latin = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_+\-]*(?:\s+[A-Za-z][A-Za-z0-9_+\-]*){0,3})"), 1)
    latin = F.transform(latin, lambda t: F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit("-_ ")))
    return F.concat(han, F.filter(latin, lambda t: F.length(t) >= 2))


def slot_tokens(text: Column, stop: list[str]) -> Column:
    """Lower-cased words, the n-grams of 2 to 4 of each run of Han characters with runs of up to 4 whole, and numbers with their unit; without stop words."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}]+)"), 1)
    words_ = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_+\-]+)"), 1), lambda w: F.lower(w))
    units = F.transform(F.regexp_extract_all(text, F.lit(r"(?iu)([0-9]+(?:\.[0-9]+)?\s*(?:mV|V|Hz|kHz|MHz|Ω|ohm|欧姆|倍|%))"), 1), lambda u: F.lower(F.replace(u, F.lit(" "), F.lit(""))))
    every = F.concat(words_, F.filter(runs, lambda r: F.length(r) <= 4), cjk_shingles(text, 2, 4, 0), units)
    listed = F.expr("array(" + ", ".join(quoted(w) for w in stop) + ")")
    return F.filter(every, lambda t: ~F.array_contains(listed, t))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points."""
    return F.aggregate(
        F.split(text, ""), F.lit(2166136261).cast("bigint"), lambda h, c: F.when(c == "", h).otherwise((h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    )
