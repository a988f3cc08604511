"""Personal information in free text: candidate spans, boosted trees, calibrated thresholds.

1. Generators of high recall propose spans, which may overlap: written and spelled-out email addresses, runs of digits in any
   grouping, streets with house numbers in five manners, and pairs of name parts.
2. Each candidate becomes a row of format features (digits, groups, check characters, case) and context features (what stands
   left and right of it, marks of serials, batches and times).
3. Boosted regression trees on the logistic loss, trained here in numpy on texts made by ``training_texts``, score the candidates;
   a sigmoid fitted on held-out texts calibrates the scores, and each kind gets the threshold with the best held-out F1.
4. Of the candidates above their threshold the best that don't overlap become the redactions.

Texts are worked on in blocks: a block's texts are joined, full-width signs are made narrow one for one (so places stay the same),
and every generator runs once over the whole block. There is no shuffle and nothing but the small model is sent to the tasks.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "identity", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
BLOCK_CHARS = 1_000_000
_WHOLE_DIGITS, _PART_DIGITS = 25, 18  # of a run that is proposed whole; of its longest part, the 18-character number
_GAP = "\n\x00\n"

# fixed values: control letters by remainder of 23; weights and control characters of the 18-character number
_LETTERS_23 = "TRWAGMYFPDXBNJZSQVHLCKE"
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CONTROL = "10X98765432"

# Generators look for a rare anchor first and then read what stands left and right of it.
_LOCAL = r"[A-Za-z0-9](?:[\w.+\-]{0,40}[A-Za-z0-9])?"
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)"
_LATIN = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’\-]*"
_CJK = "一-鿿"
_EMAIL_ANCHOR = re.compile(r"@|[(\[{<] ?at ?[)\]}>]| at (?=[a-z0-9\-]{1,40}(?:\.| ?[(\[{<] ?dot ?[)\]}>] ?| dot )[a-z])")
_EMAIL_LEFT = re.compile(rf"{_LOCAL}\s?$", re.A)
_EMAIL_RIGHT = re.compile(rf"{_AT}[A-Za-z0-9\-]{{1,40}}(?:{_DOT}[A-Za-z0-9\-]{{1,30}}){{0,3}}", re.I | re.A)
_NUMBER = re.compile(r"\+?\(?(?:(?<=\+)|(?<=\()|(?<!\d))\d(?:(?:[ \-.]|\) ?| ?\()?\d){7,}(?:-?[A-Za-z](?![A-Za-z]))?", re.A)
_ZH_ANCHOR = re.compile(r"[路街道巷桥]\d{1,4}(?:弄\d{1,4})?号(?:\d{1,3}(?:号楼|单元|栋|幢|座))?(?:\d{1,5}室?)?", re.A)
_ZH_LEFT = re.compile(rf"(?:[{_CJK}]{{2}}[市县])?(?:[{_CJK}]{{2}}[区镇])?(?:(?![至于在到往和与市区])[{_CJK}]){{1,3}}$")
_EN = re.compile(r"\d{1,5}[a-z]? (?:[a-z0-9'’\-]+ ){1,3}(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|close|way|square)(?![a-z])\.?(?:,? (?:apt|flat|unit|suite|apartment|#)\.? ?\w{1,5})?", re.A)
_FR = re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|boulevard|chemin|allée|impasse|quai|place) [^\n,;。，；!?\d]{{2,40}}?(?=[,.。，；;!?\n]|$)(?:, \d{{5}} {_LATIN})?")
_DE_ANCHOR = re.compile(rf"\d{{1,4}} ?[A-Za-z]?, \d{{5}} {_LATIN}", re.A)
_DE_LEFT = re.compile(rf"{_LATIN}(?: {_LATIN})?\.? $")
_ES = re.compile(rf"(?:calle|avenida|paseo|plaza|camino|rua|travessa) {_LATIN}(?: {_LATIN}){{0,4}},? \d{{1,4}}(?:, \d{{1,2}}\.?\s?[ºª°](?: ?\w(?!\w))?)?")
_ES_WORDS = ("calle ", "avenida ", "paseo ", "plaza ", "camino ", "rua ", "travessa ")


def _lower(text: str) -> str:
    """Lower case, place by place: a letter whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


_MARK = re.compile(r"(?:SN|S/N|serial|batch|lot|stamp|版本|批次|序列号|流水号|时间戳|样本号|编号|日志|工单|单号|run|tag|sheet)[ :：#.]{0,3}$", re.I)
_ORDINAL = re.compile(r"[第#№]$")


def narrow(text: str) -> str:
    """Full-width signs made ASCII, place by place."""
    if text.isascii():
        return text
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = (c >= 0xFF01) & (c <= 0xFF5E)
    wide &= (c != 0xFF0C) & (c != 0xFF1B) & (c != 0xFF1A) & (c != 0xFF01) & (c != 0xFF1F)
    space = (c == 0x3000) | (c == 0xA0) | (c == 0x202F)
    if not (wide.any() or space.any()):
        return text
    c = c.copy()
    c[wide] -= 0xFEE0
    c[space] = 0x20
    return c.tobytes().decode("utf-32-le", "surrogatepass")


def name_pattern(parts: list[tuple[str, str, str]]) -> re.Pattern | None:
    """Pairs of (name_part, part_kind, script) with one family and one given name of a script, either order, for lower-cased text."""
    out = []
    edge = "A-Za-zÀ-ÖØ-öø-ÿ0-9_"
    for script in sorted({s for _, _, s in parts}):
        of = {k: "|".join(sorted({re.escape(p.lower()) for p, kind, s in parts if kind == k and s == script and p}, key=lambda x: (-len(x), x))) for k in ("family", "given")}
        if not of["family"] or not of["given"]:
            continue
        f, g = f"(?:{of['family']})", f"(?:{of['given']})"
        if script == "zh":
            out.append(rf"{f}[ ·]?{g}")
        else:
            out.append(rf"{g}[ \n]{{1,2}}{f}(?![{edge}])")
            out.append(rf"{f},? ?{g}(?![{edge}])")
    return re.compile("|".join(out)) if out else None


def resident_ok(s: str) -> bool:
    """Whether an 18-character number has the right check character."""
    return len(s) == 18 and s[:17].isdigit() and _CONTROL[sum(int(a) * w for a, w in zip(s, _WEIGHTS)) % 11] == s[17].upper()


def letter_ok(digits: str, letter: str) -> bool:
    """Whether eight digits have the right check letter."""
    return len(digits) == 8 and _LETTERS_23[int(digits) % 23] == letter.upper()


def phone_shape(s: str) -> int:
    """Which numbering plan a written number fits as a whole: 1 Chinese mobile, 2 North American, 3 British, 4 German, 5 French, 0 none."""
    d = re.sub(r"\D", "", s.replace("(0)", ""))
    plus = s.lstrip("(").startswith("+")
    if not plus and d.startswith("00"):
        plus, d = True, d[2:]
    grouped = bool(re.search(r"\d\D+\d", s))
    if plus:
        if d.startswith("86") and re.fullmatch(r"1[3-9]\d{9}", d[2:]):
            return 1
        if d.startswith("1") and re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", d[1:]):
            return 2
        if d.startswith("44") and re.fullmatch(r"[1-37]\d{8,9}", d[2:]):
            return 3
        if d.startswith("49") and re.fullmatch(r"[1-9]\d{7,10}", d[2:]):
            return 4
        if d.startswith("33") and re.fullmatch(r"[1-9]\d{8}", d[2:]):
            return 5
        return 0
    if re.fullmatch(r"(?:86)?1[3-9]\d{9}", d):
        return 1
    if re.fullmatch(r"1?[2-9]\d\d[2-9]\d{6}", d) and grouped:
        return 2
    if re.fullmatch(r"07\d{9}", d) or (grouped and re.fullmatch(r"0[12]\d{8,9}", d)):
        return 3
    if re.fullmatch(r"0[1-9]\d{8}", d):
        return 5
    if re.fullmatch(r"0[2-9]\d{8,10}", d) or re.fullmatch(r"01[5-7]\d{8,9}", d):
        return 4
    return 0


_FEATURES = (
    "email", "phone", "identity", "address", "name", "length", "digits", "groups", "plan", "check", "letter_end", "shape_324", "plus", "left_digit", "right_digit",
    "left_letter", "right_letter", "left_mark", "left_ordinal", "tld", "at_sign", "spelled", "local_length", "house", "town", "capital", "family_first", "case", "inner_digit", "street_letters",
)


def _row(kind: str, text: str, a: int, b: int) -> list[float]:
    """The features of the candidate text[a:b]."""
    s = text[a:b]
    left, right = text[max(0, a - 14) : a].rpartition("\x00")[2], text[b : b + 3].partition("\x00")[0]
    l1, r1 = left[-1:], right[:1]
    digits = sum(c.isdigit() for c in s)
    groups = re.findall(r"\d+", s)
    # a digit right beside, or one behind a single joining sign, means a longer number
    left_digit = float(bool(re.search(r"\d$", left)) or bool(re.search(r"\d[\-./]$", left)))
    right_digit = float(bool(re.match(r"\d", right)) or bool(re.match(r"[\-./]\d", right)))
    compact = re.sub(r"[^0-9A-Za-z]", "", s)
    check = tail = shape = plan = 0.0
    if kind == "identity":
        check = float(resident_ok(compact) or (len(compact) == 9 and letter_ok(compact[:8], compact[8]) if compact[:8].isdigit() and compact[8:].isalpha() else False))
        tail = float(compact[-1:].isalpha())
        shape = float(bool(re.fullmatch(r"\d{3}[\- ]\d\d[\- ]\d{4}", s)))
    if kind == "phone":
        plan = float(phone_shape(s))
    tld = at = spelled = local = 0.0
    if kind == "email":
        m = re.fullmatch(rf"({_LOCAL})({_AT})(.*)", s, re.I | re.A | re.S)
        if m:
            host = re.split(_DOT, m[3], flags=re.I)
            tld = float(len(host) > 1 and len(host[-1]) >= 2 and host[-1].isalpha())
            at, spelled, local = float("@" in m[2]), float(m[2].isspace() or m[2].strip().lower() == "at"), len(m[1])
            spelled += float(len(host) > 1 and bool(re.search(r"\sdot\s", m[3], re.I)))
    house = town = inner = street = 0.0
    if kind == "address":
        house = float(bool(re.search(r"\d", s)))
        town = float(bool(re.search(r"[市区]|\d{5} \w|(?:apt|flat|unit|suite)\.? ?\w|[ºª°]|室|号楼|单元", s, re.I)))
        words = re.findall(r"[A-Za-z0-9'’\-]+", s)
        inner = float(any(w.isdigit() for w in words[1:3])) if s[:1].isdigit() else 0.0
        street = float(max((len(w) for w in words if w.isalpha()), default=0))
    capital = float(bool(re.search(r"(?:^|[ (])[A-ZÀ-Þ]", s)))
    return [
        *(float(kind == k) for k in KINDS), len(s), digits, len(groups), plan, check, tail, shape, float("+" in s[:2]), left_digit, right_digit,
        float(l1.isascii() and l1.isalpha()), float(r1.isascii() and r1.isalpha()), float(bool(_MARK.search(left))), float(bool(_ORDINAL.search(left)) or bool(re.search(r"第\w{0,2}$", left))),
        tld, at, spelled, local, house, town, capital, float("," in s), float(s.isupper()) - float(s.islower()), inner, street,
    ]


def _identity_shape(s: str) -> bool:
    """Whether a written number is an identity number by its grouping or its check character."""
    compact = re.sub(r"[^0-9A-Za-z]", "", s)
    return bool(re.fullmatch(r"\d{3}[\- ]\d\d[\- ]\d{4}", s)) or resident_ok(compact) or (len(compact) == 9 and compact[:8].isdigit() and compact[8].isalpha() and letter_ok(compact[:8], compact[8]))


def _numbers(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """The candidates of the run of numbers text[a:b]: the whole, up to _WHOLE_DIGITS, and from each group on as many groups as a plan has digits, where the shape
    or check of a kind fits. That is a bounded number for each group, however long the run is."""
    s = text[a:b]
    tail = len(s) - len(re.sub(r"-?[A-Za-z]$", "", s))
    groups = [(a + x.start(), a + x.end(), sum(c.isdigit() for c in x[0])) for x in re.finditer(r"[+(]*\d+\)?", s)]
    out = []
    if whole := sum(n for _, _, n in groups) <= _WHOLE_DIGITS:
        for e in [b, b - tail] if tail else [b]:
            out += [(a, e, "phone"), (a, e, "identity")]
    if len(groups) == 1:
        return out
    resident = whole and resident_ok(re.sub(r"[^0-9A-Za-z]", "", s))
    as_phone = not resident and not (whole and phone_shape(s))  # a part of a number that fits as a whole is none
    for i, (x, _, _) in enumerate(groups):
        digits = 0
        for j in range(i, len(groups)):
            digits += groups[j][2]
            if digits > _PART_DIGITS:
                break
            if digits < 8 or (whole and (i, j) == (0, len(groups) - 1)):
                continue
            y = groups[j][1]
            if as_phone and phone_shape(text[x:y]):
                out.append((x, y, "phone"))
            if resident:
                continue
            out += [(x, e, "identity") for e in ([y, b] if tail and j == len(groups) - 1 else [y]) if _identity_shape(text[x:e])]
    return out


def candidates(text: str, names: re.Pattern | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every proposed span of a narrowed text; they may overlap."""
    out: list[tuple[int, int, str]] = []
    low = _lower(text)
    for m in _EMAIL_ANCHOR.finditer(low):
        a = m.start()
        left = _EMAIL_LEFT.search(text, max(0, a - 44), a)
        start = left.start() if left else a
        if not left:
            continue
        right = _EMAIL_RIGHT.match(text, left.end() - (text[left.end() - 1] == " "))
        if right:
            out.append((start, right.end(), "email"))
    for m in _NUMBER.finditer(text):
        out += _numbers(text, m.start(), m.end())
    for m in _ZH_ANCHOR.finditer(text):
        if left := _ZH_LEFT.search(text, max(0, m.start() - 9), m.start()):
            out.append((left.start(), m.end(), "address"))
    for p in (_EN, _FR):
        out += [(m.start(), m.end(), "address") for m in p.finditer(low) if not (low[m.start() - 1 : m.start()].isalnum() and low[m.start() - 1].isascii())]
    for m in _DE_ANCHOR.finditer(text):
        if left := _DE_LEFT.search(text, max(0, m.start() - 60), m.start()):
            out.append((left.start(), m.end(), "address"))
    for word in _ES_WORDS:
        at = low.find(word)
        while at >= 0:
            if m := _ES.match(low, at):
                out.append((at, m.end(), "address"))
            at = low.find(word, at + 1)
    if names is not None:
        # a Latin letter or digit before a Latin name makes it part of a longer word
        out += [(m.start(), m.end(), "name") for m in names.finditer(low) if not (m[0][0].isalpha() and m[0][0] < "\u2e80" and (c := low[m.start() - 1 : m.start()]) and (c.isalnum() or c == "_") and c < "\u2e80")]
    return out


# -- boosted trees


@dataclass
class Boosted:
    """Trees of depth 3 as arrays: feature, cut and value of each node of each tree (heap order), a base score, and a sigmoid and threshold for each kind."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - 7]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.score(x) + b, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.3, ridge: float = 1.0, cuts: int = 16) -> Boosted:
    """Newton boosting on the logistic loss; the cuts tried are quantiles of each feature."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[:-1])) for j in range(x.shape[1])]
    for j in range(x.shape[1]):
        if len(u := np.unique(x[:, j])) <= 2 * cuts:
            grid[j] = u[:-1]
    fs, cs, vs = [], [], []
    z = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, c, v = np.zeros(7, np.int64), np.full(7, np.inf), np.zeros(8)
        node = np.zeros(len(y), np.int64)
        for k in range(7):
            at = np.flatnonzero(node == k)
            best, (gs, hs) = 1e-9, (g[at], h[at])
            if len(at) >= 2:
                top = gs.sum() ** 2 / (hs.sum() + ridge)
                for j, cut in enumerate(grid):
                    if not len(cut):
                        continue
                    bins = np.searchsorted(cut, x[at, j], "left")  # <= cut[i] falls in bins up to i
                    gl = np.cumsum(np.bincount(bins, gs, len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins, hs, len(cut) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + ridge) - top
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, f[k], c[k] = float(gain[i]), j, cut[i]
            node[at] = 2 * k + 1 + (x[at, f[k]] > c[k])
        for leaf in range(8):
            at = node == leaf + 7
            if at.any():
                v[leaf] = rate * g[at].sum() / (h[at].sum() + ridge)
        z += v[node - 7]
        fs.append(f), cs.append(c), vs.append(v)
    return Boosted(np.array(fs), np.array(cs), np.array(vs), base)


# -- training texts


def _digits(r: random.Random, n: int, first: str = "0123456789") -> str:
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _grouped(r: random.Random, d: str, sizes: list[int], seps: str = " -.") -> str:
    sep, out, at = r.choice([*seps, ""]), [], 0
    for n in sizes:
        out.append(d[at : at + n])
        at += n
    return sep.join(out)


def _positive(r: random.Random, kind: str, names: list[str]) -> str:
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(4, 9)))
    if kind == "email":
        local = r.choice([word(), f"{word()}.{word()}", f"{word()}-{r.randint(1, 99)}", f"{word()}+{word()}", f"{word()[0]}{r.randint(100, 999)}", f"{word()[:3]}_{word()[:3]}"])
        host = [word(), *([word()] if r.random() < 0.3 else []), r.choice(["com", "org", "net", "test", "example", "invalid", "info", "io", "de"])]
        at, dot = r.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", "[dot]"), ("(at)", "(dot)"), (" at ", " dot ")])
        s = local + at + dot.join(host)
        return s.upper() if r.random() < 0.15 else s
    if kind == "phone":
        k = r.randint(0, 4)
        if k == 0:
            d = "1" + r.choice("3456789") + _digits(r, 9)
            return r.choice(["", "", "+86 ", "+86", "0086 ", "+86-"]) + _grouped(r, d, r.choice([[11], [3, 4, 4], [3, 8]]))
        if k == 1:
            a, b, c = _digits(r, 3, "23456789"), _digits(r, 3, "23456789"), _digits(r, 4)
            return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 {a}-{b}-{c}", f"+1{a}{b}{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b} {c}", f"1-{a}-{b}-{c}"])
        if k == 2:
            d = "7" + _digits(r, 9)
            return r.choice(["0", "+44 ", "+44", "+44 (0)"]) + _grouped(r, d, r.choice([[4, 6], [4, 3, 3], [10]]), " ")
        if k == 3:
            d = r.choice(["30", "40", "89", "221", "171"]) + _digits(r, 8)
            return r.choice(["0", "+49 ", "+49 (0)", "0049 "]) + _grouped(r, d, r.choice([[2, 5, len(d) - 7], [3, len(d) - 3], [len(d)]]), " -")
        d = _digits(r, 9, "1234679")
        return r.choice(["0", "+33 ", "+33"]) + _grouped(r, d, r.choice([[1, 2, 2, 2, 2], [9]]), " .-")
    if kind == "identity":
        k = r.randint(0, 2)
        if k == 0:
            d = _digits(r, 6, "123456789") + f"{r.randint(1950, 2010)}{r.randint(1, 12):02}{r.randint(1, 28):02}" + _digits(r, 3)
            s = d + _CONTROL[sum(int(a) * w for a, w in zip(d, _WEIGHTS)) % 11]
            return r.choice([s, s, f"{s[:6]} {s[6:14]} {s[14:]}", f"{s[:6]}-{s[6:14]}-{s[14:]}"])
        if k == 1:
            return f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
        d = _digits(r, 8)
        return d + r.choice(["", "-"]) + _LETTERS_23[int(d) % 23]
    if kind == "address":
        k, w, n = r.randint(0, 4), word().title(), r.randint(1, 399)
        if k == 0:
            zh = lambda m: "".join(r.choice("云岚石白鹭洲松山海星河柳桂兰南北东西") for _ in range(m))
            road = zh(r.randint(2, 3)) + r.choice("路街桥巷") + ("" if r.random() < 0.7 else "路")
            town = r.choice([f"{zh(2)}市{zh(2)}区", f"{zh(2)}区", ""])
            flat = r.choice([f"{n}号{r.randint(1, 20)}号楼{r.randint(101, 909)}室", f"{n}号{r.randint(1, 20)}单元{r.randint(101, 3000)}", f"{n}号", f"{n}弄{r.randint(1, 40)}号{r.randint(101, 900)}室"])
            return town + road + flat
        if k == 1:
            s = f"{n} {w} {r.choice(['Street', 'St.', 'Road', 'Rd.', 'Avenue', 'Lane', 'Drive'])}" + r.choice([f", Apt {r.randint(1, 40)}B", f", Flat {r.randint(1, 9)}", ""])
        elif k == 2:
            s = f"{n}{r.choice(['', ' bis', ' ter'])} rue {r.choice(['des', 'du', 'de la'])} {w}" + r.choice([f", {_digits(r, 5)} {word().title()}", f", {_digits(r, 5)} {word().title()}", ""])
        elif k == 3:
            s = f"{w}{r.choice(['weg', 'straße', 'kehre', 'gasse', ''])} {r.randint(1, 99)}{r.choice(['', 'a', 'b'])}, {_digits(r, 5)} {word().title()}"
        else:
            s = f"Calle {r.choice(['del', 'de la', 'de'])} {w} {word().title()} {n}" + r.choice([f", {r.randint(1, 9)}.º {r.choice('ABCD')}", ""])
        return s.upper() if r.random() < 0.08 else s.lower() if r.random() < 0.05 else s
    s = r.choice(names)
    return s.upper() if r.random() < 0.15 else s.lower() if r.random() < 0.1 else s


def _lookalike(r: random.Random, names: list[str]) -> str:
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))
    k = r.randint(0, 13)
    if k == 0:
        return f"{word()}@{word()} {r.choice(['分支', 'branch'])} {word()}"
    if k == 1:
        return f"@{word()} {word()} at {word()} dot {r.randint(1, 9)}"
    if k == 2:
        return f"{word()} at {r.randint(1, 99)}.{r.randint(10, 99)}"
    if k == 3:
        d = _digits(r, 6, "123456789") + f"{r.randint(1950, 2010)}{r.randint(1, 12):02}{r.randint(1, 28):02}" + _digits(r, 3)
        right = _CONTROL[sum(int(a) * w for a, w in zip(d, _WEIGHTS)) % 11]
        return r.choice(["样本号", "", "登记"]) + d + r.choice([c for c in _CONTROL if c != right])
    if k == 4:
        return r.choice(["SN ", "serial ", "批次 ", "流水号"]) + r.choice([_digits(r, r.choice([9, 10, 12, 13, 15]), "23456789"), f"{_digits(r, 4)}-{_digits(r, 2)}-{_digits(r, 3)}", _positive(r, "phone", names)])
    if k == 5:
        return r.choice(["时间戳 ", "stamp ", ""]) + f"20{r.randint(20, 26)}{r.randint(1, 12):02}{r.randint(1, 28):02}{_digits(r, 6)}"
    if k == 6:
        d = _digits(r, 8)
        return d + r.choice([c for c in _LETTERS_23 if c != _LETTERS_23[int(d) % 23]])
    if k == 7:
        return f"{r.randint(1, 254)}.{r.randint(0, 99)}.{r.randint(0, 99)}.{r.randint(1, 254)}"
    if k == 8:
        return f"第{r.randint(1, 30)}路{r.randint(1, 60)}号通道"
    if k == 9:
        return f"{r.randint(1, 12)} of {r.randint(1, 30)} {r.choice(['road', 'street', 'way', 'lane'])} {word()}"
    if k == 10:
        return f"{word()} from {r.randint(100, 999)} down to {r.randint(10, 99)}, {_digits(r, 3)} {word()}"
    if k == 11:
        return _digits(r, r.randint(1, 4), "123456789") + _positive(r, "phone", names).replace(" ", "").replace("+", "")
    if k == 12:
        return _positive(r, "phone", names) + r.choice(["-", ""]) + _digits(r, r.randint(2, 5))
    return f"{r.randint(1, 99)}.{r.randint(10, 99)} {word()} {_digits(r, r.randint(8, 10), '23456789')}"


def training_texts(parts: list[tuple[str, str, str]], n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up texts with the spans of what is personal in them; look-alikes stand among them unmarked."""
    r = random.Random(seed)
    names = []
    for f, kind, script in parts:
        for g, other, script2 in parts:
            if kind == "family" and other == "given" and script == script2:
                names += [f + g] if script == "zh" else [f"{g} {f}", f"{f}, {g}"]
    kinds = [k for k in KINDS if k != "name" or names]
    filler = ["我们把", "结果", "然后", "the note ", "was sent ", "mit der ", "avec ", "para ", "今天", "phase error ", "读数", "peaking ", "2024-05-11 ", "3.5 ", "12 "]
    seps = ["，", "。", " ", ", ", ". ", "（", "：", "；", "\n", " / ", "和"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += "".join(r.choice(filler) for _ in range(r.randint(0, 4))) + r.choice(seps)
            if r.random() < 0.6:
                kind = r.choice(kinds)
                s = _positive(r, kind, names)
                spans.append((len(text), len(text) + len(s), kind))
            else:
                s = _lookalike(r, names)
            text += s + r.choice([*seps, ""] if r.random() < 0.9 else ["。"])
            if text[-1:].isalnum():
                text += "。"
        out.append((text, spans))
    return out


def _labelled(texts: list[tuple[str, list[tuple[int, int, str]]]], names: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for text, spans in texts:
        own = set(spans)
        for a, b, kind in candidates(text, names):
            x.append(_row(kind, text, a, b))
            # a candidate counts as right if it covers a span of its kind up to small change at its ends
            y.append(float(any(k == kind and abs(s - a) <= 2 and abs(e - b) <= 2 for s, e, k in own)))
    return np.array(x), np.array(y)


@lru_cache(maxsize=4)
def trained(parts: tuple[tuple[str, str, str], ...], texts: int = 2500, seed: int = 11) -> Boosted:
    """The model for some name parts; the same for the same arguments."""
    names = name_pattern(list(parts))
    x, y = _labelled(training_texts(list(parts), texts, seed), names)
    m = boost(x, y)
    x, y = _labelled(training_texts(list(parts), texts // 2, seed + 1), names)
    s = m.score(x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the sigmoid
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        ga, gb = ((y - p) * s).sum() - 1e-3 * (a - 1), (y - p).sum()
        haa, hab, hbb = (h * s * s).sum() + 1e-3, (h * s).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    m.scale = (float(np.clip(a, 0.2, 5)), float(np.clip(b, -5, 5)))
    p = m.probability(x)
    for i, kind in enumerate(KINDS):
        of = x[:, i] == 1
        best = (-1.0, 0.5)
        for t in np.linspace(0.1, 0.9, 17):
            hit = (p[of] >= t) & (y[of] == 1)
            f1 = 2 * hit.sum() / max(1, (p[of] >= t).sum() + (y[of] == 1).sum())
            best = max(best, (float(f1), -abs(t - 0.5)))
        m.thresholds[kind] = float(next((t for t in sorted(np.linspace(0.1, 0.9, 17), key=lambda t: abs(t - 0.5)) if -abs(t - 0.5) == best[1]), 0.5))
    return m


def redactions(texts: list[str | None], model: Boosted, names: re.Pattern | None) -> Iterator[list[tuple[int, int, str]]]:
    """For each text its (start, end, kind) in reading order; the spans don't overlap."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < BLOCK_CHARS):
            size += len(texts[end] or "") + len(_GAP)
            end += 1
        part = [t or "" for t in texts[at:end]]
        joined = narrow(_GAP.join(part))
        starts = np.cumsum([0, *(len(t) + len(_GAP) for t in part[:-1])])
        found = candidates(joined, names)
        out: list[list[tuple[int, int, str]]] = [[] for _ in part]
        if found:
            x = np.array([_row(kind, joined, a, b) for a, b, kind in found])
            p = model.probability(x)
            good = [i for i, (_, _, kind) in enumerate(found) if p[i] >= model.thresholds[kind]]
            rows = np.searchsorted(starts, [found[i][0] for i in good], "right") - 1
            # an email address outranks what lies within it; else the likelier, then the longer
            taken: dict[int, list[tuple[int, int]]] = {}
            for i, row in sorted(zip(good, rows.tolist()), key=lambda v: (found[v[0]][2] != "email", -round(float(p[v[0]]), 2), found[v[0]][0] - found[v[0]][1], found[v[0]][0])):
                a, b, kind = found[i]
                if all(b <= s or a >= e for s, e in taken.get(row, ())):
                    taken.setdefault(row, []).append((a, b))
                    out[row].append((a - int(starts[row]), b - int(starts[row]), kind))
        for spans in out:
            yield sorted(spans)
        at = end


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the placeholder of its kind."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def find_personal(df: DataFrame, id_column: str, text: str, name_parts: list[tuple[str, str, str]]) -> DataFrame:
    """id, kind, occurrence, start, length: a row for each find, occurrence counting those of one kind in one text from 1 in reading order.

    start is counted from 0 in code points. Null and empty texts have no finds; a row that comes twice has its finds twice; without name parts there
    are no names. The id keeps its type; other columns are not read.
    """
    model, names = trained(tuple(sorted(name_parts))), name_pattern(name_parts)
    kind_of_id = df.schema[id_column].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kinds, number, start, length = [], [], [], [], []
            for i, spans in enumerate(redactions(batch.column(1).to_pylist(), model, names)):
                seen = dict.fromkeys(KINDS, 0)
                for a, b, kind in spans:
                    seen[kind] += 1
                    row.append(i), kinds.append(kind), number.append(seen[kind]), start.append(a), length.append(b - a)
            if row:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(kinds), pa.array(number, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64())],
                    names=["id", "kind", "occurrence", "start", "length"],
                )

    return df.select(id_column, text).mapInArrow(search, f"id {kind_of_id}, kind string, occurrence bigint, start bigint, length bigint")


def redact_personal(df: DataFrame, id_column: str, text: str, name_parts: list[tuple[str, str, str]]) -> DataFrame:
    """id and redacted: each row's text with its finds replaced; a null text stays null and an empty one empty, repeated rows stay."""
    model, names = trained(tuple(sorted(name_parts))), name_pattern(name_parts)
    kind_of_id = df.schema[id_column].dataType.simpleString()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            new = [None if t is None else redacted(t, spans) for t, spans in zip(texts, redactions(texts, model, names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["id", "redacted"])

    return df.select(id_column, text).mapInArrow(replace, f"id {kind_of_id}, redacted string")
