"""Memory fields: named dimensions charged by observations, slots that form by themselves, and traces that keep fragments."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import bound
from .recurrence import leaky_closed

# -- fixed values: dimensions of the field
DIMENSIONS = {
    "experiment_loop": (0.83, 0.92, 4.2, ["实验", "测试", "LIF", "KS1092", "SSVEP", "EEG", "后向散射", "USRP", "波形", "PSD", "事件率", "联调", "阈值"], ["跑通", "测出来", "完成", "记录", "截图", "保存"]),
    "thesis_loop": (0.86, 0.94, 4.0, ["论文", "章节", "第四章", "第三章", "盲审", "主线", "逻辑", "证据", "图", "创新点", "写作"], ["写完", "放进论文", "改完", "整理", "形成"]),
    "career_transition": (0.88, 0.96, 3.6, ["简历", "求职", "岗位", "投递", "实习", "工作", "AI", "大模型", "嵌入式", "项目表达"], ["投递", "写入简历", "改简历", "收藏岗位"]),
    "emotion_load": (0.76, 0.88, 3.2, ["焦虑", "难受", "害怕", "崩", "延毕", "动不了", "压力", "失败", "累", "迷茫", "羞耻"], ["休息", "散步", "睡觉", "恢复", "吃饭", "运动"]),
    "ai_memory_design": (0.84, 0.94, 3.8, ["记忆", "agent", "智能体", "NeRF", "重建", "一致性", "状态场", "洞察", "Obsidian"], ["升级", "测试", "跑一次", "规则", "模块"]),
}
CUES = ["今天", "现在", "必须", "接下来", "不知道", "卡", "失败", "难受"]
SYMBOLS = ["->", "→", "/", "%", "mV", "Hz", "V", "kΩ", "Ω"]

SIGNALS = {
    "novelty": ["新", "引入", "更新", "第一次", "突破", "发现", "重构", "新增", "v0", "agent", "智能体"],
    "conflict": ["矛盾", "冲突", "不理解", "卡", "失败", "不稳", "质疑", "缺", "漏洞", "反驳", "链接不起来"],
    "risk": ["风险", "危险", "延毕", "截止", "不会", "不能", "丢失", "崩", "错误", "幻觉", "不可复现"],
    "value": ["论文", "闭环", "证据", "求职", "项目", "简历", "核心", "主线", "实验", "代码", "可执行"],
    "urgency": ["今天", "现在", "今晚", "明天", "马上", "最近", "截止", "提交", "答辩", "版本"],
    "fatigue": ["重复", "旧", "已经", "太多", "空转", "低价值", "无效", "泛泛", "废话"],
}
SLOT_STOP = {"今天", "现在", "这个", "那个", "就是", "然后", "需要", "应该", "感觉", "什么", "一个", "自己", "进行", "目前", "接下来", "the", "and", "with", "that", "this", "from"}
SLOT_ACTION = ["今天", "接下来", "下一步", "需要", "必须", "应该", "测试", "写", "整理", "投递", "记录", "验证"]
SLOT_BLOCKER = ["卡", "不知道", "缺", "没有", "失败", "问题", "害怕", "焦虑", "难受", "动不了", "延毕"]
SLOT_COMPLETION = ["完成", "已经", "跑通", "出结果", "保存", "写完", "测出来", "提交", "搞定"]
SLOT_INCOMPLETE = ["没完成", "未完成", "还没", "尚未", "没有完成", "缺"]
SLOT_SYMBOLS = ["->", "→", "/", "%", "mV", "Hz", "Ω"]


def observations(blocks: DataFrame) -> DataFrame:
    """Rows of blocks with dimensions, intensity and completion; blocks that touch no dimension are dropped."""
    found = F.col("_found")
    hits = {d: T.held(found, words) for d, (_, _, _, words, _) in DIMENSIONS.items()}
    dims = F.array_compact(F.array(*[F.when(F.size(h) > 0, F.lit(d)) for d, h in hits.items()]))
    words = F.array_distinct(F.concat(*hits.values()))
    done = F.lit(False)
    for d, (_, _, _, _, completion) in DIMENSIONS.items():
        done = done | ((F.size(hits[d]) > 0) & T.holds(found, completion))
    base = F.least(F.lit(2.2), 0.55 + 0.28 * F.size("words") + 0.45 * T.specificity(F.col("block"), 0.10, 0.08, 0.12, SYMBOLS))
    lists = [x for _, _, _, words_, completion in DIMENSIONS.values() for x in (words_, completion)] + [CUES]
    blocks = bound(blocks, {"_found": T.found(F.lower("block"), *lists)}).where(F.size("_found") > 0)
    rows = bound(blocks, {"dimensions": dims, "words": words, "completion": F.when(done, 0.75).otherwise(0.0)}).where(F.size("dimensions") > 0)
    return rows.withColumn("intensity", F.round(F.least(base + F.when(T.holds(found, CUES), 0.35).otherwise(0.0), F.lit(2.5)), 4)).drop("_found")


def latent_cells(obs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Traces of each dimension after each observation that touches it. obs: keys, day, dimensions, intensity, completion.

    Without resets the closed form holds, with same-day rows in ``order``: one window over (keys, dimension) for each trace. Decay differs by dimension, so it is a column.
    """
    decays = F.create_map(*[x for d, (f, s, _, _, _) in DIMENSIONS.items() for x in (F.lit(d), F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow")))])
    rows = obs.withColumn("dimension", F.explode("dimensions")).withColumn("_d", decays[F.col("dimension")])
    inhibition = F.col("completion") * 0.65
    fast = leaky_closed(rows, [*keys, "dimension"], F.col("intensity") - inhibition, F.col("_d.fast"), "v_fast", order)
    slow = leaky_closed(fast, [*keys, "dimension"], F.col("intensity") * 0.45 - inhibition * 0.25, F.col("_d.slow"), "v_slow", order)
    return slow.drop("_d").withColumn("v", 0.72 * F.col("v_fast") + 0.28 * F.col("v_slow"))


def _fnv(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


@lru_cache(maxsize=200_000)
def _place(term: str, dimensions: int) -> tuple[int, float]:
    return _fnv(term) % dimensions, 1.0 if _fnv(term + "#sign") % 2 == 0 else -1.0


def slot_observations(blocks: DataFrame, dimensions: int = 96) -> DataFrame:
    """The rows of blocks (with ``block``) with snippet, terms, hashed vector, intensity and completion; blocks without terms are dropped. Row by row, no shuffle."""
    import math
    import re
    from collections import Counter

    import pandas as pd

    latin, han, number, capitals = re.compile(r"[A-Za-z][A-Za-z0-9_+\-]{1,}"), re.compile(r"[\u4e00-\u9fff]+"), re.compile(r"\d+(?:\.\d+)?"), re.compile(r"\b[A-Z]{2,}\b")
    units = re.compile(r"\d+(?:\.\d+)?\s*(?:mV|V|Hz|kHz|MHz|Ω|ohm|欧姆|倍|%)", re.I)
    rest = [c for c in blocks.columns if c != "block"]

    def terms_of(text: str) -> list[str]:
        out = [m.lower() for m in latin.findall(text)]
        for run in han.findall(text):
            out += [run] if len(run) <= 4 else []
            out += [run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)]
        out += [m.replace(" ", "").lower() for m in units.findall(text)]
        return [t for t in out if t not in SLOT_STOP]

    def embedded(terms: list[str]) -> list[float]:
        v = [0.0] * dimensions
        for term, n in Counter(terms).items():
            at, sign = _place(term, dimensions)
            v[at] += sign * (1.0 + math.log1p(n))
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm > 0 else v

    def run(batches):
        for pdf in batches:
            kept, out = [], []
            for i, text in enumerate(pdf["block"]):
                if not (terms := terms_of(text)):
                    continue
                low = text.lower()
                has = lambda words: any(w.lower() in low for w in words)  # noqa: B023, E731
                done = float(has(SLOT_COMPLETION) and not has(SLOT_INCOMPLETE))
                named = min(1.0, 0.10 * len(number.findall(text)) + 0.12 * sum(x in text for x in SLOT_SYMBOLS) + 0.08 * len(capitals.findall(text)))
                level = 0.55 + 0.04 * min(len(terms), 25) + 0.28 * has(SLOT_ACTION) + 0.35 * has(SLOT_BLOCKER) + 0.22 * named - 0.18 * done
                kept.append(i)
                out.append((text if len(text) <= 140 else text[:139] + "…", terms, embedded(terms), max(0.15, min(2.2, level)), done))
            new = pd.DataFrame(out, columns=["snippet", "terms", "vector", "intensity", "completion"])
            yield pd.concat([pdf.iloc[kept][rest].reset_index(drop=True), new], axis=1)

    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in rest)
    return blocks.mapInPandas(run, f"{kinds}, snippet string, terms array<string>, vector array<double>, intensity double, completion double")


def slots(vectors: DataFrame, key: str, count: int = 8, least: float = 0.42, rate: float = 0.22, fast: float = 0.84, slow: float = 0.94, order: tuple[str, ...] = ("seq",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Online clustering of (key, day, order, vector) in order of day and ``order``: slot, similarity and loss of each row; with intensity and completion also the
    slot's traces after it, which decay by days, and its running mean of the loss. Columns of ``carry`` pass through.

    A row goes to the slot with the nearest prototype, or opens an empty one if none is near; the prototype moves towards it. The state is ``count`` prototypes, so a key's rows pass
    through in one sorted stream of Arrow batches, however many there are; keys run beside each other.
    """
    import numpy as np
    import pandas as pd

    charged = {"intensity", "completion"} <= set(vectors.columns)
    passed = [key, "day", *order, *carry]
    named = [*passed, "slot", "similarity", "loss", *(["v_fast", "v_slow", "loss_mean"] if charged else [])]

    def run(batches):
        state: dict = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if k not in state:
                    state.clear()  # rows come sorted by key, so the last one is over
                    state[k] = {"p": np.zeros((count, len(r.vector))), "n": np.zeros(count, int), "f": np.zeros(count), "s": np.zeros(count), "l": np.zeros(count), "day": None}
                s, v = state[k], np.asarray(r.vector, float)
                used = np.flatnonzero(s["n"])
                norm = np.linalg.norm(v)
                sims = s["p"][used] @ v / (norm or 1.0) if len(used) else np.empty(0)
                best = int(sims.argmax()) if len(used) else -1
                empty = np.flatnonzero(s["n"] == 0)
                if len(empty) and (best < 0 or sims[best] < least):
                    slot, similarity = int(empty[0]), 1.0
                    s["p"][slot] = v
                else:
                    slot, similarity = int(used[best]), float(sims[best])
                mixed = (1 - rate) * s["p"][slot] + rate * v
                length = np.linalg.norm(mixed)
                s["p"][slot] = mixed / length if length > 0 else mixed
                s["n"][slot] += 1
                loss = max(0.0, 1.0 - similarity)
                row = (*(getattr(r, c) for c in passed), slot, similarity, loss)
                if charged:
                    if not pd.isna(r.day):
                        gap = (r.day - s["day"]).days if s["day"] is not None else 0
                        s["f"] *= fast**gap
                        s["s"] *= slow**gap
                        s["day"] = r.day
                    held = 0.55 * r.completion
                    s["f"][slot] = max(0.0, s["f"][slot] + r.intensity - held)
                    s["s"][slot] = max(0.0, s["s"][slot] + 0.45 * r.intensity - 0.25 * held)
                    s["l"][slot] = loss if s["n"][slot] == 1 else 0.78 * s["l"][slot] + 0.22 * loss
                    row += (s["f"][slot], s["s"][slot], s["l"][slot])
                out.append(row)
            yield pd.DataFrame(out, columns=named)

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in passed)
    rows = vectors.select(*passed, "vector", *(["intensity", "completion"] if charged else [])).repartition(key).sortWithinPartitions(key, "day", *order)
    return rows.mapInPandas(run, f"{kinds}, slot int, similarity double, loss double" + (", v_fast double, v_slow double, loss_mean double" if charged else ""))


def ranked_fragments(fragments: list[dict], rank, keep: int) -> list[dict]:
    """The ``keep`` fragments that rank highest, each snippet once, in order of days; equal ones stay in the order they came in."""
    seen: dict[str, dict] = {}
    for f in sorted(fragments, key=rank, reverse=True):
        seen.setdefault(f["snippet"], f)
    return sorted(list(seen.values())[:keep], key=lambda f: f["day"])


def kept_fragments(daily: DataFrame, key: str, theta: float, decay: float, reset: float, cooldown: int = 1, least: int = 3, keep: int = 16, after: int = 2) -> DataFrame:
    """A trace that gathers fragments until it fires: it needs ``least`` of them that are no completion, holds the ``keep`` best (conflicts first, then evidence, by score and day), and after firing the last ``after``.

    daily: key, day, input, completion, fragments array<struct<score, snippet, role>> in order. One series a key, of days; comes out: key, day, v, held, fired.
    """
    import pandas as pd

    kind = daily.schema[key].dataType.simpleString()
    rank = lambda f: (f["role"] == "conflict", f["role"] == "evidence", f["score"], f["day"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        v, last, fired_on, held, out = 0.0, None, None, [], []
        for r in pdf.sort_values("day").itertuples(index=False):
            gap = 1 if last is None else max((r.day - last).days, 1)
            last = r.day
            v = max(0.0, decay**gap * v + r.input - r.completion)
            if len(r.fragments):
                held = ranked_fragments(held + [{"snippet": f["snippet"], "score": f["score"], "role": f["role"], "day": r.day} for f in r.fragments], rank, keep)
            hit = v >= theta and sum(f["role"] != "completion" for f in held) >= least and (fired_on is None or (r.day - fired_on).days >= cooldown)
            out.append((getattr(r, key), r.day, v, len(held), hit))
            if hit:
                fired_on, v = r.day, theta * reset
                held = held[-after:]
        return pd.DataFrame(out, columns=[key, "day", "v", "held", "fired"])

    return daily.groupBy(key).applyInPandas(fold, f"{key} {kind}, day date, v double, held int, fired boolean")
