"""Fragments that bear on latent questions, and inspiration: roles, domains, and the four traces that they charge."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..tables import bound
from .memory import ranked_fragments

# -- fixed values: a latent question's words and its parameters
QUESTION = {
    "keywords": ["创新点", "拼凑", "事件", "LIF", "后向散射", "脑机", "BCI", "EEG", "SSVEP", "节律", "物理层", "反射系数", "ADC", "无线", "恢复"],
    "conflict": ["拼凑", "怀疑", "不知道", "不够", "别人做过", "已有", "难道", "没意义"],
    "completion": ["明白", "确认", "定义", "结论", "可以写成", "我知道了"],
    "cap": 6.8,
}
# -- fixed values: roles and domains of inspiration, weights of roles
ROLES = {
    "tension": ["为什么", "难道", "不理解", "矛盾", "悖论", "冲突", "卡住", "差点意思", "困惑", "到底", "反而", "但是", "问题是"],
    "bridge": ["类似", "像", "等价", "映射", "类比", "迁移", "联系", "可以理解为", "本质上", "机制"],
    "compression": ["本质", "核心", "一句话", "压缩", "定义", "命名", "主线", "闭环", "归结", "收束", "抽象"],
    "spark": ["灵感", "洞察", "突然", "意识到", "发现", "想到", "新", "突破", "第一次", "原来", "是不是", "能不能"],
    "validation": ["验证", "测试", "实验", "数据", "图", "对比", "判据", "指标", "证明", "写成", "跑一次"],
}
DOMAINS = {
    "LIF": ["LIF", "脉冲", "spike", "事件", "阈值", "泄漏", "双时间尺度"],
    "Backscatter": ["后向散射", "反射系数", "USRP", "边带", "915", "无线", "标签"],
    "EEG": ["脑电", "EEG", "SSVEP", "节律", "事件率", "高斯", "恢复"],
    "NegativeResistance": ["负阻", "NDR", "斜率", "抵消", "偏置", "放大"],
    "Thesis": ["论文", "章节", "第三章", "第四章", "创新点", "证据链", "盲审"],
    "AI_Memory": ["AI", "大模型", "agent", "智能体", "记忆", "Obsidian", "RAG"],
    "Career": ["简历", "求职", "实习", "岗位", "投递", "项目经历"],
    "Economics": ["经济", "周期", "利率", "通胀", "债务", "金融危机", "就业"],
    "Health": ["焦虑", "难受", "睡", "身体", "压力", "害怕", "恢复"],
}
ROLE_WEIGHTS = {"tension": 0.95, "bridge": 0.90, "compression": 0.80, "spark": 1.10, "validation": 0.55}
TRACES = {"incubation": (0.94, 0.35), "tension": (0.86, 0.25), "bridge": (0.90, 0.25), "spark": (0.40, 0.15)}
CAP, THETA, RESET = 7.2, 8.0, 0.35


def bounded(lowered: Column, words: list[str]) -> Column:
    """As ``matched``, but a word of letters and digits only counts where it stands by itself."""
    hits = []
    for w in dict.fromkeys(words):
        n = w.lower()
        alone = re.fullmatch(r"[a-z0-9_+-]+", n)
        found = F.rlike(lowered, F.lit(rf"(?<![a-z0-9_]){re.escape(n)}(?![a-z0-9_])")) if alone else F.contains(lowered, F.lit(n))
        hits.append(F.when(found, F.lit(w)))
    return F.array_compact(F.array(*hits))


def question_fragments(blocks: DataFrame, question: dict | None = None) -> DataFrame:
    """Blocks that hold a keyword of the question, with score, role (conflict, evidence, completion) and inhibition."""
    q = question or QUESTION
    low, found = F.col("_low"), F.col("_found")
    rows = bound(blocks, {"_low": F.lower("block"), "_found": T.found(F.lower("block"), q["keywords"], q["conflict"], q["completion"], L.ACTION, L.TIME_PRESSURE)})
    # whether a word stands by itself is only looked up where the scan has found it
    rows = bound(rows.where(T.holds(found, q["keywords"])), {"hits": bounded(low, q["keywords"])}).where(F.size("hits") > 0)
    rows = rows.withColumns({"conflict": T.holds(found, q["conflict"]), "closed": T.holds(found, q["completion"])})
    score = 0.75 + F.least(F.size("hits"), F.lit(6)) * 0.28 + F.when(F.col("conflict"), 0.75).otherwise(0.0) + F.when(T.holds(found, L.ACTION), 0.35).otherwise(0.0) + F.when(T.holds(found, L.TIME_PRESSURE), 0.25).otherwise(0.0)
    role = F.when(F.col("conflict"), "conflict").when(F.col("closed"), "completion").otherwise("evidence")
    return rows.withColumns({"score": score, "role": role, "inhibition": F.when(F.col("closed"), 0.85).otherwise(0.0)}).drop("conflict", "closed", "_low", "_found")


def _labels(found: Column, table: dict[str, list[str]]) -> tuple[Column, Column]:
    """The labels that hold a found word, and the hits: a word counts once for each list that has it."""
    hits = {k: T.held(found, ws) for k, ws in table.items()}
    return F.array_compact(F.array(*[F.when(F.size(h) > 0, F.lit(k)) for k, h in hits.items()])), sum((F.size(h) for h in hits.values()), F.lit(0))


def inspiration_fragments(blocks: DataFrame) -> DataFrame:
    """Blocks with roles, domains and a score of at least 0.75; one with domains only has the role ``domain_evidence``."""
    found = F.col("_found")
    roles, role_hits = _labels(found, ROLES)
    domains, domain_hits = _labels(found, DOMAINS)
    rows = bound(blocks, {"_found": T.found(F.lower("block"), *ROLES.values(), *DOMAINS.values())}).where(F.size("_found") > 0)
    rows = bound(rows, {"roles": roles, "role_hits": role_hits, "domains": domains, "domain_hits": domain_hits})
    has = lambda r: F.array_contains("roles", r)
    weights = sum((F.when(has(r), w).otherwise(0.0) for r, w in ROLE_WEIGHTS.items()), F.lit(0.0))
    bonus = F.when(has("tension") & has("bridge"), 0.65).otherwise(0.0) + F.when(has("compression") & has("validation"), 0.40).otherwise(0.0) + F.when(has("spark") & (has("tension") | has("bridge")), 0.55).otherwise(0.0)
    score = 0.30 + weights + F.least("domain_hits", F.lit(8)) * 0.12 + F.greatest(F.size("domains") - 1, F.lit(0)) * 0.55 + F.least("role_hits", F.lit(8)) * 0.08 + T.specificity(F.col("block")) * 0.55 + bonus
    rows = bound(rows.where((F.size("roles") > 0) | (F.size("domains") > 0)), {"score": score}).where("score >= 0.75").drop("_found")
    return rows.withColumn("roles", F.when(F.size("roles") == 0, F.array(F.lit("domain_evidence"))).otherwise(F.col("roles")))


def daily_inspiration(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Capped sums for each of ``keys``: of all fragments, and of those with tension, a bridge (or two domains), a spark, a validation. One pass, combined map-side."""
    has = lambda r: F.array_contains("roles", r)
    part = lambda when, share: F.least(F.sum(F.when(when, F.col("score")).otherwise(0.0)), F.lit(CAP * share))
    return fragments.groupBy(*keys).agg(
        part(F.lit(True), 1.0).alias("input"), part(has("tension"), 0.80).alias("tension"), part(has("bridge") | (F.size("domains") >= 2), 0.80).alias("bridge"), part(has("spark"), 0.65).alias("spark"), part(has("validation"), 0.60).alias("validation"), F.count("*").alias("fragments")
    )


def inspiration_spikes(daily: DataFrame, key: str, least: int = 4) -> DataFrame:
    """The four traces of each key over its days, firing once a day at most, with material enough: ``least`` fragments and two roles, one of them tension, bridge or compression.

    daily: key, day, the sums of ``daily_inspiration`` and top array<struct<score, snippet, roles, domains>> in order. Fragments are held by spark, bridge, tension, domains, score and day. Comes out: key, day, the traces, v, held, fired.
    """
    import pandas as pd

    kind = daily.schema[key].dataType.simpleString()

    rank = lambda f: ("spark" in f["roles"], "bridge" in f["roles"], "tension" in f["roles"], f["domains"], f["score"], f["day"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        t, last, fired_on, held, out = dict.fromkeys(TRACES, 0.0), None, None, [], []
        for r in pdf.sort_values("day").itertuples(index=False):
            gap = 1 if last is None else max((r.day - last).days, 1)
            last = r.day
            add = {"incubation": 0.35 * r.input + 0.20 * r.validation, "tension": r.tension, "bridge": r.bridge, "spark": r.spark}
            t = {n: max(0.0, d**gap * t[n] + add[n]) for n, (d, _) in TRACES.items()}
            v = sum(w * t[n] for n, (_, w) in TRACES.items())
            if len(r.top):
                held = ranked_fragments(held + [{"snippet": f["snippet"], "score": f["score"], "roles": list(f["roles"]), "domains": len(f["domains"]), "day": r.day} for f in r.top], rank, 24)
            material = ranked_fragments(held, rank, 16)
            roles = {x for f in material for x in f["roles"]}
            hit = v >= THETA and len(material) >= least and len(roles) >= 2 and bool(roles & {"tension", "bridge", "compression"}) and (fired_on is None or (r.day - fired_on).days >= 1)
            out.append((getattr(r, key), r.day, *t.values(), v, len(held), hit))
            if hit:
                fired_on = r.day
                t = {n: 0.0 if n == "spark" else x * RESET for n, x in t.items()}
                held = held[-4:]
        return pd.DataFrame(out, columns=[key, "day", *TRACES, "v", "held", "fired"])

    return daily.groupBy(key).applyInPandas(fold, f"{key} {kind}, day date, " + ", ".join(f"{n} double" for n in TRACES) + ", v double, held int, fired boolean")
