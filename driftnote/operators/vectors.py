"""Sparse and dense vectors of texts, their cosines, and the field that a query raises over dated notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import bound
from .graph import unit

# -- fixed values: topics of the field and its cue words
FIELD_TOPICS = {
    "LIF链路": ["LIF", "脑电", "EEG", "SSVEP", "后向散射", "USRP", "事件", "事件率", "阈值", "压缩"],
    "连续问题场": ["连续", "离散", "问题场", "记忆场", "NeRF", "隐式场", "重建", "Obsidian", "知识库"],
    "AI记忆": ["AI", "agent", "智能体", "记忆", "RAG", "Obsidian", "向量", "检索"],
    "论文闭环": ["论文", "第三章", "第四章", "盲审", "答辩", "主线", "证据", "图", "创新点"],
    "负阻": ["负阻", "NDR", "negative resistance", "斜率", "偏置", "增益", "抵消"],
    "求职": ["简历", "实习", "工作", "求职", "岗位", "投递", "面试", "大模型"],
    "健康恢复": ["焦虑", "累", "睡", "身体", "情绪", "压力", "害怕", "难受", "恢复"],
}
FIELD_ACTION = ["今天", "目标", "下一步", "需要", "必须", "应该", "修改", "写", "整理", "推进", "验证", "闭环", "实验", "投递"]
FIELD_BLOCKER = ["卡", "不知道", "缺", "没有", "不够", "失败", "问题", "害怕", "拖延", "延毕", "焦虑", "混乱", "难受", "动不了"]
FIELD_COMPLETION = ["完成", "做完", "已经", "搞定", "跑通", "出结果", "保存", "写完", "提交", "测出来"]
FIELD_NOVELTY = ["创新", "创新点", "突破", "第一次", "新", "定义", "提出", "重建", "连续", "场", "结构"]
DIMENSIONS = 96

_LATIN = r"([A-Za-z][A-Za-z0-9_\-]+)"


def _weighted(tokens: Column, weight: float, prefix: str = "") -> Column:
    return F.transform(tokens, lambda t: F.struct(F.concat(F.lit(prefix), F.lower(t)).alias("feature"), F.lit(weight).alias("weight")))


def features(found: Column, text: Column, title: Column, tags: Column) -> Column:
    """array<struct<feature, weight>>: words, numbers, shingles, topics with their words (``found``: those in the text), tags and title words, not yet added up."""
    topics = []
    for topic, words in FIELD_TOPICS.items():
        hits = T.held(found, words)
        topics.append(F.when(F.size(hits) > 0, F.concat(F.array(F.struct(F.lit(f"topic:{topic}".lower()).alias("feature"), F.lit(3.0).alias("weight"))), _weighted(F.filter(hits, lambda w: F.length(w) >= 2), 1.4))).otherwise(
            F.array().cast("array<struct<feature:string,weight:double>>")
        ))
    return F.concat(
        _weighted(F.regexp_extract_all(text, F.lit(_LATIN), 1), 1.0),
        _weighted(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), 0.25, "num:"),
        _weighted(T.cjk_shingles(text), 0.55),
        *topics,
        _weighted(F.coalesce(tags, F.array().cast("array<string>")), 2.0, "tag:"),
        _weighted(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(_LATIN), 1), 1.5, "title:"),
        _weighted(T.cjk_shingles(F.coalesce(title, F.lit(""))), 1.2, "title:"),
    )


def feature_lists(notes: DataFrame) -> DataFrame:
    """note_id, features for notes (note_id, text, title, tags): one row a note, its features not yet added up."""
    return bound(notes, {"_found": T.found(F.lower("text"), *FIELD_TOPICS.values())}).select("note_id", features(F.col("_found"), F.col("text"), F.col("title"), F.col("tags")).alias("features"))


def sparse_vectors(notes: DataFrame) -> DataFrame:
    """note_id, feature, weight of unit length for notes (note_id, text, title, tags): the long form, which joins and adds up on any number of features."""
    rows = feature_lists(notes).select("note_id", F.explode("features").alias("f"))
    return unit(rows.groupBy("note_id", F.col("f.feature").alias("feature")).agg(F.sum("f.weight").alias("weight")))


def against(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """note_id, similarity with a query's vector (feature, weight): an equi-join on the features; the query's side is as small as its text."""
    q = query.select("feature", F.col("weight").alias("q"))
    return vectors.join(F.broadcast(q), "feature").groupBy("note_id").agg(F.greatest(F.sum(F.col("weight") * F.col("q")), F.lit(0.0)).alias("similarity"))


def hashed_vectors(terms: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """note_id, position, value of unit length: each distinct term of (note_id, term) adds ±(1 + ln(1 + count)) at its hash."""
    counts = terms.groupBy("note_id", "term").count()
    sign = F.when(T.fnv1a(F.concat("term", F.lit("#sign"))) % 2 == 0, 1.0).otherwise(-1.0)
    rows = counts.select("note_id", (T.fnv1a(F.col("term")) % dimensions).cast("int").alias("feature"), (sign * (1 + F.log1p("count"))).alias("weight"))
    return unit(rows.groupBy("note_id", "feature").agg(F.sum("weight").alias("weight"))).select("note_id", F.col("feature").alias("position"), F.col("weight").alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def marked(notes: DataFrame) -> DataFrame:
    """note_id, day, modifiers and completion of the notes (note_id, day, text, links, tags): all that the field takes from a text, so that no text is shuffled after it."""
    found, open_ = F.col("_found"), ["未完成", "没有完成", "还没", "尚未"]
    rows = bound(notes, {"_found": T.found(F.lower("text"), FIELD_ACTION, FIELD_BLOCKER, FIELD_COMPLETION, FIELD_NOVELTY, open_)})
    marks = {"action": T.holds(found, FIELD_ACTION), "blocker": T.holds(found, FIELD_BLOCKER), "completion_signal": T.holds(found, FIELD_COMPLETION), "novelty": T.holds(found, FIELD_NOVELTY), "wikilinked": F.size("links") > 0, "tagged": F.size("tags") > 0}
    done = T.holds(found, FIELD_COMPLETION) & ~T.holds(found, open_)
    return rows.select("note_id", "day", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in marks.items()])).alias("modifiers"), F.when(done, 0.45).otherwise(0.0).alias("completion"))


def field_hits(notes: DataFrame, similarities: DataFrame, today: Column, time_sigma: float = 30.0, semantic_sigma: float = 0.35) -> DataFrame:
    """The notes (as ``marked``) that a query raises (note_id, similarity, centrality): kernels of time and meaning, score, modifiers and the current they add to their day."""
    rows = notes.join(similarities, "note_id").where("similarity > 0")
    delta = F.greatest(F.datediff(today, "day"), F.lit(0))
    rows = rows.withColumn("time_weight", F.exp(-(delta * delta) / (2.0 * time_sigma * time_sigma))).withColumn(
        "semantic_weight", F.exp(-F.pow(1 - F.least("similarity", F.lit(1.0)), F.lit(2.0)) / (2.0 * semantic_sigma * semantic_sigma))
    )
    rows = rows.withColumn("score", F.col("similarity") * F.col("semantic_weight") * F.col("time_weight") * (1 + 0.25 * F.coalesce("centrality", F.lit(0.0)))).where("score > 0.001")
    boost = 1.0 + sum((F.when(F.array_contains("modifiers", n), b).otherwise(0.0) for n, b in (("action", 0.20), ("blocker", 0.30), ("novelty", 0.25))), F.lit(0.0))
    return rows.withColumn("current", F.col("score") * boost)
