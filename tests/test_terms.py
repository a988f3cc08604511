"""Terms, tokens, relation evidence and drafts against small known cases."""

from pyspark.sql import functions as F

from driftnote.functions import text as T
from driftnote.operators import evidence as E
from driftnote.operators import insight as I
from driftnote.operators import relations as R
from driftnote.tables import bound


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_named_terms(spark):
    got = one(spark, T.named_terms, "这个阈值 bandpass filter - a 42")
    assert "阈值" in got and "bandpass filter" in got and not any("这个" in t for t in got) and "a" not in got
    assert one(spark, T.named_terms, "") == [] and one(spark, T.named_terms, None) is None


def test_slot_tokens(spark):
    got = one(spark, lambda c: T.slot_tokens(c, ["今天"]), "今天测波形 LIF 3.5 mV 20%")
    assert {"lif", "3.5mv", "20%", "波形", "测波形"} <= set(got) and "今天" not in got


def test_found_is_the_lists(spark):
    words = ["LIF", "lif", "脉冲", "脉冲率", "a.b"]
    found = lambda c: T.found(F.lower(c), words)
    assert sorted(one(spark, found, "有LIF脉冲率 A.B")) == ["a.b", "lif", "脉冲", "脉冲率"]
    df = bound(spark.createDataFrame([("LIF",)], "t string"), {"f": found(F.col("t"))})
    assert df.select(T.held(F.col("f"), words).alias("x")).first()["x"] == ["LIF", "lif"]
    assert one(spark, found, None) == [] and one(spark, found, "") == []


def test_relation_evidence(spark):
    df = spark.createDataFrame([(1, "负阻测不到 3 mV"), (2, "没有话题"), (3, "简历的面试时间")], "note_id int, block string")
    got = {r["note_id"]: r for r in E.relation_evidence(df).collect()}
    assert set(got) == {1, 3} and got[1]["roles"] == ["failure", "metric"] and "负阻" in got[1]["topics"]


def test_a_word_counts_for_each_list(spark):
    """恢复 is a word of two domains: both count."""
    df = spark.createDataFrame([("突然发现身体恢复的节律",)], "block string")
    r = I.inspiration_fragments(df).first()
    assert set(r["domains"]) == {"EEG", "Health"} and r["domain_hits"] == 4
    only = I.inspiration_fragments(spark.createDataFrame([("LIF脉冲阈值 负阻斜率偏置放大 论文章节",)], "block string")).first()
    assert only["roles"] == ["domain_evidence"]


def test_drafts(spark):
    rows = [(1, "a", "b", "supports", 9.0, "h1"), (2, "a", "b", "Blocks", None, None), (3, " ", "b", "causes", 5.0, "x"), (4, "a", "c", None, 9.0, "y"), (5, "a", "c", "odd", 0.2, "z")]
    checked = R.checked_relations(spark.createDataFrame(rows, "seq int, source string, target string, relation_type string, score double, hypothesis string"), 0.5)
    got = {r["seq"]: (r["type"], r["reason"]) for r in checked.collect()}
    assert got == {1: ("support", None), 2: ("inhibition", None), 3: ("causal", None), 4: ("unknown", "unknown relation_type"), 5: ("odd", "confidence")}
    drafts = {r["topic"]: r for r in R.policy_drafts(checked.where("reason is null")).collect()}
    assert drafts["b"]["threshold_delta"] == 0.3 and drafts["b"]["priority"] == "P0" and drafts["b"]["action"] == "recover_first" and drafts["b"]["reasons"] == ["h1", "a -[inhibition]-> b"]
    assert set(drafts) == {"a", "b"}
