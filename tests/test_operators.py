from datetime import date

from pyspark.sql import functions as F

from driftnote.functions import text as T
from driftnote.operators.components import components
from driftnote.operators.evidence import block_evidence, note_blocks
from driftnote.operators.graph import resolve
from driftnote.operators.memory import slots
from driftnote.operators.policy import folded_feedback, merged_policies
from driftnote.sources import packets, sinks, vault


def test_signal_recovery_is_no_health(spark):
    df = spark.createDataFrame([(1, "LIF 链路的 PSD 波形恢复，测试 EEG 数据"), (2, "只见了导师"), (3, None), (4, "")], "note_id int, text string")
    rows = {(r["note_id"], r["state"]): r for r in block_evidence(note_blocks(df)).collect()}
    assert rows[1, "Experiment"]["disambiguation"] == "signal_recovery_as_experiment_evidence"
    assert rows[1, "Experiment"]["score"] > rows[1, "Health"]["score"] if (1, "Health") in rows else True
    assert {k[0] for k in rows} <= {1, 2}


def test_text(spark):
    df = spark.createDataFrame([("---\na: 1\n---\nA [[T|al]] b。短。 - one two three；x" + " y" * 60,), (None,), ("",)], "t string")
    blocks = [r[0] for r in df.select(T.blocks(T.normalized(F.col("t")))).collect()]
    assert blocks[0][0] == "A T b" and blocks[0][1] == "one two three" and blocks[1] is None and blocks[2] == []
    snip = df.select(T.snippet(F.col("t"), 20)).first()[0]
    assert len(snip) == 20 and snip.endswith("…")
    links = spark.createDataFrame([("[[ a ]] [[a|x]] [[b#h]] #t1 #1no x#y",)], "t string").select(T.wikilinks(F.col("t")), T.hashtags(F.col("t"))).first()
    assert links[0] == ["a", "b"] and links[1] == ["t1"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (None, 1), (7, None)] + [(100 + i, 101 + i) for i in range(60)], "src int, dst int")
    got = {r["id"]: r["component"] for r in components(e).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and got[9] == got[8] == 8 and got[5] == 5 and {got[i] for i in range(100, 161)} == {100} and 7 not in got
    assert components(e.limit(0)).count() == 0


def test_resolve(spark):
    links = spark.createDataFrame([("note",), ("deep/note.md",), ("x/gone#h",), (None,), ("note",), ("#a",)], "link string")
    paths = spark.createDataFrame([("a/b/note.md",), ("note.md",), ("deep/note.md",), (None,)], "path string")
    got = {r["link"]: r["path"] for r in resolve(links, paths).collect()}
    assert got == {"note": "note.md", "deep/note.md": "note.md", "x/gone#h": None} or got == {"note": "note.md", "deep/note.md": "deep/note.md", "x/gone#h": None}


def test_slots(spark):
    rows = [("k", date(2024, 1, 1 + i), i, [1.0, 0.0, 0.0] if i % 2 else [0.0, 1.0, 0.0]) for i in range(6)]
    got = slots(spark.createDataFrame(rows, "key string, day date, seq bigint, vector array<double>"), "key", 2).orderBy("seq").collect()
    assert [r["slot"] for r in got] == [0, 1, 0, 1, 0, 1] and max(r["loss"] for r in got) < 1e-9


def test_policies(spark):
    f = spark.createDataFrame([(1, "a", "too_early"), (2, "a", "useful"), (3, "a", "odd"), (1, "b", "mute"), (1, None, "mute"), (1, " ", "done")], "seq int, topic string, label string")
    got = {r["topic"]: r for r in folded_feedback(f).collect()}
    assert set(got) == {"a", "b"} and got["a"]["threshold_delta"] == 0.5 and got["a"]["cooldown_days"] == 1 and got["a"]["feedback_count"] == 3 and got["b"]["muted"]
    p = spark.createDataFrame([(1, "a", 1.0, "P0", False, 2, 1), (2, "a", -0.5, None, True, 1, 2)], "seq int, topic string, threshold_delta double, priority string, muted boolean, cooldown_days int, feedback_count int")
    m = merged_policies(p).first()
    assert (m["threshold_delta"], m["priority"], m["muted"], m["cooldown_days"], m["feedback_count"]) == (0.5, "P0", True, 2, 3)


def test_vault(spark, tmp_path):
    for p, t in {"2024-01-01.md": "one", "sub/2024-01-01.md": "two", "2024-01-03.md": "three " * 10, "2024-02-31.md": "no such day", ".obsidian/2024-01-02.md": "x", "a b/笔记+.md": "内容" * 20}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t, encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe ok")
    v = vault.read_vault(spark, str(tmp_path))
    assert {r["path"] for r in v.collect()} == {"2024-01-01.md", "sub/2024-01-01.md", "2024-01-03.md", "2024-02-31.md", "a b/笔记+.md", "bad.md"}
    got = vault.daily_notes(v, "2024-01-31", 5).orderBy("day").collect()
    assert [(str(r["day"]), r["text"][:3]) for r in got] == [("2024-01-01", "one"), ("2024-01-03", "thr")]
    assert vault.daily_notes(v, "2024-01-31", 0).count() == 0
    assert {r["path"] for r in vault.recent_notes(v, "2024-01-31", 90).collect()} == {"2024-01-03.md"}
    assert vault.scanned(v, ["bad.md"]).count() == 5


def test_packets(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"spikes": [{"id": "x", "V": 2}, {"spike_id": "y"}], "other": 1}')
    (tmp_path / "b.json").write_text('[{"id": "x", "V": 3}]')
    (tmp_path / "c.json").write_text("{broken")
    rows = packets.fields(packets.read_packets(spark, str(tmp_path)), {"id": ("string", ["spike_id", "id"]), "v": ("double", ["V"])})
    assert sorted((r["source"], r["id"], r["v"]) for r in rows.collect()) == [("", "x", 3.0), ("spikes", "x", 2.0), ("spikes", "y", None)] or rows.count() == 3
    assert packets.first_of_each(rows, "id").count() == 2
    lines = "# t\n- [x] first\n  - status: done\n  - 反馈：有用\n- [ ] second\n  status: open".split("\n")
    got = packets.checked_records(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).orderBy("record").collect()
    assert [(r["checked"], r["title"], r["fields"]) for r in got] == [(True, "first", {"status": "done", "反馈": "有用"}), (False, "second", {"status": "open"})]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b|x", 1), ("a\ny", None)], "name string, n int")
    sinks.write_packets(df, str(tmp_path / "p"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "p")).collect()) == ['{"name":"a\\ny"}', '{"name":"b|x","n":1}']
    sinks.write_markdown(df, "T", [F.col("name")], str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["# T", "", "| name | n |", "| --- | --- |", "| a y |  |", "| b\\|x | 1 |"]
    sinks.save_state(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
