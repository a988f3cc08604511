from driftnote.functions.keys import link_key, link_keys, term_key, term_keys, text_key


def test_term_key():
    assert term_key("ＬＩＦ　Chain") == "lifchain"
    assert term_key("a​b") == "ab" and term_key(" \t") is None and term_key(None) is None and term_key("") is None


def test_link_key():
    assert link_key(" 10_Exp/Some Note.MD#head|alias") == "somenote"
    assert link_key("https://x.org/a") is None and link_key("#only") is None and link_key("a/b/") is None and link_key(None) is None
    assert link_key("x.md^block") == "x"


def test_text_key():
    assert text_key("A-b_c 1，２！é") == "abc12é" and text_key("") == "" and text_key(None) is None


def test_columns(spark):
    df = spark.createDataFrame([(1, ["B", "a", None, " ", "ｂ"]), (2, None), (3, [])], "id int, v array<string>")
    assert [r[0] for r in df.orderBy("id").select(term_keys("v")).collect()] == [["a", "b"], [], []]
    assert [r[0] for r in df.orderBy("id").select(link_keys("v")).collect()] == [["a", "b"], [], []]
