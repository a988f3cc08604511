from random import Random

import pytest

from driftnote.llm import language as L

WORDS = {
    "en": "the night session kept its bias while we read another sheet and the curve was stable".split(),
    "de": "wir haben gesehen dass die Messung nicht zusammen passt und der Zettel noch fehlt".split(),
    "fr": "nous avons laissé la courbe des événements parce que le niveau n'a pas changé".split(),
    "zh": list("我们把实验记录放进资料库然后再看一次结果如何变化"),
}


def text(lang, r, n=30):
    return ("" if lang == "zh" else " ").join(r.choice(WORDS[lang]) for _ in range(n))


def rows(seed, n=240):
    r = Random(seed)
    return [(lang := r.choice(list(WORDS)), text(lang, r)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    r = rows(1)
    wrong = [(("en" if k % 20 == 0 else lang), t) for k, (lang, t) in enumerate(r)]
    return L.train([t for _, t in wrong], [lang for lang, _ in wrong])


def test_held_out(model):
    held = rows(2)
    got, sure = model.predict([t for _, t in held])
    assert sum(model.languages[g] == lang for g, (lang, _) in zip(got, held)) / len(held) > 0.98
    assert ((sure > 0) & (sure <= 1)).all()


def test_calibration_keeps_errors():
    """Held-out rows with wrong labels stay in: their share is found, and confidence says how often the model is right about the true language."""
    r = Random(5)
    truth = [(lang := r.choice(list(WORDS)), text(lang, r, r.choice([2, 3, 30]))) for _ in range(1600)]
    labels = [r.choice([x for x in WORDS if x != lang]) if r.random() < 0.08 else lang for lang, _ in truth]
    m = L.train([t for _, t in truth], labels, documents=[k // 2 for k in range(len(truth))])
    assert 0.02 < m.wrong_labels < 0.16
    assert sum(x[2] for x in m.reliability) > 200  # a fifth of the documents, whatever their labels
    agreed = sum(x[2] * x[4] for x in m.reliability) / sum(x[2] for x in m.reliability)
    assert agreed < 0.97
    fresh = [(lang := r.choice(list(WORDS)), text(lang, r, r.choice([2, 3, 30]))) for _ in range(1500)]
    got, sure = m.predict([t for _, t in fresh])
    right = [m.languages[g] == lang for g, (lang, _) in zip(got, fresh)]
    for low, high in ((0.0, 0.9), (0.9, 1.01)):
        at = [k for k, s in enumerate(sure) if low <= s < high]
        if len(at) >= 50:
            assert abs(sum(right[k] for k in at) / len(at) - sum(sure[k] for k in at) / len(at)) < 0.12


def test_segments():
    t = "front\n\n---\n" + "x" * 60 + "\n \n```\n" + "y" * 60 + "\n\n" + "z" * 39 + "\n\n" + "w" * 40 + " 1234"
    assert [(k, n) for k, n, _ in L.segments(t)] == [(4, 40)]
    assert L.segments(None) == [] and L.segments("") == []


def test_frames(spark, model):
    r = Random(9)
    de, en, zh = text("de", r), text("en", r), text("zh", r, 60)
    docs = [(1, f"{de}\n\n{en}\n\n{de}", "en"), (2, None, "de"), (3, "", None), (4, "short", "fr"), (5, zh * 20_000, None), (1, f"{de}\n\n{en}\n\n{de}", "en")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "id long, text string, given string, lang string")
    got = sorted((x["id"], x["segment_no"], x["lang"], x["named"]) for x in L.detect_languages(df, "id", "text", model, "given").collect() if x["id"] != 5)
    want = sorted([(1, -1, "de", "en"), (1, 0, "de", "en"), (1, 1, "en", "en"), (1, 2, "de", "en")] * 2)
    assert got == want
    five = L.detect_languages(df.where("id = 5"), "id", "text", model).collect()
    assert {(x["segment_no"], x["lang"]) for x in five} == {(-1, "zh"), (0, "zh")}
    assert L.detect_languages(df.limit(0), "id", "text", model).count() == 0


def test_blocks(model, monkeypatch):
    t = [text("fr", Random(3), 200), "ab", text("zh", Random(4), 90)]
    whole = model.logits(t)
    monkeypatch.setattr(L, "BLOCK", 37)
    assert abs(model.logits(t) - whole).max() < 1e-9


def test_no_labels():
    with pytest.raises(ValueError):
        L.train(["", "x"], ["", "en"])
