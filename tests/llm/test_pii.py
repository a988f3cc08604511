import pytest

from driftnote.llm import pii

PARTS = [("柏", "family", "zh"), ("尉迟", "family", "zh"), ("清瑶", "given", "zh"), ("Stone", "family", "latin"), ("Vasterra", "family", "latin"), ("Hope", "given", "latin"), ("Joss", "given", "latin")]


def kinds(text):
    spans = next(pii.redactions([text], pii.trained(tuple(sorted(PARTS))), pii.name_pattern(PARTS)))
    return [(k, text[a:b]) for a, b, k in spans]


@pytest.mark.parametrize(
    "text, want",
    [
        ("联系人柏清瑶，+86 178 0000 4026，ok", ["name", "phone"]),
        ("mail lab_k9@post.example.org or joss (at) vault (dot) test.", ["email", "email"]),
        ("met HOPE STONE and Vasterra, Joss", ["name", "name"]),
        ("form 987-65-4320 and 00008231D", ["identity"]),
        ("call (555) 555-0119 or 06 39 98 74 14 or +44 7700 900 129", ["phone"] * 3),
        ("to 18 Alderwick St., Apt 19B and Lindenweg 29a, 01999 Oberquell", ["address", "address"]),
        ("寄送至望原市东渚区白鹭洲路282号2号楼503室。", ["address"]),
        ("SN 297069342713, 时间戳 20240915071952, 批次 1242-35-304, 192.0.2.30", []),
        ("Hope preset the stone. 第7路15号通道 lane 4 of 2 road tests git@vault 分支", []),
        ("ｊｏｓｓ＠ｖａｕｌｔ．ｔｅｓｔ １８５００００１８８９", ["email", "phone"]),
    ],
)
def test_kinds(text, want):
    assert [k for k, _ in kinds(text)] == want


def test_checks():
    assert pii.resident_ok("11010519491231002X") and not pii.resident_ok("110105194912310021")
    assert pii.letter_ok("12345678", "Z") and not pii.letter_ok("12345678", "A")
    assert pii.phone_shape("+49 (0)30 23125-543") == 4 and pii.phone_shape("12345678901234") == 0


def test_held_out():
    model, names = pii.trained(tuple(sorted(PARTS))), pii.name_pattern(PARTS)
    made = pii.training_texts(PARTS, 400, 99)
    hit = want = got = 0
    for (_, spans), found in zip(made, pii.redactions([t for t, _ in made], model, names)):
        want += len(spans)
        got += len(found)
        hit += sum(any(k == kind and a < e and s < b for a, b, k in found) for s, e, kind in spans)
    assert hit / want > 0.95 and hit / got > 0.95


def test_frames(spark):
    rows = [(1, "hi joss@vault.test and joss@vault.test"), (1, "hi joss@vault.test and joss@vault.test"), (2, None), (3, ""), (4, "filler " * 100_000 + "柏清瑶"), (None, "柏清瑶")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "id long, text string, kind string, occurrence int")
    found = pii.find_personal(df, "id", "text", PARTS).collect()
    assert sorted((str(r["id"]), r["kind"], r["occurrence"]) for r in found) == [("1", "email", 1)] * 2 + [("1", "email", 2)] * 2 + [("4", "name", 1), ("None", "name", 1)]
    out = sorted((str(r["id"]), r["redacted"]) for r in pii.redact_personal(df.where("id < 4"), "id", "text", PARTS).collect() if r["redacted"] is not None)
    assert out[0] == ("1", "hi [EMAIL] and [EMAIL]") and out[-1] == ("3", "")
    assert pii.find_personal(df.limit(0), "id", "text", []).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("form 2024-05-11 123-45-6789 ok", ("identity", "123-45-6789")),
        ("form 12 12345678Z ok", ("identity", "12345678Z")),
        ("dial 07 12345678Z ok", ("identity", "12345678Z")),
        ("tel 1 2 3 4 5 6 7 8 9 10 13812345678 ok", ("phone", "13812345678")),
        ("tel 1111 2222 3333 4444 5555 6666 13812345678 ok", ("phone", "13812345678")),
        ("tel " + "12 " * 3000 + "13812345678 ok", ("phone", "13812345678")),
        ("id " + "12 " * 3000 + "110105 19491231 002X ok", ("identity", "110105 19491231 002X")),
    ],
)
def test_numbers_side_by_side(text, want):
    assert want in {(k, text[a:b]) for a, b, k in pii.candidates(text, None)}
    assert want in kinds(text)
