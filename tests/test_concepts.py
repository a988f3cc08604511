"""The greedy choice of concepts past its pool."""

from driftnote.operators.relations import selected_concepts


def test_goes_on_past_the_pool(spark):
    rows = [("ab", 9, 50.0), *[(f"{c}ab", 8, 40.0 - i) for i, c in enumerate("pqrstu")], ("xyz", 7, 5.0), ("xy", 6, 4.0), ("abk", 10, 3.0), ("mn", 3, 3.0), ("z", 1, 1.0)]
    scored = spark.createDataFrame(rows, "term string, count long, score double")
    assert selected_concepts(scored, 4, 3) == selected_concepts(scored, 4, 100) == ["ab", "xyz", "mn", "abk"]
    assert selected_concepts(scored, 9, 2) == ["ab", "xyz", "mn", "abk"]
    assert selected_concepts(scored, 1, 1) == ["ab"]
    assert selected_concepts(scored.limit(0), 4, 3) == []
