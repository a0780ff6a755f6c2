"""Marks of answers against their sources."""

from quillspark.operators import citations as S


def test_codes(spark):
    sources = [(q, p, f"Title {p}", t) for q in range(1, 8) for p, t in ((1, "apples grow on trees in autumn"), (2, "fish swim in deep water"))]
    answers = [
        (1, "Apples grow on trees. [1] Fish swim deep [2]."),  # all right
        (2, "Apples grow on trees."),  # no mark
        (3, "Apples grow on trees [1]."),  # one source left out
        (4, "Fish swim in water [3]. Apples grow [1, 2]."),  # an unknown place, and one that says something else
        (5, "Fish swim in deep water (source: TITLE 2). Apples grow (source: title 9)."),
        (6, None),
        (7, "12:30 is [no mark], nor is [4x]. See [1]."),
        (8, "Nothing was given [1]."),
    ]
    got = {r.query_id: r for r in S.checked(spark.createDataFrame(answers, "query_id long, answer string"), spark.createDataFrame(sources, "query_id long, place int, title string, text string")).collect()}
    row = lambda q: (got[q].n_sources, got[q].n_marks, got[q].cited, got[q].unknown, got[q].wrong, got[q].citation_score, got[q].codes)
    assert row(1) == (2, 2, 2, 0, 0, 1.0, [])
    assert row(2) == row(6) == (2, 0, 0, 0, 0, 0.0, ["MISSING_CITATION"])
    assert row(3) == (2, 1, 1, 0, 0, 0.75, ["PARTIAL_CITATION"])
    assert row(4) == (2, 3, 1, 1, 1, 0.75, ["PARTIAL_CITATION", "UNKNOWN_CITATION", "WRONG_CITATION"])
    assert row(5) == (2, 2, 1, 1, 0, 0.75, ["PARTIAL_CITATION", "UNKNOWN_CITATION"])
    assert row(7)[:5] == (2, 1, 0, 0, 1) and row(8) == (0, 1, 0, 1, 0, 0.5, ["UNKNOWN_CITATION"])


def test_default_answer(spark):
    sources = spark.createDataFrame([(1, 2, "Second one."), (1, 1, "First one. ")], "query_id long, place int, sentence string")
    assert S.cited_answer(sources).first().answer == "First one. [1]\nSecond one. [2]"
