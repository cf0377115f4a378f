import random
from datetime import datetime

import pytest

from cuewright.llm.runs import collapse
from cuewright.llm.speech import alike, canonical, misspelt

SCHEMA = "media_id string, seg_idx int, start_ms double, end_ms double, text string, turn boolean, ingested_at timestamp, entity string, block int, n int"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def rows(texts, medium="m", at=T1):
    return [(medium, i, i * 1000.0, i * 1000.0 + 900, t, None, at, "x", 5, 6) for i, t in enumerate(texts)]


def found(spark, data, **options):
    return sorted((r.media_id, r.first_seg_idx, r.last_seg_idx, r.n) for r in collapse(spark.createDataFrame(data, SCHEMA), **options).collect())


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Thank you.", "thank  you", True), ("Uh, yes.", "YES!", True), ("[00:01:02] Hear, hear.", "Hear hear (coughs)", True), ("What abuot it?", "What about it?", True),
        ("You know, we can.", "We can.", True), ("Thaank you", "Thank you", True), ("Item 9 was withdrawn.", "Item 10 was withdrawn.", False), ("The wall is wet.", "The well is wet.", False),
        ("[applause]", "(Applause.)", True), ("[applause]", "[laughter]", False), ("♪ ♪", "♪", True), ("Cars stop.", "Car stop.", False), ("No.", "Yes.", False), ("12:30 Go on.", "Go on.", True), ("At 10:45 we left", "At 10:46 we left", False), ("Plase take your seats.", "Please take your sets.", True), ("Back on air shorttly.", "Back on air shotly.", True),
    ],
)
def test_what_says_the_same(a, b, same):
    assert alike(*canonical([a, b])) == same


def test_slips():
    assert misspelt("nalund", "naulnd") and misspelt("nalund", "nalunnd") and misspelt("nalund", "naund")
    assert not misspelt("gate", "date") and not misspelt("12", "21") and not misspelt("car", "cars") and not misspelt("a", "")


def test_runs(spark):
    data = rows(["A b.", "a b", None, " ", "A, b!", "C d", "E f", "e f"])
    assert found(spark, data, least=2) == [("m", 0, 4, 3), ("m", 6, 7, 2)]
    assert found(spark, data) == [("m", 0, 4, 3), ("m", 5, 5, 1), ("m", 6, 7, 2)]
    [run] = [r for r in collapse(spark.createDataFrame(data, SCHEMA), least=3).collect()]
    assert (run.start_ms, run.end_ms, run.duration_ms, run.text) == (0.0, 4900.0, 4900.0, "A b.")


def test_nulls_ties_versions_and_times(spark):
    data = rows(["x y", "x y"]) + rows(["x y", "other"], at=T2) + rows(["x y", "other"], at=T2) + [(None, 0, 0.0, 1.0, "x y", None, T1, "x", 5, 6), ("m", None, 0.0, 1.0, "x y", None, T1, "x", 5, 6)]
    assert found(spark, data, least=2) == []
    timeless = [("n", i, None, None, "x y", None, None, None, None, None) for i in range(3)]
    [run] = collapse(spark.createDataFrame(timeless, SCHEMA), least=2).collect()
    assert (run.n, run.start_ms, run.end_ms, run.duration_ms) == (3, None, None, None)
    assert collapse(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_blocks_change_nothing(spark, block):
    rng = random.Random(4)
    data = rows([rng.choice(["a b", "A b.", "uh, a b", "c d", None]) for _ in range(120)]) + rows(["same thing"] * 50, "hot") + rows([None, "", "...", "x" * 100_000], "odd")
    says = {}
    for m, i, *_, in data:
        says.setdefault(m, []).append(i)
    assert found(spark, data, least=2, block=block) == found(spark, data, least=2)
    assert ("hot", 0, 49, 50) in found(spark, data, least=2, block=block)
