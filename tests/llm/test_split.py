import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm.split import limits, spans, split_texts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. ,\n—é👩‍!?x", max_size=300), st.integers(1, 60), st.data())
def test_pieces_fit_overlap_and_give_the_text_back(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    cuts = spans(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= limit for a, b in cuts)
    assert all(nxt[0] == b - overlap and nxt[0] > a for (a, b), nxt in zip(cuts, cuts[1:]))
    whole = text[: cuts[0][1]] + "".join(text[a + overlap : b] for a, b in cuts[1:])
    assert whole == text


def test_cuts_at_the_best_pause():
    text = "First sentence is here. Second one, with a clause, is longer. Third."
    assert [text[a:b] for a, b in spans(text, 40, 5)][0] == "First sentence is here. "
    assert spans("word " * 20, 23, 3)[0] == (0, 20)
    assert spans("x" * 50, 20, 4) == [(0, 20), (16, 36), (32, 50)]
    assert spans("We all saw it. He met Mr. Smith in town", 28, 0)[0] == (0, 15)  # a title ends no sentence


def test_a_cut_never_splits_a_character():
    family = "👩‍👩‍👧"
    for limit in range(12, 30):
        text = "x" * 9 + family * 10
        for _, b in spans(text, limit, 0)[:-1]:
            assert b < 9 or (b - 9) % len(family) == 0 or limit < 2 * len(family)


def test_table(spark):
    rows = [("a", 1, "one two three four", "k"), ("a", 1, "one two three four", "k"), ("b", 2, "short", "k"), ("c", 3, "", "k"), ("d", 4, " ", None), ("e", 5, None, "k"), (None, None, "x" * 25, "k")]
    df = spark.createDataFrame(rows, "id string, piece int, text string, key string")
    found = split_texts(df.withColumnRenamed("piece", "seg"), ["id", "seg"], "text", 10, 2)
    got = sorted(((r.id or "", r.piece, r.n_pieces, r.text) for r in found.collect()), key=str)
    assert sum(g[0] == "a" for g in got) == 2 * [g for g in got if g[0] == "a"][0][2]
    assert ("b", 0, 1, "short") in got and ("c", 0, 1, "") in got and ("d", 0, 1, " ") in got and not any(g[0] == "e" for g in got)
    assert [g[3] for g in got if g[0] == ""] == ["x" * 10, "x" * 10, "x" * 9]
    assert split_texts(df.limit(0), ["id"], "text", 10, 2).count() == 0


@pytest.mark.parametrize(("limit", "overlap"), [(0, 0), (5, 5), (5, -1)])
def test_impossible_limits(spark, limit, overlap):
    with pytest.raises(ValueError):
        spans("text", limit, overlap)
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([("a", "b")], "id string, text string"), ["id"], "text", limit, overlap)


def test_limits(spark):
    rows = [("segment", 400, 60), ("segment", 300, 50), ("transcript", 10, None), (None, 5, 1), ("other", None, 1)]
    table = spark.createDataFrame(rows, "item_kind string, max_chars int, overlap_chars int")
    assert limits(table) == {"segment": (300, 50), "transcript": (10, 0)} and limits(table.limit(0)) == {}
    with pytest.raises(ValueError):
        limits(table, most=4)


def test_very_long_text():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "end. ", "x, "]) for _ in range(200_000))
    cuts = spans(text, 6000, 300)
    assert all(b - a <= 6000 for a, b in cuts) and cuts[-1][1] == len(text)
