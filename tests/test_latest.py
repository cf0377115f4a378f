from datetime import datetime

from cuewright.operators.latest import latest, latest_in_blocks

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_greatest_version_counts(spark):
    df = spark.createDataFrame([("a", 1, "old", T1), ("a", 1, "new", T2), ("a", 1, "none", None), ("b", 1, "only", None), (None, None, "x", T1), (None, None, "y", T2)], "m string, i int, text string, at timestamp")
    assert sorted(r.text for r in latest(df, ["m", "i"], "at").collect()) == ["new", "only", "y"]
    assert sorted(r.text for r in latest_in_blocks(df, "m", "i", "at").collect()) == ["new", "only"]


def test_ties_and_repeated_rows_give_one_row(spark):
    df = spark.createDataFrame([("a", 1, "x", T1)] * 5 + [("a", 1, "z", T1)], "m string, i int, text string, at timestamp")
    assert [r.text for r in latest(df, ["m", "i"], "at", ["text"]).collect()] == ["z"]
    assert latest_in_blocks(df, "m", "i", "at").count() == 1


def test_blocks_are_ordered_within_a_partition(spark):
    df = spark.range(10_000).selectExpr("'hot' AS m", "cast(9999 - id AS int) AS i", "timestamp'2024-01-01' AS at")
    rows = latest_in_blocks(df, "m", "i", "at", block=1000).rdd.glom().collect()
    for part in rows:
        keys = [(r.block, r.i) for r in part]
        assert keys == sorted(keys)
