import math
import random

import pytest

from cuewright.operators import intervals
from cuewright.operators.intervals import SHARD, coverage

SCHEMA = "m string, a double, b double, bucket int, period string, kind string"


def brute(rows, join_below, max_gap):
    out = set()
    by = {}
    for m, a, b in rows:
        if m is None or a is None or b is None or not (math.isfinite(a) and math.isfinite(b)):
            continue
        a, b = math.floor(a + 0.5), math.floor(b + 0.5)
        if b > a:
            by.setdefault(m, []).append((a, b))
    for m, spans in by.items():
        periods = []
        for a, b in sorted(spans):
            if periods and a - periods[-1][1] < join_below:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out |= {(m, "period", a, b) for a, b in periods}
        out |= {(m, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:]) if max_gap is None or y[0] - x[1] <= max_gap}
    return out


def run(spark, rows, join_below=1, max_gap=None, partitions=3):
    df = spark.createDataFrame([(m, a, b, 7, "x", "y") for m, a, b in rows], SCHEMA).repartition(partitions)
    found = [tuple(r) for r in coverage(df, "m", "a", "b", join_below, max_gap).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", range(6))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    span = rng.choice([2_000, 50_000, 5 * SHARD])
    rows = []
    for _ in range(400):
        a = rng.uniform(-span, span)
        rows.append((rng.choice(["a", "b", "hot", "hot", "hot"]), a, a + rng.choice([0.2, 1, 30, 900, span / 40]) * rng.random()))
    rows += rng.sample(rows, 50)
    join_below = rng.choice([1, 20, 500])
    max_gap = rng.choice([None, 300, 600_000])
    assert run(spark, rows, join_below, max_gap) == brute(rows, join_below, max_gap)


def test_shard_borders(spark):
    rows = [("a", SHARD - 10.0, SHARD + 0.0), ("a", SHARD + 499.0, SHARD + 600.0), ("a", SHARD + 1100.0, 3.0 * SHARD), ("b", 0.0, 1.0), ("b", 5.0 * SHARD, 5.0 * SHARD + 1)]
    assert run(spark, rows, 500) == brute(rows, 500, None)


def test_unusable_bounds_cover_nothing(spark):
    rows = [("a", None, 5.0), ("a", 1.0, None), (None, 1.0, 9.0), ("a", 9.0, 3.0), ("a", 4.0, 4.0), ("a", math.nan, 8.0), ("a", 1.0, math.inf), ("a", -math.inf, 2.0)]
    assert run(spark, rows) == set()
    assert run(spark, [*rows, ("a", 10.0, 20.0)]) == {("a", "period", 10, 20)}


def test_gap_limits_are_included(spark):
    rows = [("a", 0.0, 10.0), ("a", 510.0, 520.0), ("a", 600_520.0, 600_530.0), ("a", 1_200_531.0, 1_200_540.0), ("a", 1_201_039.0, 1_201_050.0)]
    found = run(spark, rows, 500, 600_000)
    assert {f for f in found if f[1] == "gap"} == {("a", "gap", 10, 510), ("a", "gap", 520, 600_520)}
    assert ("a", "period", 1_200_531, 1_201_050) in found


def test_empty_table_and_integer_entities(spark):
    assert coverage(spark.createDataFrame([], SCHEMA), "m", "a", "b").count() == 0
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9)], "m bigint, a int, b int")
    assert [tuple(r) for r in coverage(df, "m", "a", "b").collect()] == [(1, "period", 0, 9)]


def test_rejects_holes_longer_than_a_shard(spark):
    with pytest.raises(ValueError):
        coverage(spark.createDataFrame([], SCHEMA), "m", "a", "b", join_below=SHARD)


def test_plan_shuffles_containers_not_rows(spark):
    df = spark.range(100_000).selectExpr("'hot' AS m", "cast(id AS double) AS a", "cast(id + 2 AS double) AS b")
    found = coverage(df, "m", "a", "b").collect()
    assert [tuple(r) for r in found] == [("hot", "period", 0, 100_001)]
    ids, low, high = intervals.unite(*(x for x in __import__("numpy").array([[0, 0, 1], [5, 0, 3], [9, 6, 4]])), 1)
    assert ids.tolist() == [0, 1] and low.tolist() == [0, 3] and high.tolist() == [9, 4]


@pytest.mark.parametrize("seed", range(4))
def test_intervals_of_any_length(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        a = float(rng.randrange(-(1 << rng.randrange(10, 52)), 1 << rng.randrange(10, 52)))
        rows.append((rng.choice(["a", "b", "hot"]), a, a + rng.randrange(1, 1 << rng.randrange(1, 52 if rng.random() < 0.2 else 34))))
    rows += [("c", -float(1 << 52), float(1 << 52)), ("c", 5.0, 9.0), ("d", 0.0, 200.0 * SHARD), ("d", 10.0 * SHARD, 20.0 * SHARD + 7), ("d", 200.0 * SHARD + 300, 400.0 * SHARD), ("d", 64.0 * SHARD, 128.0 * SHARD)]
    assert run(spark, rows, 500) == brute(rows, 500, None)


def test_long_intervals_cost_a_bounded_number_of_rows():
    import numpy as np

    first = np.array([-(1 << 31), -(1 << 30) + 17, 0, 3, 64, 64]) - np.array([0, 0, 0, 0, 0, 1])
    stop = np.array([1 << 31, (1 << 30) - 5, 128, 132, 4096 * 3, 4096 * 3 + 1])
    met = [set() for _ in first]
    rows = np.zeros(len(first), int)
    for level, who, begin, end in intervals._levels(first, stop):
        np.add.at(rows, who, end - begin)
        for k, a, b in zip(who.tolist(), begin.tolist(), end.tolist()):
            met[k].add((a * 64**level, b * 64**level))
    assert rows.max() <= 800
    for k, ranges in enumerate(met):
        ranges = sorted(r for r in ranges if r[0] < r[1])
        assert ranges[0][0] == first[k] and ranges[-1][1] == stop[k] and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))


def test_a_wrong_promise_is_an_error(spark):
    df = spark.createDataFrame([("a", 0.0, 1e15, 7, "x", "y")], SCHEMA)
    with pytest.raises(Exception, match="ruled out"):
        coverage(df, "m", "a", "b", long=False).collect()
