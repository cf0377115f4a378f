import random

import pytest

from cuewright.operators import align, asof, sampling
from cuewright.options import GridOptions

SEG = "media_id string, seg_idx int, start_ms double, end_ms double"
WIN = "media_id string, grid_idx int, start_sec double, end_sec double"


def assigned(spark, segs, wins, dense=False):
    found = align.assign_to_windows(spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(segs)], SEG), spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(wins)], WIN), dense=dense)
    return {r.seg_idx: r.grid_idx for r in found.collect()}


@pytest.mark.parametrize("dense", [False, True])
def test_fixtures(spark, dense):
    assert assigned(spark, [(2000, 5000)], [(0, 3), (3, 6)], dense) == {0: 1}
    assert assigned(spark, [(2000, 4000)], [(0, 3), (3, 6)], dense) == {0: 0}  # a tie goes to the lower one
    assert assigned(spark, [(10000, 11000)], [(0, 5)], dense) == {0: None}
    assert assigned(spark, [], [(0, 5)], dense) == {}
    assert assigned(spark, [(0, 1000)], [], dense) == {0: None}
    assert assigned(spark, [(0, 1500), (2500, 3500), (4100, 5000), (9000, 9500)], [(0, 2), (2, 4), (4, 6)], dense) == {0: 0, 1: 1, 2: 2, 3: None}
    assert assigned(spark, [(1000, 1000), (5000, 3000)], [(0, 6)], dense) == {0: None, 1: None}


@pytest.mark.parametrize("seed", range(3))
def test_both_strategies_match_brute_force(spark, seed):
    rng = random.Random(seed)
    segs = [(a := rng.uniform(0, 9e6), a + rng.uniform(0, 2e5)) for _ in range(150)]
    wins = [(a := rng.uniform(0, 9e3), a + rng.choice([5, 60, 900])) for _ in range(40)]

    def best(s):
        overlaps = [max(0.0, min(s[1], b * 1000) - max(s[0], a * 1000)) for a, b in wins]
        return overlaps.index(max(overlaps)) if max(overlaps) > 0 else None

    wanted = {i: best(s) for i, s in enumerate(segs)}
    assert assigned(spark, segs, wins, False) == wanted
    assert assigned(spark, segs, wins, True) == wanted


def test_nulls_and_repeated_rows(spark):
    segs = spark.createDataFrame([("m", 0, None, 5.0), ("m", 1, 0.0, None), (None, 2, 0.0, 5.0), ("m", 3, 0.0, 5.0), ("m", 3, 0.0, 5.0)], SEG)
    wins = spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 1, None, 1.0), (None, 2, 0.0, 1.0)], WIN)
    found = align.assign_to_windows(segs, wins).collect()
    assert sorted((r.seg_idx, r.grid_idx) for r in found if r.grid_idx is not None) == [(3, 0), (3, 0)] and len(found) == 5


def test_positions_keep_empty_windows(spark):
    segs, wins = spark.createDataFrame([("m", 1, 0.0, 900.0), ("m", 0, 0.0, 800.0)], SEG), spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 1, 1.0, 2.0)], WIN)
    found = align.positions_by_window(align.assign_to_windows(segs, wins), wins).collect()
    assert sorted((r.grid_idx, r.positions) for r in found) == [(0, [0, 1]), (1, [])]


@pytest.mark.parametrize(("a", "b", "kept"), [(3, None, "BCD"), (None, 3, "AB"), (2, 6, "BC"), (3, 5, "BC"), (100, 200, ""), (None, None, "ABCD")])
def test_window_filter(spark, a, b, kept):
    df = spark.createDataFrame([(n, i * 2000.0, i * 2000.0 + 2000) for i, n in enumerate("ABCD")], "n string, start_ms double, end_ms double")
    assert "".join(sorted(r.n for r in align.in_window(df, a, b).collect())) == kept


def plan(spark, opts, duration=60.0, width=320, height=240, kind="video"):
    media = spark.createDataFrame([("m", kind, duration, width, height)], "media_id string, type string, duration_sec double, width int, height int")
    return sampling.plan(media, opts).orderBy("grid_idx").collect()


def test_sampling_times_are_bin_centres(spark):
    [row] = plan(spark, GridOptions(max_grids=1, cols=2, rows=2, start_sec=0, end_sec=0.8, seconds_per_frame=0.2))
    assert [round(x, 3) for x in row.timestamps_sec] == [0.1, 0.3, 0.5, 0.7]


def test_sampling_problems_are_rows(spark):
    [row] = plan(spark, GridOptions(max_grids=1, cols=1, rows=1, end_sec=0.2, seconds_per_frame=1))
    assert row.error.code == "INVALID_SAMPLING" and row.timestamps_sec is None
    assert plan(spark, GridOptions(), kind="audio")[0].error.code == "NO_VIDEO_STREAM"
    assert plan(spark, GridOptions(), duration=0.0)[0].error.code == "INVALID_SAMPLING"
    assert plan(spark, GridOptions(), duration=None)[0].error.code == "INVALID_SAMPLING"
    assert plan(spark, GridOptions(sampling_strategy="scene"), duration=100.0)[0].error.code == "INVALID_SAMPLING"
    assert len(plan(spark, GridOptions(sampling_strategy="scene"), duration=2000.0)) == 6


def test_portrait_defaults(spark):
    rows = plan(spark, GridOptions(), width=240, height=320)
    assert (rows[0].n_cols, rows[0].n_rows, rows[0].thumb_width, len(rows[0].timestamps_sec)) == (3, 3, 120, 9)
    assert plan(spark, GridOptions(cols=5), width=240, height=320)[0].n_cols == 5


def test_slack_is_shared_and_times_stay_inside(spark):
    rows = plan(spark, GridOptions(max_grids=2, cols=1, rows=2, seconds_per_grid=10, seconds_per_frame=1))
    assert [r.grid_start_sec for r in rows] == [24.0, 34.0]
    for r in plan(spark, GridOptions(max_grids=3)):
        assert all(0 <= x <= 59.999 for x in r.timestamps_sec) and list(r.timestamps_sec) == sorted(r.timestamps_sec)


@pytest.mark.parametrize("block", [1.0, 7.0, 3600.0])
def test_asof_matches_brute_force(spark, block):
    rng = random.Random(5)
    frames = [(m, round(rng.uniform(0, 60), 2)) for m in "ab" for _ in range(40)] + [("a", 30.0), ("a", 30.0), (None, 3.0), ("a", None)]
    targets = [(m, i, rng.choice([30.0, round(rng.uniform(-5, 70), 2)])) for m in "abc" for i in range(60)] + [("a", 99, None), (None, 98, 3.0)]
    found = asof.frames_at(spark.createDataFrame(frames, "media_id string, pts_sec double"), spark.createDataFrame(targets, "media_id string, i int, lookup_sec double"), block=block)

    def look(m, x):
        own = [p for k, p in frames if k == m and p is not None] if m is not None and x is not None else []
        after, before = [p for p in own if p >= x], [p for p in own if p < x]
        return min(after) if after else (max(before) if before else None)

    got = {(r.media_id, r.i): r.frame_sec for r in found.collect()}
    assert got == {(m, i): look(m, x) for m, i, x in targets}


def test_targets_are_clamped(spark):
    df = spark.createDataFrame([(10.0, 9.9), (10.0, 3.0), (0.1, 5.0), (None, 4.0)], "duration_sec double, timestamp_sec double")
    assert [r.lookup_sec for r in asof.clamp_targets(df).collect()] == [9.8, 3.0, 0.0, 4.0]


def test_no_row_grows_with_a_window(spark):
    """One medium has nine tenths of all segments, in one window: its positions come in blocks."""
    segs = spark.range(3_000).selectExpr("if(id % 10 = 0, concat('m', id), 'hot') AS media_id", "cast(id AS int) AS seg_idx", "id * 10.0D AS start_ms", "id * 10.0D + 9 AS end_ms")
    wins = spark.createDataFrame([("hot", 0, 0.0, 100.0), ("hot", 1, 200.0, 300.0), ("m10", 0, 0.0, 1.0)], "media_id string, grid_idx int, start_sec double, end_sec double")
    found = align.positions_by_window(align.assign_to_windows(segs, wins), wins, block=256).collect()
    assert max(len(r.positions) for r in found) <= 256
    assert sorted(p for r in found if r.media_id == "hot" for p in r.positions) == [i for i in range(3_000) if i % 10]
    assert {(r.media_id, r.grid_idx, r.block, len(r.positions)) for r in found if (r.media_id, r.grid_idx) != ("hot", 0)} == {("hot", 1, None, 0), ("m10", 0, 0, 1)}
