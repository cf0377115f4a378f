from datetime import datetime, timedelta

from cuewright.streaming import arrivals
from tests.test_sources import SRT

DAY = datetime(2024, 1, 1)


def drain(stream, tmp_path, mode="append"):
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def write(spark, folder, rows):
    spark.createDataFrame(rows, "media_id string, seg_idx int, start_ms double, end_ms double, text string, turn boolean, ingested_at timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_subtitle_files_are_parsed_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text(SRT)
    stream = arrivals.subtitle_files(spark, str(tmp_path / "in"))
    assert drain(stream, tmp_path).count() == 3
    (tmp_path / "in" / "b.srt").write_text(SRT)
    assert drain(stream, tmp_path).count() == 6


def test_repeated_rows_count_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("m", i, 0.0, 1.0, "x", None, DAY + timedelta(hours=i)) for i in range(5)]
    write(spark, folder, rows + rows[:2])
    stream = arrivals.once(arrivals.segments(spark, folder), ["media_id", "seg_idx"])
    assert drain(stream, tmp_path).count() == 5
    write(spark, folder, rows)
    assert drain(stream, tmp_path).count() == 5


def test_windows_close_behind_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [("m", i, 0.0, 1.0, "ab", None, DAY + timedelta(minutes=20 * i)) for i in range(6)])
    write(spark, folder, [("m", 99, 0.0, 1.0, "ab", None, DAY + timedelta(days=30))])
    found = drain(arrivals.arrivals_per_medium(arrivals.segments(spark, folder, 1)), tmp_path).collect()
    assert sorted((r["from"], r.n_segments, r.n_chars) for r in found) == [(DAY, 3, 6), (DAY + timedelta(hours=1), 3, 6)]


def test_sessions_end_with_a_pause(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [("m", i, 0.0, 1.0, "x", None, DAY + timedelta(minutes=m)) for i, m in enumerate((0, 10, 15, 100, 110))])
    write(spark, folder, [("n", 0, 0.0, 1.0, "x", None, DAY + timedelta(days=3))])
    found = drain(arrivals.sessions(arrivals.segments(spark, folder, 1), "media_id", "ingested_at"), tmp_path).collect()
    assert sorted(r.n_events for r in found) == [2, 3]
