import json

import pytest

from cuewright.functions.text import CUT_MARK
from cuewright.plans import render

SEG = "media_id string, seg_idx int, start_ms double, end_ms double, text string"


def texts(spark, rows, kind, most=10_000, **options):
    df = spark.createDataFrame(rows, SEG).repartition(3)
    return {r.media_id: r.text for r in render.transcripts(df, kind, most, **options).collect()}


ROWS = [("m", 0, 0.0, 2500.0, " Hello "), ("m", 1, 2500.0, 5100.0, 'say "x"\n😀'), ("n", 0, 32852.309, 35100.00000000001, None)]


def test_text(spark):
    assert texts(spark, ROWS, "text") == {"m": '[0.0–2.5] Hello\n[2.5–5.1] say "x"\n😀', "n": "[32.9–35.1] "}


def test_srt(spark):
    assert texts(spark, ROWS, "srt")["m"] == '1\n00:00:00,000 --> 00:00:02,500\nHello\n\n2\n00:00:02,500 --> 00:00:05,100\nsay "x"\n😀'


def test_json_is_laid_out_like_a_pretty_printer(spark):
    got = texts(spark, ROWS, "json")
    for m, wanted in (("m", [(0, 2500, "Hello"), (2500, 5100, 'say "x"\n😀')]), ("n", [(32852, 35100, "")])):
        assert got[m] == json.dumps({"segments": [{"start": a, "end": b, "text": t} for a, b, t in wanted]}, indent=2, ensure_ascii=False)


@pytest.mark.parametrize("kind", ["text", "srt", "json"])
@pytest.mark.parametrize("most", [10, 500, 3000, 100_000])
def test_any_cut_equals_cutting_the_whole(spark, kind, most):
    rows = [("m", i * 3, i * 1000.0, i * 1000.0 + 900, f"segment number {i} 😀" * (i % 3)) for i in range(400)] + [("m", 1201, None, 3.0, "unplaced")]
    whole = texts(spark, rows, kind, 1 << 30)["m"]
    data = whole.encode("utf-16-le")
    n, keep = len(data) // 2, most * 6 // 10
    wanted = whole if n <= most else data[: 2 * keep].decode("utf-16-le", "ignore") + CUT_MARK + data[-2 * (most - keep) :].decode("utf-16-le", "ignore")
    assert texts(spark, rows, kind, most)["m"] == wanted


def test_empty_table(spark):
    assert texts(spark, [], "text") == {}


def test_media_block(spark):
    schema = "path string, type string, duration_sec double, width int, height int, video_codec string, fps double, audio_codec string, sample_rate int, channels int, file_size_bytes bigint, acceleration struct<backend:string,hardware:boolean>"
    rows = [("/a.mp4", "video", 5.0, 320, 240, "h264", 29.97, "aac", 44100, 2, 123, ("software", False)), ("/b.png", "image", 0.0, 16, 0, None, 0.0, "", 0, 0, 9, None)]
    df = spark.createDataFrame(rows, schema)
    blocks = [r[0] for r in df.select(render.media_block()).collect()]
    assert blocks[0] == "File: /a.mp4\nType: video\nDuration: 5.0s\nResolution: 320x240\nFPS: 29.97\nVideo codec: h264\nAudio codec: aac\nSample rate: 44100Hz\nChannels: 2\nSize: 123 bytes\nAcceleration: software (software)"
    assert blocks[1] == "File: /b.png\nType: image\nDuration: 0.0s\nResolution: 16x0\nFPS: 0.00\nSample rate: 0Hz\nChannels: 0\nSize: 9 bytes"
    heads = [r[0] for r in df.selectExpr("*", "2 AS n").select(render.understand_block("n")).collect()]
    assert "Acceleration" not in heads[0] and heads[0].count("\n") == 11 and "FPS" not in heads[1] and "Sample" not in heads[1]
    assert [r[0] for r in df.select(render.cli_line()).collect()] == ["[Video] 5s 320x240 h264/aac 123 B", "[Image] 16x0 9 B"]


def test_labels(spark):
    df = spark.createDataFrame([(0.0, 0.8, [0.1, 0.7])], "a double, b double, t array<double>")
    from pyspark.sql import functions as F

    assert df.select(render.grid_label(F.lit(1), F.lit(6), "a", "b", "t")).first()[0] == "Grid 1/6 covers 0.000s-0.800s. Tile timestamps: 00:00:00.100, 00:00:00.700"
    assert df.select(render.frame_label("b")).first()[0] == "Frame at 00:00:00.800 (0.800s)"


def test_no_speech():
    assert render.no_speech() == "No speech detected."
    assert render.no_speech(3, None) == "No speech detected in the requested window (3s–end)."
    assert render.no_speech(None, 2.5) == "No speech detected in the requested window (0s–2.5)."
