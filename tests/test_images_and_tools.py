import base64
import json

import numpy as np
import pytest

from cuewright import cli
from cuewright.errors import MediaError
from cuewright.functions import images
from cuewright.operators import frames
from cuewright.options import GridOptions, frame_times, probe_limit, setting
from cuewright.plans import facade
from cuewright.sources import headers
from tests.test_sources import SRT, Downloads, media, mp4  # noqa: F401


class Colours:
    """A decoder whose frames tell their time by colour."""

    def frame(self, path, at_sec):
        return np.full((24, 32, 3), int(at_sec * 40) % 256, np.uint8)


class Broken:
    def frame(self, path, at_sec):
        raise RuntimeError("no such device")


def decoded(spark, tmp_path, data):
    (tmp_path / "x.jpg").write_bytes(data)
    r = spark.read.format("image").load(str(tmp_path / "x.jpg")).select("image.*").first()
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[..., ::-1]


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (17, 33), (100, 64)])
@pytest.mark.parametrize("quality", [75, 95])
def test_jpeg_is_readable(spark, tmp_path, shape, quality):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    pixels = np.stack([x * 255 / max(shape[1], 2), y * 255 / max(shape[0], 2), (x + y) % 256], -1).astype(np.uint8)
    got = decoded(spark, tmp_path, images.encode_jpeg(pixels, quality))
    assert got.shape == pixels.shape and np.abs(got.astype(int) - pixels).mean() < 6


def test_noise_survives_the_encoder(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (64, 64, 3), np.uint8)
    assert np.abs(decoded(spark, tmp_path, images.encode_jpeg(pixels, 98)).astype(int) - pixels).mean() < 8


def test_png_round_trip():
    pixels = np.random.default_rng(2).integers(0, 256, (9, 7, 3), np.uint8)
    assert (images.decode(headers.png_bytes(7, 9, pixels.tobytes())) == pixels).all()
    with pytest.raises(MediaError):
        images.decode(b"no picture")


def test_geometry():
    picture = np.full((100, 200, 3), 9, np.uint8)
    assert images.shrink(picture, 50).shape == (25, 50, 3) and images.shrink(picture, 500).shape == picture.shape
    boxed, filled = images.fit(picture, 60, 60), images.fit(picture, 60, 60, "cover")
    assert boxed.shape == filled.shape == (60, 60, 3) and boxed[0].max() == 0 and filled.min() == 9
    assert images.with_banner(picture, "00:00:01.000").shape == (134, 200, 3)
    assert images.with_banner(np.zeros((4, 5, 3), np.uint8), "00:00:01.000").shape == (38, 5, 3)
    assert images.compose([picture] * 5, 2, 40).shape == (60, 80, 3)
    with pytest.raises(MediaError):
        images.compose([], 2, 40)


def test_folder_of_frames_and_fallback(tmp_path):
    folder = tmp_path / "c.mp4.frames"
    folder.mkdir()
    for ms in (0, 1000, 2500):
        (folder / f"{ms:09d}.png").write_bytes(headers.png_bytes(2, 2, bytes([ms // 100]) * 12))
    provider, path = frames.FrameFolder(), str(tmp_path / "c.mp4")
    assert [int(provider.frame(path, t)[0, 0, 0]) for t in (0, 0.5, 1.0, 1.1, 9)] == [0, 10, 10, 25, 25]
    assert frames.Fallback(Broken(), provider).frame(path, 0.5)[0, 0, 0] == 10
    with pytest.raises(MediaError):
        provider.frame(str(tmp_path / "d.mp4"), 0)


def test_tools(spark, media):  # noqa: F811
    clip = str(media / "clip.mp4")
    (media / "clip.srt").write_text(SRT)
    report = facade.probe_media(spark, [str(media / "*.png"), clip, str(media / "gone.mp4")])["content"][0]["text"]
    assert report.startswith("Probed 3 file(s): 2 succeeded, 1 failed.\n\nFile: ") and "Error: [FILE_NOT_FOUND]" in report
    assert facade.probe_media(spark, ["  "])["isError"] and facade.probe_media(spark, [clip, str(media / "red.png")], max_files=1)["isError"]

    text = facade.get_transcript(spark, clip)["content"][0]["text"]
    assert text.startswith("[1.0–3.5] Hello there\n[4.0–6.0] World")
    assert json.loads(facade.get_transcript(spark, clip, "json", 0, 2)["content"][0]["text"])["segments"] == [{"start": 1000, "end": 3500, "text": "Hello there"}]
    assert facade.get_transcript(spark, clip, start_sec=100, end_sec=200)["content"][0]["text"] == "No speech detected in the requested window (100s–200)."
    assert facade.get_transcript(spark, str(media / "tone.wav"))["content"][0]["text"].startswith("[NO_AUDIO_STREAM]")
    assert facade.get_transcript(spark, clip, "doc")["isError"]

    grids = facade.get_video_grids(spark, clip, GridOptions(max_grids=2, cols=2, rows=2, thumb_width=64), provider=Colours())["content"]
    assert [c["type"] for c in grids] == ["text", "text", "image", "text", "image", "text"] and grids[1]["text"].startswith("Grid 1/2 covers 0.000s-2.500s. Tile timestamps: 00:00:00.313")
    assert headers.image(base64.b64decode(grids[2]["data"])).width == 128
    assert facade.get_video_grids(spark, clip, GridOptions(max_grids=2, cols=2, rows=2, thumb_width=64), 900, Colours())["isError"]
    assert len(facade.get_video_grids(spark, clip, GridOptions(cols=2, rows=2, thumb_width=64), 5000, Colours())["content"]) < 14
    assert facade.get_video_grids(spark, str(media / "tone.wav"), provider=Colours())["content"][0]["text"].startswith("[NO_VIDEO_STREAM]")
    assert "no such device" in facade.get_video_grids(spark, clip, provider=Broken())["content"][0]["text"]

    shots = facade.get_frames(spark, clip, [4.99, 0.5], provider=Colours())["content"]
    assert [c.get("text") for c in shots][::2][:2] == ["Frame at 00:00:04.990 (4.990s)", "Frame at 00:00:00.500 (0.500s)"]
    assert facade.get_frames(spark, clip, [], provider=Colours())["isError"] and facade.get_frames(spark, clip, [0.5], 200, Colours())["isError"]

    whole = facade.understand_media(spark, clip, GridOptions(max_grids=2, cols=2, rows=2, thumb_width=64), provider=Colours())["content"]
    assert [c["type"] for c in whole] == ["text", "text", "text", "image", "text", "text", "image", "text", "text"]
    assert whole[1]["text"] == "\n--- TRANSCRIPT 0.0s–2.5s ---\n[1.0–3.5] Hello there" and "remaining" in whole[7]["text"]
    total = len(json.dumps({"content": whole[:-1]}, ensure_ascii=False, separators=(",", ":")).encode("utf-16-le")) // 2
    assert whole[-1]["text"].startswith(f"Payload: {total} chars total")
    picture = facade.understand_media(spark, str(media / "red.png"))["content"]
    assert [c["type"] for c in picture] == ["text", "image", "text"]
    assert facade.understand_media(spark, clip, max_total_chars=50, provider=Colours())["content"][0]["text"].startswith("[BUDGET_EXCEEDED]")


def test_url_tools(spark, tmp_path):
    out = facade.fetch_video(spark, "http://x", str(tmp_path), include_video=True, fetcher=Downloads(("subs", "video")))["content"]
    assert out[0]["text"].startswith("Title: T\nDuration: 12s\nUploader: C\nURL: http://x\n\nSubtitles: ") and "Video: " in out[0]["text"]
    assert out[1]["text"].startswith("\n--- TRANSCRIPT (from subtitles) ---\n[1.0–3.5] Hello there")
    assert facade.get_transcript(spark, "http://x", cache=str(tmp_path), fetcher=Downloads(("subs",)))["content"][0]["text"].startswith("[1.0")
    assert facade.get_frames(spark, "http://x", [1.0])["content"][0]["text"].startswith("[YT_DLP_NOT_FOUND]")
    assert "fetch_video" not in facade.available_tools(facade.urls.CommandFetcher("no-such-command"))


def test_options(monkeypatch):
    for bad in ({"cols": 9}, {"rows": 0}, {"max_grids": 0}, {"start_sec": -1}, {"seconds_per_frame": 0}, {"scene_threshold": 2}, {"aspect_mode": "x"}, {"sampling_strategy": "x"}):
        with pytest.raises(MediaError):
            GridOptions(**bad)
    with pytest.raises(TypeError):
        GridOptions.of(colums=1)
    assert GridOptions.of(cols=None, rows=2) == GridOptions(rows=2)
    assert probe_limit(None) == 50 and probe_limit(999) == 200
    for times in ([], [-1.0], [0.0] * 21):
        with pytest.raises(MediaError):
            frame_times(times)
    monkeypatch.setenv("CUEWRIGHT_MAX_GRIDS", "3")
    assert GridOptions().grids == 3
    monkeypatch.setenv("CUEWRIGHT_MAX_GRIDS", "3x")
    with pytest.raises(ValueError):
        setting("MAX_GRIDS", 6)


def test_cli(media, capsys):  # noqa: F811
    assert cli.main([str(media / "clip.mp4")]) == 0 and "[Video] 5s 320x240 h264/aac" in capsys.readouterr().out
    assert cli.main([str(media / "gone")]) == 1 and "[FILE_NOT_FOUND]" in capsys.readouterr().err
