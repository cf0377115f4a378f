import hashlib
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.errors import MediaError
from cuewright.functions import images
from cuewright.sources import asr, files, headers, subtitles, urls


def box(name, body):
    return struct.pack(">I4s", len(body) + 8, name) + body


def mp4(path, width=320, height=240, frames=50, scale=1000, duration=5000):
    def track(kind, entry, extra=b""):
        mdhd = box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, scale, duration, 0, 0))
        hdlr = box(b"hdlr", struct.pack(">II4s", 0, 0, kind) + bytes(13))
        stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + entry) + extra)
        return box(b"trak", box(b"mdia", mdhd + hdlr + box(b"minf", stbl)))

    video = struct.pack(">I4s", 86, b"avc1") + bytes(24) + struct.pack(">HH", width, height) + bytes(50)
    sound = struct.pack(">I4s", 36, b"mp4a") + bytes(16) + struct.pack(">HH", 2, 16) + bytes(4) + struct.pack(">I", 44100 << 16)
    stts = box(b"stts", struct.pack(">IIII", 0, 1, frames, duration // frames))
    moov = box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, scale, duration) + bytes(80)) + track(b"vide", video, stts) + track(b"soun", sound))
    path.write_bytes(box(b"ftyp", b"isom\0\0\2\0") + box(b"mdat", b"x" * 100) + moov)


@pytest.fixture
def media(tmp_path):
    with wave.open(str(tmp_path / "tone.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\0\0" * 16000)
    (tmp_path / "red.png").write_bytes(headers.png_bytes(16, 16, bytes([255, 0, 0]) * 256))
    mp4(tmp_path / "clip.mp4")
    (tmp_path / "junk.bin").write_bytes(b"nothing known")
    (tmp_path / "short.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt ")
    return tmp_path


def test_probe_isolates_errors(spark, media):
    names = ["red.png", "tone.wav", "clip.mp4", "junk.bin", "short.wav", "missing.mp4"]
    rows = files.probe(files.paths_frame(spark, [str(media / n) for n in names])).orderBy("ordinal").collect()
    png, wav, clip, junk, short, missing = rows
    assert (png.info.type, png.info.duration_sec, png.info.width, png.info.height) == ("image", 0.0, 16, 16)
    assert (wav.info.type, wav.info.duration_sec, wav.info.sample_rate, wav.info.channels, wav.info.width) == ("audio", 1.0, 16000, 1, None)
    assert (clip.info.type, clip.info.width, clip.info.height, clip.info.fps, clip.info.video_codec, clip.info.audio_codec) == ("video", 320, 240, 10.0, "h264", "aac")
    assert clip.info.acceleration.backend == "software" and clip.info.duration_sec == 5.0
    assert junk.error.code == short.error.code == "UNSUPPORTED_FORMAT" and missing.error.code == "FILE_NOT_FOUND"
    assert png.error is None and junk.info is None


def test_more_headers(tmp_path):
    size = lambda data: headers.image(data)
    assert (size(b"GIF89a" + struct.pack("<HH", 7, 9) + bytes(9)).width) == 7
    assert (size(b"BM" + bytes(16) + struct.pack("<ii", 5, -6) + bytes(9)).height) == 6
    jpeg = images.encode_jpeg(np.zeros((11, 13, 3), np.uint8))
    assert (size(jpeg).width, size(jpeg).height) == (13, 11)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert (size(webp).width, size(webp).height) == (100, 50)
    flac = b"fLaC" + bytes(14) + (44100 << 44 | 1 << 41 | 88200).to_bytes(8, "big") + bytes(20)
    (tmp_path / "a.flac").write_bytes(flac)
    assert (headers.probe(str(tmp_path / "a.flac")).duration_sec, headers.probe(str(tmp_path / "a.flac")).channels) == (2.0, 2)
    (tmp_path / "a.mp3").write_bytes((b"\xff\xfb\x90\x00" + bytes(413)) * 100)
    mp3 = headers.probe(str(tmp_path / "a.mp3"))
    assert mp3.audio_codec == "mp3" and mp3.sample_rate == 44100 and abs(mp3.duration_sec - 41700 * 8 / 128000) < 0.01


def test_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for n in ("b.wav", "a.wav", "c.txt"):
        (tmp_path / n).write_text("x")
    at = lambda *names: [str(tmp_path / n) for n in names]
    assert files.expand_paths(["c.txt", " *.wav ", "a.wav", "", "gone.wav"]) == at("c.txt", "a.wav", "b.wav", "gone.wav")
    assert files.expand_paths("{b,a}.wav") == at("b.wav", "a.wav")
    for bad in ([], ["  "], ["*.mkv"]):
        with pytest.raises(MediaError) as e:
            files.expand_paths(bad)
        assert e.value.code == "INVALID_SAMPLING"


@pytest.mark.parametrize("size", [0, 100, 70_000, 131_072, 131_073, 300_000])
def test_fingerprint(spark, tmp_path, size):
    data = os.urandom(size)
    (tmp_path / "f").write_bytes(data)
    wanted = hashlib.sha256(str(size).encode() + data[:65536] + (data[-65536:] if size > 131072 else b"")).hexdigest()
    assert files.file_fingerprint(str(tmp_path / "f")) == wanted
    table = spark.createDataFrame([(bytearray(data), size)], "content binary, length long")
    assert table.select(files.fingerprint("content", "length")).first()[0] == wanted


def test_kinds_and_stat(spark, media):
    rows = spark.read.format("binaryFile").load(str(media)).select("path", files.kind_of("content", "path").alias("kind")).collect()
    kinds = {os.path.basename(r.path): r.kind for r in rows}
    assert kinds == {"red.png": "image", "tone.wav": "av", "clip.mp4": "av", "junk.bin": "unknown", "short.wav": "av"}
    assert spark.range(1).select(files.kind_of(F.lit(b"<svg"), F.lit("/x/pic.SVG"))).first()[0] == "image"
    stat = files.stat(spark, str(media))
    assert {os.path.basename(r.path): r.file_size_bytes for r in stat.collect()}["junk.bin"] == 13
    assert "content" not in stat._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


SRT = "1\n00:00:01,000 --> 00:00:03,500\n<i>Hello</i>\nthere\n\n2\n00:00:04.000 --> 00:00:06.000\n World \n\n3\n00:00:07,000 --> 00:00:08,000\n<b></b>\n\n4\n01:30:45,123 --> 01:30:50,456\nlate"
VTT = "﻿WEBVTT\r\n\r\nSTYLE\r\n::cue { color: red }\r\n\r\nNOTE 00:00:00.000 --> 00:00:01.000\r\n\r\nid\r\n00:01.000 --> 00:03.500 align:start\r\nOne\r\n\r\n00:00:04.000 --> 00:00:06.000\r\nTwo"


@pytest.mark.parametrize(
    ("path", "content", "cues"),
    [
        ("a.srt", SRT, [(1000, 3500, "Hello there"), (4000, 6000, "World"), (5445123, 5450456, "late")]),
        ("a.VTT", VTT, [(1000, 3500, "One"), (4000, 6000, "Two")]),
        ("a.srt", "", []),
        ("a.ass", "[Script]\nx", [(0, 0, "[Script]\nx")]),
        ("a.srt", None, []),
    ],
)
def test_subtitles(spark, path, content, cues):
    rows = subtitles.parse(spark.createDataFrame([(path, content, 1)], "path string, content string, seg int")).orderBy("seg_idx").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in rows] == cues and [r.seg_idx for r in rows] == list(range(len(cues)))
    if content:
        found = asr.parse_text(content, os.path.splitext(path)[1].lower())
        assert [(c["start_ms"], c["end_ms"], c["text"]) for c in found] == cues


def test_transcription_is_kept_by_fingerprint_and_model(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"sound")
    (tmp_path / "a.srt").write_text(SRT)
    (tmp_path / "b.wav").write_bytes(b"other")
    table = spark.createDataFrame([("a", str(tmp_path / "a.wav")), ("b", str(tmp_path / "b.wav")), ("c", str(tmp_path / "c.wav"))], "media_id string, path string")
    done = asr.transcribe(table).cache()
    rows = {r.media_id: r for r in done.collect()}
    assert len(rows["a"].segments) == 3 and rows["b"].error.code == "NO_AUDIO_STREAM" and rows["c"].error.code == "FILE_NOT_FOUND"
    assert asr.segment_rows(done).count() == 3
    (tmp_path / "a.srt").unlink()
    again = {r.media_id: r for r in asr.transcribe(table, known=done.where("segments IS NOT NULL")).collect()}
    assert len(again["a"].segments) == 3
    other = {r.media_id: r for r in asr.transcribe(table, model="tiny", known=done.where("segments IS NOT NULL")).collect()}
    assert other["a"].error.code == "NO_AUDIO_STREAM"
    with pytest.raises(MediaError):
        asr.model_name("huge")


class Downloads:
    """A fetcher of canned files."""

    def __init__(self, have=("video",)):
        self.have = have

    def metadata(self, url):
        return '{"title":"T","duration":12,"channel":"C","view_count":"x","subtitles":{"en":[],"de":[]},"automatic_captions":{"de":[],"fr":[]}}'

    def download(self, url, kind, target):
        if kind in self.have:
            with open(os.path.join(target, kind + urls.EXTENSIONS[kind][0]), "w") as f:
                f.write(SRT if kind == "subs" else "data")
        elif kind == "audio":
            raise MediaError("YT_DLP_FAILED", "no sound")


def test_urls(spark, tmp_path):
    cache = str(tmp_path)
    assert urls.hash_of(" http://x ") == urls.hash_of("http://x") and len(urls.hash_of("http://x")) == 16
    first = urls.fetch("http://x", "video", cache, Downloads())
    assert first.endswith("video.mp4") and urls.fetch("http://x", "video", cache, Downloads(())) == first
    assert urls.fetch("http://x", "subs", cache, Downloads()) is None
    assert urls.local_path("http://x", cache, Downloads(), audio=True) == first
    with pytest.raises(MediaError):
        urls.fetch("http://y", "thumb", cache, Downloads())
    df = spark.createDataFrame([("http://x",), ("/local",), ("http://z",), ("http://x",)], "path string")
    rows = sorted(urls.resolve(df, cache, Downloads(())).collect(), key=lambda r: r.path)
    assert [r.local for r in rows] == ["/local", first, first, None] and rows[3].error.code == "YT_DLP_FAILED"
    info = urls.parse_metadata(spark.createDataFrame([("http://x", Downloads().metadata("")), ("u", "broken")], "url string, json string"), "json", "url").collect()
    assert (info[0].title, info[0].duration_sec, info[0].uploader, info[0].view_count, info[0].subtitle_languages, info[0].has_subtitles) == ("T", 12.0, "C", 0, ["en", "de", "fr"], True)
    assert (info[1].title, info[1].duration_sec, info[1].subtitle_languages) == ("", 0.0, [])
    assert urls.CommandFetcher("no-such-command").available() is False
    with pytest.raises(MediaError) as e:
        urls.CommandFetcher("no-such-command").metadata("http://x")
    assert e.value.code == "YT_DLP_NOT_FOUND"


def test_pictures_without_magic_bytes(tmp_path):
    """By extension: drawings, plain and packed, raw pictures and layered ones; what has no header is an error."""
    import gzip

    svg = b'<?xml version="1.0"?><!-- x --><svg xmlns="http://www.w3.org/2000/svg" width="2in" height="48pt" viewBox="0 0 9 9">'
    boxed = b"<svg viewBox='0 0 640 480' width='100%'>"
    tiff = b"II*\0" + struct.pack("<IHHHII", 8, 2, 256, 3, 1, 300) + struct.pack("<HHII", 257, 3, 1, 200)
    raw = b"IIU\0" + tiff[4:]
    psd = b"8BPS" + struct.pack(">H6xHII", 1, 3, 70, 90)
    names = {"a.svg": (svg, 192, 64), "b.SVG": (boxed, 640, 480), "c.svgz": (gzip.compress(svg), 192, 64), "d.rw2": (raw, 300, 200), "e.dng": (tiff, 300, 200), "f.psd": (psd, 90, 70)}
    for name, (body, width, height) in names.items():
        (tmp_path / name).write_bytes(body)
        info = headers.probe(str(tmp_path / name))
        assert (info.type, info.width, info.height) == ("image", width, height), name
        assert headers.probe_bytes(body, name) == info
    for name, body in (("g.svg", b"<html>"), ("h.cr2", b""), ("i.txt", svg), ("j.svgz", b"\x1f\x8bxx")):
        with pytest.raises(MediaError):
            headers.probe_bytes(body, name)


def test_contents_are_probed_one_by_one(spark):
    rows = spark.createDataFrame([(1, "a.svg", bytearray(b'<svg width="3" height="4">')), (2, "b", bytearray(b"nothing")), (3, None, None), (4, "c.svgz", bytearray(b"\x1f\x8bxx"))], "k int, path string, content binary")
    found = {r.k: (r.info.width if r.info else None, r.error.code if r.error else None) for r in files.probe_content(rows, "k").collect()}
    assert found == {1: (3, None), 2: (None, "UNSUPPORTED_FORMAT"), 3: (None, "FILE_NOT_FOUND"), 4: (None, "UNSUPPORTED_FORMAT")}
    assert files.probe_content(rows.limit(0), "k").count() == 0
