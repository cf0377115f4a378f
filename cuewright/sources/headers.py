"""Headers of media files: what kind, how long, how large, which codecs. Only headers are read."""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass
from io import BytesIO
from typing import BinaryIO

from cuewright.errors import MediaError

#: Magic bytes in hex, as patterns from the start of a file.
IMAGE_MAGIC = ("89504E470D0A1A0A", "FFD8FF", "47494638[37]", "424D", "52494646.{8}57454250", "49492A00", "4D4D002A", "00000100", ".{8}66747970(6865|6D696631|61766966)")
AV_MAGIC = (
    "52494646.{8}57415645", "52494646.{8}41564920", "494433", "FFF[B3A2]", "FFF[19]", "4F676753", "664C6143", "1A45DFA3",
    ".{8}66747970", ".{8}6D6F6F76", "464F524D.{8}41494646", "2E736E64", "3026B275", "000001B[A3]", "464C56", "2321414D52",
)
#: Image formats without magic bytes of their own.
IMAGE_EXTENSIONS = [".svg", ".svgz", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".psd"]


@dataclass
class Info:
    type: str = "unknown"
    duration_sec: float = 0.0
    width: int | None = None
    height: int | None = None
    video_codec: str | None = None
    fps: float | None = None
    audio_codec: str | None = None
    sample_rate: int | None = None
    channels: int | None = None
    acceleration: dict | None = None


def _kind(head: bytes) -> str | None:
    code = head[:16].hex().upper()
    for kind, marks in (("image", IMAGE_MAGIC), ("av", AV_MAGIC)):
        if any(re.match(mark, code) for mark in marks):
            return kind
    return None


def probe(path: str) -> Info:
    """Metadata of a file by its header; ``UNSUPPORTED_FORMAT`` if it has none we know."""
    with open(path, "rb") as f:
        return probe_stream(f, os.stat(path).st_size, path)


def probe_bytes(content: bytes, path: str = "") -> Info:
    """The same of a file's content."""
    return probe_stream(BytesIO(content), len(content), path)


def probe_stream(f: BinaryIO, size: int, path: str) -> Info:
    head = f.read(65_536)
    kind = _kind(head)
    if kind is None and os.path.splitext(path)[1].lower() in IMAGE_EXTENSIONS:
        kind = "image"
    try:
        info = image(head, f) if kind == "image" else _av(head, f, size)
    except (struct.error, zlib.error, IndexError, ValueError) as bad:
        raise MediaError("UNSUPPORTED_FORMAT", f"broken header in {path}", bad) from bad
    if info is None:
        raise MediaError("UNSUPPORTED_FORMAT", f"unknown format: {path}")
    if info.type == "video":
        info.acceleration = {"backend": "software", "hardware": False}
    return info


# ------------------------------------------------------------------ images


def image(head: bytes, f: BinaryIO | None = None) -> Info | None:
    size = _image_size(head, f)
    return Info(type="image", width=size[0], height=size[1]) if size and size[0] and size[1] else None


def _image_size(head: bytes, f: BinaryIO | None) -> tuple[int, int] | None:
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", head[16:24])
    if head[:3] == b"GIF":
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM":
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return _webp(head)
    if head[:3] == b"\xff\xd8\xff":
        data = head + (f.read(4 << 20) if f is not None else b"")
        return _jpeg(data)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(head)
    if head[:4] == b"\0\0\1\0":
        return head[6] or 256, head[7] or 256
    if head[:4] == b"8BPS":
        height, width = struct.unpack(">II", head[14:22])
        return width, height
    if head[:2] == b"\x1f\x8b" or b"<svg" in head:
        return _svg(zlib.decompressobj(31).decompress(head, 65_536) if head[:2] == b"\x1f\x8b" else head)
    if head[:2] in (b"II", b"MM"):  # raw pictures are TIFF files, some with a number of their own
        return _tiff(head)
    return None


_SVG = re.compile(r"<svg\b[^>]*>", re.S)
#: Pixels of a unit of length, at 96 to an inch.
_UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54}


def _svg(head: bytes) -> tuple[int, int] | None:
    """Width and height of a drawing: its own, else those of its view box."""
    tag = _SVG.search(head.decode("utf-8", "replace"))
    if tag is None:
        return None
    own = [re.search(rf"\s{name}\s*=\s*[\"']\s*([\d.]+)\s*([a-z]*)\s*[\"']", tag[0]) for name in ("width", "height")]
    if all(m and m[2] in _UNITS for m in own):
        width, height = (float(m[1]) * _UNITS[m[2]] for m in own)
    elif box := re.search(r"\sviewBox\s*=\s*[\"']([^\"']*)[\"']", tag[0]):
        width, height = map(float, re.split(r"[\s,]+", box[1].strip())[2:4])
    else:
        return None
    return round(width), round(height)


def _webp(head: bytes) -> tuple[int, int] | None:
    kind = head[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if kind == b"VP8L":
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", head[26:30])
        return width & 0x3FFF, height & 0x3FFF
    return None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 1:
            at += 1 if mark == 0xFF else 2
            continue
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + length
    return None


def _tiff(head: bytes) -> tuple[int, int] | None:
    order = "<" if head[:2] == b"II" else ">"
    at = struct.unpack(order + "I", head[4:8])[0]
    if at + 2 > len(head):
        return None
    found: dict[int, int] = {}
    for k in range(struct.unpack(order + "H", head[at : at + 2])[0]):
        tag, kind, _, value = struct.unpack(order + "HHI4s", head[at + 2 + 12 * k : at + 14 + 12 * k])
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return (found[256], found[257]) if len(found) == 2 else None


# ------------------------------------------------------------------ audio and video


def _av(head: bytes, f: BinaryIO, size: int) -> Info | None:
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return _wav(f, size)
    if head[:4] == b"fLaC":
        return _flac(head)
    if head[:4] == b"OggS":
        return _ogg(head, f, size)
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        return _mp4(f, size)
    if head[:4] == b"\x1aE\xdf\xa3":
        return _matroska(head, f, size)
    if head[:3] == b"ID3" or (len(head) > 1 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0):
        return _mp3(head, f, size)
    return None


#: Codecs of WAVE format tags.
WAVE_CODECS = {1: "pcm_s16le", 3: "pcm_f32le", 6: "pcm_alaw", 7: "pcm_mulaw", 0x55: "mp3", 0xFF: "aac"}


def _wav(f: BinaryIO, size: int) -> Info | None:
    f.seek(12)
    info, rate, data = Info(type="audio"), 0, None
    while len(chunk := f.read(8)) == 8:
        name, length = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        at = f.tell()
        if name == b"fmt ":
            tag, channels, sample_rate, rate, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if tag == 0xFFFE and length >= 26:
                f.read(8)
                tag = struct.unpack("<H", f.read(2))[0]
            pcm = {8: "pcm_u8", 16: "pcm_s16le", 24: "pcm_s24le", 32: "pcm_s32le"}.get(bits, "pcm_s16le")
            info.audio_codec = pcm if tag == 1 else WAVE_CODECS.get(tag)
            info.sample_rate, info.channels = sample_rate, channels
        elif name == b"data":
            data = min(length, size - at)
            break
        f.seek(at + length + (length & 1))
    if data is None or not rate:
        return None
    info.duration_sec = data / rate
    return info


def _flac(head: bytes) -> Info:
    packed = int.from_bytes(head[18:26], "big")
    rate, samples = packed >> 44, packed & ((1 << 36) - 1)
    return Info(type="audio", duration_sec=samples / rate if rate else 0.0, audio_codec="flac", sample_rate=rate, channels=(packed >> 41 & 7) + 1)


def _ogg(head: bytes, f: BinaryIO, size: int) -> Info | None:
    body = head[28 : 28 + 64]
    f.seek(max(0, size - 65_536))
    tail = f.read()
    last = tail.rfind(b"OggS")
    samples = struct.unpack("<q", tail[last + 6 : last + 14])[0] if last >= 0 else 0
    if body[1:7] == b"vorbis":
        channels, rate = struct.unpack("<BI", body[11:16])
        return Info(type="audio", duration_sec=samples / rate if rate else 0.0, audio_codec="vorbis", sample_rate=rate, channels=channels)
    if body[:8] == b"OpusHead":
        skip = struct.unpack("<H", body[10:12])[0]
        return Info(type="audio", duration_sec=max(0, samples - skip) / 48_000, audio_codec="opus", sample_rate=48_000, channels=body[9])
    return None


#: Sample rates of MPEG audio by version, bit rates (kbit/s) of layer 3 and of layers 1 and 2 in version 1.
MPEG_RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}
LAYER3_V1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LAYER3_V2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)


def _mp3(head: bytes, f: BinaryIO, size: int) -> Info | None:
    start = 0
    if head[:3] == b"ID3":
        start = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(head[6:10]))
    f.seek(start)
    data = f.read(8192)
    for at in range(len(data) - 4):
        word = struct.unpack(">I", data[at : at + 4])[0]
        version, layer, rate, frequency = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
        if word >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or frequency == 3:
            continue
        sample_rate = MPEG_RATES[version][frequency]
        kbits = (LAYER3_V1 if version == 3 else LAYER3_V2)[rate]
        per_frame = 1152 if version == 3 else 576
        found = max(data.find(b"Xing", at, at + 64), data.find(b"Info", at, at + 64))
        if found >= 0 and data[found + 7] & 1:
            duration = struct.unpack(">I", data[found + 8 : found + 12])[0] * per_frame / sample_rate
        else:
            duration = (size - start - at) * 8 / (kbits * 1000)
        return Info(type="audio", duration_sec=duration, audio_codec="mp3", sample_rate=sample_rate, channels=1 if word >> 6 & 3 == 3 else 2)
    return None


#: Codec names of sample entries in MP4 files and of tracks in Matroska files.
MP4_CODECS = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "vp08": "vp8", "vp09": "vp9", "av01": "av1", "mp4v": "mpeg4", "mp4a": "aac", "ac-3": "ac3", "ec-3": "eac3", "Opus": "opus", "fLaC": "flac", "alac": "alac", "sowt": "pcm_s16le", "jpeg": "mjpeg"}
MATROSKA_CODECS = {"V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_AAC": "aac", "A_MPEG/L3": "mp3", "A_FLAC": "flac", "A_AC3": "ac3"}
#: Largest ``moov`` box that is read.
MOST_MOOV = 256 << 20


def _boxes(data: bytes, low: int, high: int):
    while low + 8 <= high:
        size, name, skip = struct.unpack(">I", data[low : low + 4])[0], data[low + 4 : low + 8], 8
        if size == 1:
            size, skip = struct.unpack(">Q", data[low + 8 : low + 16])[0], 16
        end = high if size == 0 else low + size
        if end <= low or end > high:
            return
        yield name, low + skip, end
        low = end


def _find(data: bytes, low: int, high: int, *path: bytes):
    for name, a, b in _boxes(data, low, high):
        if name == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from _find(data, a, b, *path[1:])


def _mp4(f: BinaryIO, size: int) -> Info | None:
    at = 0
    while at + 8 <= size:
        f.seek(at)
        head = f.read(16)
        length = struct.unpack(">I", head[:4])[0]
        skip = 16 if length == 1 else 8
        length = struct.unpack(">Q", head[8:16])[0] if length == 1 else (size - at if length == 0 else length)
        if length < skip:
            return None
        if head[4:8] == b"moov":
            if length > MOST_MOOV:
                return None
            f.seek(at + skip)
            return _moov(f.read(length - skip))
        at += length
    return None


def _times(data: bytes, a: int) -> tuple[int, int]:
    """Time scale and duration of an ``mvhd`` or ``mdhd`` box."""
    if data[a] == 1:
        return struct.unpack(">IQ", data[a + 20 : a + 32])
    return struct.unpack(">II", data[a + 12 : a + 20])


def _moov(data: bytes) -> Info:
    info, n = Info(), len(data)
    for a, _ in _find(data, 0, n, b"mvhd"):
        scale, duration = _times(data, a)
        info.duration_sec = duration / scale if scale else 0.0
    for a, b in _find(data, 0, n, b"trak"):
        handler = next((data[x + 8 : x + 12] for x, _ in _find(data, a, b, b"mdia", b"hdlr")), b"")
        scale, duration = next((_times(data, x) for x, _ in _find(data, a, b, b"mdia", b"mdhd")), (0, 0))
        entry = next((x + 8 for x, _ in _find(data, a, b, b"mdia", b"minf", b"stbl", b"stsd")), None)
        if entry is None:
            continue
        codec = data[entry + 4 : entry + 8].decode("latin-1")
        if handler == b"vide" and info.width is None:
            info.type = "video"
            info.width, info.height = struct.unpack(">HH", data[entry + 32 : entry + 36])
            info.video_codec = MP4_CODECS.get(codec, codec.strip().lower())
            frames = 0
            for x, _ in _find(data, a, b, b"mdia", b"minf", b"stbl", b"stts"):
                count = struct.unpack(">I", data[x + 4 : x + 8])[0]
                frames = sum(struct.unpack(">I", data[x + 8 + 8 * k : x + 12 + 8 * k])[0] for k in range(count))
            if frames and duration:
                info.fps = frames * scale / duration
        elif handler == b"soun" and info.audio_codec is None:
            info.type = info.type if info.type == "video" else "audio"
            info.audio_codec = MP4_CODECS.get(codec, codec.strip().lower())
            info.channels = struct.unpack(">H", data[entry + 24 : entry + 26])[0]
            info.sample_rate = struct.unpack(">I", data[entry + 32 : entry + 36])[0] >> 16
    return info


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    first = data[at]
    length = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + length], "big")
    return (value if keep else value & ((1 << 7 * length) - 1)), at + length


def _elements(data: bytes, low: int, high: int):
    while low + 2 < high:
        name, at = _vint(data, low, True)
        size, at = _vint(data, at, False)
        end = min(high, at + size)
        yield name, at, end
        low = at + size


def _matroska(head: bytes, f: BinaryIO, size: int) -> Info | None:
    data = head + f.read(1 << 20)
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]
    info, scale = Info(), 1_000_000
    for name, a, b in _elements(data, 0, len(data)):
        if name != 0x18538067:
            continue
        for part, c, d in _elements(data, a, b):
            if part == 0x1549A966:
                values = {n: (x, y) for n, x, y in _elements(data, c, d)}
                scale = number(*values[0x2AD7B1]) if 0x2AD7B1 in values else scale
                if 0x4489 in values:
                    info.duration_sec = real(*values[0x4489]) * scale / 1e9
            elif part == 0x1654AE6B:
                for track, x, y in _elements(data, c, d):
                    if track == 0xAE:
                        _track(info, data, x, y, number, real)
    return info if info.type != "unknown" else None


def _track(info: Info, data: bytes, a: int, b: int, number, real) -> None:
    values = {n: (x, y) for n, x, y in _elements(data, a, b)}
    kind = number(*values[0x83]) if 0x83 in values else 0
    codec = data[slice(*values[0x86])].decode("latin-1").rstrip("\0") if 0x86 in values else ""
    name = MATROSKA_CODECS.get(codec, codec.partition("/")[0].lower() or None)
    if kind == 1 and info.width is None:
        info.type, info.video_codec = "video", name
        if 0xE0 in values:
            inner = {n: (x, y) for n, x, y in _elements(data, *values[0xE0])}
            info.width, info.height = (number(*inner[k]) if k in inner else None for k in (0xB0, 0xBA))
        if 0x23E383 in values and number(*values[0x23E383]):
            info.fps = 1e9 / number(*values[0x23E383])
    elif kind == 2 and info.audio_codec is None:
        info.type, info.audio_codec = ("video" if info.type == "video" else "audio"), name
        inner = {n: (x, y) for n, x, y in _elements(data, *values[0xE1])} if 0xE1 in values else {}
        info.sample_rate = round(real(*inner[0xB5])) if 0xB5 in inner else 8000
        info.channels = number(*inner[0x9F]) if 0x9F in inner else 1


def png_bytes(width: int, height: int, rows: bytes, channels: int = 3) -> bytes:
    """A PNG of raw rows (8 bits a channel)."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    stride = width * channels
    raw = b"".join(b"\0" + rows[i * stride : (i + 1) * stride] for i in range(height))
    kind = {1: 0, 3: 2, 4: 6}[channels]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
