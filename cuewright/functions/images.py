"""Pictures as numpy arrays: reading PNG, resizing, banners with a time, grids, writing JPEG.

Only numpy is needed.  Where Pillow is installed it reads further formats.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter

import numpy as np

from cuewright.errors import MediaError

#: Sizes of the banner under a frame.
BANNER_HEIGHT, BANNER_PADDING, BANNER_SHADE = 34, 8, 46
#: Glyphs of time labels, five columns by seven rows, a row per number.
GLYPHS = {
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14),
    "4": (2, 6, 10, 18, 31, 2, 2), "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8),
    "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12), ":": (0, 4, 4, 0, 4, 4, 0), ".": (0, 0, 0, 0, 0, 12, 12),
}


def decode(data: bytes) -> np.ndarray:
    """RGB pixels of an image file; PNG of 8 bits a channel without Pillow."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        try:
            return _png(data)
        except MediaError:
            pass
    try:
        import io

        from PIL import Image
    except ImportError:
        raise MediaError("UNSUPPORTED_FORMAT", "only PNG of 8 bits a channel can be read here") from None
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def _png(data: bytes) -> np.ndarray:
    at, body, palette = 8, b"", None
    width = height = depth = kind = interlaced = 0
    while at + 8 <= len(data):
        length, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + length]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += part
        at += 12 + length
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or interlaced or channels is None or not width or not height:
        raise MediaError("UNSUPPORTED_FORMAT", "this kind of PNG isn't read")
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(height):
        line, method = raw[y, 1:].astype(np.int32), raw[y, 0]
        if method == 0:
            row = line
        elif method == 2:
            row = line + above
        elif method == 1:
            row = np.cumsum(line.reshape(width, channels), axis=0).reshape(-1)
        else:
            row = _png_row(line, above, channels, method)
        above = row & 255
        out[y] = above
    pixels = out.reshape(height, width, channels)
    if kind == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else np.ascontiguousarray(pixels[..., :3])


def _png_row(line: np.ndarray, above: np.ndarray, channels: int, method: int) -> np.ndarray:
    row = np.zeros_like(line)
    for i in range(len(line)):
        left = int(row[i - channels]) if i >= channels else 0
        corner = int(above[i - channels]) if i >= channels else 0
        up = int(above[i])
        if method == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            near = min((abs(p - left), 0), (abs(p - up), 1), (abs(p - corner), 2))[1]
            guess = (left, up, corner)[near]
        row[i] = (int(line[i]) + guess) & 255
    return row


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear; means over what a pixel covers when shrinking."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        reach = max(1.0, scale)
        centre = (np.arange(new) + 0.5) * scale - 0.5
        w = np.clip(1 - np.abs(np.arange(old)[None, :] - centre[:, None]) / reach, 0, None)
        return w / w.sum(axis=1, keepdims=True)

    rows = np.tensordot(weights(pixels.shape[0], height), pixels.astype(float), axes=(1, 0))
    out = np.tensordot(weights(pixels.shape[1], width), rows, axes=(1, 1)).transpose(1, 0, 2)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def shrink(pixels: np.ndarray, most_width: int = 1280) -> np.ndarray:
    """No wider than ``most_width``; never enlarged."""
    height, width = pixels.shape[:2]
    return pixels if width <= most_width else resize(pixels, most_width, max(1, round(height * most_width / width)))


def fit(pixels: np.ndarray, width: int, height: int, mode: str = "contain") -> np.ndarray:
    """Into a tile: 'contain' in full on black, 'cover' filled and cut to the centre."""
    h, w = pixels.shape[:2]
    scale = (min if mode == "contain" else max)(width / w, height / h)
    part = resize(pixels, max(1, round(w * scale)), max(1, round(h * scale)))
    if mode == "cover":
        y, x = (part.shape[0] - height) // 2, (part.shape[1] - width) // 2
        part = part[max(y, 0) : max(y, 0) + height, max(x, 0) : max(x, 0) + width]
    tile = np.zeros((height, width, 3), np.uint8)
    y, x = (height - part.shape[0]) // 2, (width - part.shape[1]) // 2
    tile[y : y + part.shape[0], x : x + part.shape[1]] = part
    return tile


def with_banner(pixels: np.ndarray, label: str) -> np.ndarray:
    """A banner below the picture, the label at its right; what doesn't fit at the left is cut."""
    height, width = pixels.shape[:2]
    banner = np.full((BANNER_HEIGHT, width, 3), 0, np.uint8)
    scale = 2
    glyphs = [np.array([[row >> (4 - x) & 1 for x in range(5)] + [0] for row in GLYPHS[c]], np.uint8) for c in label if c in GLYPHS]
    if glyphs:
        text = np.kron(np.concatenate(glyphs, axis=1), np.ones((scale, scale), np.uint8))
        text = text[:, -max(0, width - 2 * BANNER_PADDING) :] if width > 2 * BANNER_PADDING else text[:, :0]
        y, x = (BANNER_HEIGHT - text.shape[0]) // 2, width - BANNER_PADDING - text.shape[1]
        banner[y : y + text.shape[0], x : x + text.shape[1]] = (text * 255)[..., None]
    return np.concatenate([pixels, banner])


def compose(frames: list[np.ndarray], cols: int, tile_width: int, mode: str = "contain") -> np.ndarray:
    """A grid of frames, row by row on black; the first frame's shape is the tiles'."""
    if not frames:
        raise MediaError("GRID_FAILED", "a grid needs frames")
    h, w = frames[0].shape[:2]
    tile_height = max(1, int(tile_width * h / w + 0.5))
    rows = -(-len(frames) // cols)
    out = np.zeros((rows * tile_height, cols * tile_width, 3), np.uint8)
    for i, frame in enumerate(frames):
        y, x = i // cols * tile_height, i % cols * tile_width
        out[y : y + tile_height, x : x + tile_width] = fit(frame, tile_width, tile_height, mode)
    return out


# ------------------------------------------------------------------ JPEG

#: Quantisation tables for quality 50, brightness and colour, in rows of eight.
BRIGHTNESS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k = np.arange(8)
_DCT = np.sqrt(2 / 8) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)
_DCT[0] /= np.sqrt(2)


def _quantisation(table: list[int], quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255).astype(int)


def _huffman(counts: Counter) -> tuple[list[int], list[int]]:
    """Numbers of codes of length 1 to 16, and symbols by length, for these counts; no code is all ones."""
    counts = dict(counts) or {0: 1}
    while True:
        heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, 1 << 20, [-1])]
        heapq.heapify(heap)
        length = Counter()
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                length[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(length.values()) <= 16:
            break
        counts = {s: n // 2 + 1 for s, n in counts.items()}
    longest = max(length.values())
    length[-1] = longest  # the reserved code is the last of the longest
    symbols = sorted((s for s in length if s >= 0), key=lambda s: (length[s], s))
    return [sum(length[s] == n for s in symbols) for n in range(1, 17)], symbols


def _codes(bits: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value, at = 0, 0
    for n in range(1, 17):
        for _ in range(bits[n - 1]):
            code[symbols[at]], size[symbols[at]] = value, n
            value, at = value + 1, at + 1
        value <<= 1
    return code, size


def _magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit size of each value, and its bits."""
    size = np.where(values == 0, 0, np.floor(np.log2(np.maximum(np.abs(values), 1))).astype(np.int64) + 1)
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of zigzag blocks, in order: block, place, symbol, extra bits and how many; place 0 is the mean."""
    n = len(blocks)
    mean = np.diff(blocks[:, 0], prepend=0)
    size, bits = _magnitude(mean)
    parts = [(np.arange(n), np.zeros(n, np.int64), size, bits, size)]
    b, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    run = k - np.where(first, 0, np.concatenate([[0], k[:-1]])) - 1
    size, bits = _magnitude(blocks[b, k])
    parts.append((b, k * 4 + 3, (run % 16) << 4 | size, bits, size))
    for z in range(3):  # runs of sixteen zeros
        long = run // 16 > z
        parts.append((b[long], k[long] * 4 + z, np.full(long.sum(), 0xF0), np.zeros(long.sum(), np.int64), np.zeros(long.sum(), np.int64)))
    last = np.zeros(n, np.int64)
    np.maximum.at(last, b, k)
    short = np.flatnonzero(last < 63)
    zero = np.zeros(len(short), np.int64)
    parts.append((short, zero + 1000, zero, zero, zero))
    return tuple(np.concatenate(x) for x in zip(*parts))


def encode_jpeg(pixels: np.ndarray, quality: int = 85) -> bytes:
    """A baseline JPEG of RGB pixels, without subsampling, with Huffman tables of its own."""
    height, width = pixels.shape[:2]
    rgb = np.pad(pixels.astype(float), ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    tables = [_quantisation(BRIGHTNESS, quality), _quantisation(COLOUR, quality)]
    streams = []
    for c, plane in enumerate(planes):
        h, w = plane.shape
        blocks = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        spectrum = (_DCT @ blocks @ _DCT.T).reshape(-1, 64) / tables[c > 0]
        streams.append(_symbols(np.round(spectrum).astype(np.int64)[:, _ZIGZAG]))
    coders = {}
    for c in (0, 1):
        own = streams[:1] if c == 0 else streams[1:]
        for ac in (0, 1):
            counts = Counter(np.concatenate([s[2][(s[1] > 0) == bool(ac)] for s in own]).tolist())
            coders[c, ac] = _huffman(counts)
    block = np.concatenate([s[0] * 3 + c for c, s in enumerate(streams)])
    place = np.concatenate([s[1] for s in streams])
    value, length = [], []
    for c, s in enumerate(streams):
        pair = [_codes(*coders[min(c, 1), ac]) for ac in (0, 1)]
        ac = s[1] > 0
        code, size = (np.where(ac, pair[1][x][s[2]], pair[0][x][s[2]]) for x in (0, 1))
        value.append(code << s[4] | s[3])
        length.append(size + s[4])
    order = np.lexsort((place, block))
    value, length = np.concatenate(value)[order], np.concatenate(length)[order]
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(length)), length)
    bits = (value[owner] >> (ends[owner] - 1 - np.arange(int(ends[-1])))) & 1
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)])
    body = np.packbits(bits.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\0")

    def part(mark: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data

    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for c in (0, 1):
        out += part(0xDB, bytes([c]) + bytes(tables[c][_ZIGZAG].tolist()))
    out += part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for (c, ac), (lengths, symbols) in coders.items():
        out += part(0xC4, bytes([ac << 4 | c]) + bytes(lengths) + bytes(symbols))
    return out + part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"
