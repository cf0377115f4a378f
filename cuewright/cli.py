"""``python -m cuewright.cli FILE``: what a file is, from its header, without a Spark session."""

from __future__ import annotations

import argparse
import os
import sys

from cuewright import __version__
from cuewright.functions.text import _fixed
from cuewright.sources.files import probe_file


def _size(n: int) -> str:
    for unit, name in ((1024**3, "GB"), (1024**2, "MB"), (1024, "KB")):
        if n >= unit:
            return f"{_fixed(n / unit, 1)} {name}"
    return f"{n} B"


def _duration(sec: float) -> str:
    h, m, s = int(sec // 3600), int(sec % 3600 // 60), int(sec % 60)
    if h:
        return f"{h}h" + (f" {m}m" if m else "")
    return f"{m}m" + (f"{s}s" if s else "") if m else f"{s}s"


def summary(info: dict) -> str:
    parts = [f"[{info['type'].capitalize()}]"]
    if info["type"] != "image":
        parts.append(_duration(info["duration_sec"]))
    if info["width"] is not None:
        parts.append(f"{info['width']}x{info['height']}")
    if info["audio_codec"]:
        parts.append(f"{info['video_codec']}/{info['audio_codec']}" if info["video_codec"] else info["audio_codec"])
    parts.append(_size(info["file_size_bytes"]))
    return " ".join(parts)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("cuewright", description="Show what a media file is, from its header alone.")
    parser.add_argument("file")
    parser.add_argument("-V", "--version", action="version", version=__version__)
    path = os.path.abspath(parser.parse_args(arguments).file)
    info, error = probe_file(path)
    if error:
        print(f"Error: [{error['code']}] {error['message']}", file=sys.stderr)
        return 1
    print(f"File: {path}\n{summary(info)}\n\nFor transcripts, grids and frames see the tools in cuewright.plans.facade.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
