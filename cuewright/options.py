"""Options of jobs, with defaults and validation."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from cuewright.errors import MediaError

# Defaults and limits.
DEFAULT_TOTAL_CHARS = 48_000
DEFAULT_TRANSCRIPT_CHARS = 32_000
DEFAULT_MAX_GRIDS = 6
DEFAULT_PROBE_FILES, MOST_PROBE_FILES = 50, 200
MAX_DURATION_FULL_SEC, MAX_DURATION_TRANSCRIPT_SEC = 7_200, 14_400
MAX_FILE_BYTES = 10 * 1024**3
CACHE_ENTRIES, CACHE_TRANSCRIPT_CHARS = 32, 500_000
SCENE_THRESHOLD, FRAME_INTERVAL, SCENE_FPS = 0.3, 300, 30
COLS, ROWS, THUMB_WIDTH = 4, 4, 480
PORTRAIT_COLS, PORTRAIT_ROWS, PORTRAIT_THUMB_WIDTH = 3, 3, 120
DEFAULT_MODEL = "base.en-q5_1"


def setting(name: str, default: int) -> int:
    """A whole number from the environment (``CUEWRIGHT_...``); anything else there is an error."""
    value = os.environ.get(f"CUEWRIGHT_{name}")
    if value is None or not value.strip():
        return default
    if not value.strip().isdigit():
        raise ValueError(f"CUEWRIGHT_{name} must be a whole number, not {value!r}")
    return int(value)


def given(**options: object) -> dict[str, object]:
    """The options that are not None."""
    return {k: v for k, v in options.items() if v is not None}


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise MediaError("INVALID_SAMPLING", message)


@dataclass(frozen=True)
class GridOptions:
    """How a video is sampled and laid out; what is None follows from the medium."""

    max_grids: int | None = None
    start_sec: float | None = None
    end_sec: float | None = None
    sampling_strategy: str = "uniform"
    scene_threshold: float = SCENE_THRESHOLD
    frame_interval: int = FRAME_INTERVAL
    seconds_per_frame: float | None = None
    seconds_per_grid: float | None = None
    cols: int | None = None
    rows: int | None = None
    thumb_width: int | None = None
    aspect_mode: str = "contain"

    def __post_init__(self) -> None:
        _check(self.sampling_strategy in ("uniform", "scene"), f"unknown sampling strategy {self.sampling_strategy!r}")
        _check(self.aspect_mode in ("contain", "cover"), f"unknown aspect mode {self.aspect_mode!r}")
        _check(0 <= self.scene_threshold <= 1, "scene_threshold must be from 0 to 1")
        _check(self.frame_interval >= 1, "frame_interval must be at least 1")
        for name in ("cols", "rows"):
            value = getattr(self, name)
            _check(value is None or (isinstance(value, int) and 1 <= value <= 8), f"{name} must be a whole number from 1 to 8")
        for name in ("max_grids", "thumb_width", "seconds_per_frame", "seconds_per_grid"):
            value = getattr(self, name)
            _check(value is None or value > 0, f"{name} must be greater than 0")
        _check(self.start_sec is None or self.start_sec >= 0, "start_sec must not be negative")

    @property
    def grids(self) -> int:
        return self.max_grids if self.max_grids is not None else setting("MAX_GRIDS", DEFAULT_MAX_GRIDS)

    @classmethod
    def of(cls, **options: object) -> GridOptions:
        known = {f.name for f in fields(cls)}
        unknown = set(options) - known
        if unknown:
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**given(**options))


def frame_times(timestamps: list[float]) -> list[float]:
    """Times of frames asked for: one to twenty, none negative."""
    _check(1 <= len(timestamps) <= 20, "from 1 to 20 timestamps can be asked for at once")
    _check(all(t >= 0 for t in timestamps), "timestamps must not be negative")
    return list(timestamps)


def probe_limit(max_files: int | None) -> int:
    _check(max_files is None or max_files >= 1, "max_files must be at least 1")
    return min(max_files if max_files is not None else DEFAULT_PROBE_FILES, MOST_PROBE_FILES)


def transcript_format(name: str | None) -> str:
    _check(name in (None, "text", "srt", "json"), f"unknown transcript format {name!r}")
    return name or "text"
