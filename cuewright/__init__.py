"""cuewright: time-aligned media and transcript analytics on Spark DataFrames.

``cuewright.probe_media`` and the other tools for single media load on first use;
plans for any number of media are in ``operators``, ``sources`` and ``plans``.
"""

__version__ = "0.1.0"

_FACADE = ("probe_media", "understand_media", "get_video_grids", "get_frames", "get_transcript", "fetch_video", "available_tools")
_OTHERS = {"GridOptions": "options", "MediaError": "errors"}
__all__ = ["__version__", *_FACADE, *_OTHERS]


def __getattr__(name: str) -> object:
    from importlib import import_module

    if name in _FACADE:
        return getattr(import_module("cuewright.plans.facade"), name)
    if name in _OTHERS:
        return getattr(import_module(f"cuewright.{_OTHERS[name]}"), name)
    raise AttributeError(name)
