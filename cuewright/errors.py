"""Error codes, the error struct that rows carry, and the exception of the facades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All codes a row or an exception may carry.
CODES = (
    "FFMPEG_NOT_FOUND", "FILE_NOT_FOUND", "UNSUPPORTED_FORMAT", "NO_AUDIO_STREAM", "NO_VIDEO_STREAM", "TRANSCRIBE_FAILED", "GRID_FAILED",
    "FRAME_FAILED", "INVALID_SAMPLING", "BUDGET_EXCEEDED", "FILE_TOO_LARGE", "YT_DLP_NOT_FOUND", "YT_DLP_FAILED", "UNKNOWN",
)

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])


class MediaError(Exception):
    """What a facade raises for one file; in DataFrames the same is a row's ``error`` struct."""

    def __init__(self, code: str, message: str, cause: BaseException | None = None) -> None:
        super().__init__(message)
        if code not in CODES:
            raise ValueError(f"no such code: {code}")
        self.code, self.message, self.cause = code, message, cause


def error(code: str, message: Column | str) -> Column:
    """An error struct; a null message makes it null."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(text.isNotNull(), F.struct(F.lit(code).alias("code"), text.alias("message"))).cast(ERROR)


NO_ERROR = "cast(null as struct<code:string,message:string>)"


def envelope(problem: Column) -> Column:
    """The text of an error envelope: ``[CODE] message``, or the message alone without a code."""
    return F.when(problem["code"].isNotNull(), F.concat(F.lit("["), problem["code"], F.lit("] "), problem["message"])).otherwise(problem["message"])


def text_of(problem: BaseException) -> str:
    """The same for an exception."""
    return f"[{problem.code}] {problem}" if isinstance(problem, MediaError) else str(problem)
