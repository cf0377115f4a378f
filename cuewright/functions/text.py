"""Column functions on text, numbers and labels. All stay in the JVM but ``to_fixed`` and ``cut_middle``."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what stands where a text was cut.
CUT_MARK = "\n\n[…transcript truncated…]\n\n"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units, the unit of payload budgets."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("int")


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends (Spark's ``trim`` takes blanks only)."""
    return F.regexp_replace(col(text), "^[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+|[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+$", "")


def round_half_up(x: Column | str) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(col(x) + F.lit(0.5)).cast("long")


def truncate_middle(text: Column | str, most: int, mark: str = CUT_MARK) -> Column:
    """A text of more than ``most`` code points as its first 60 % and last 40 % of ``most`` with a mark between.

    With nothing left for the end (``most`` 0) the whole text follows the mark.
    """
    text, keep = col(text), most * 6 // 10
    tail = F.right(text, F.lit(most - keep)) if most - keep > 0 else text
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, keep), F.lit(mark), tail))


def _units(text: str, first: int | None, last: int | None) -> str:
    """The first or last so many UTF-16 units; half of a character at the cut is left out."""
    data = text.encode("utf-16-le")
    part = data[: 2 * first] if first is not None else (data[-2 * last :] if last else data)
    return part.decode("utf-16-le", "ignore")


@F.pandas_udf(T.StringType())
def cut_middle(head: pd.Series, tail: pd.Series, total: pd.Series, most: pd.Series) -> pd.Series:
    """``truncate_middle`` in UTF-16 units, of a text given by its head, tail and total length."""
    out = []
    for h, t, n, m in zip(head, tail, total, most):
        if h is None or pd.isna(n):
            out.append(None)
        elif n <= m:
            out.append(h)
        else:
            keep = int(m) * 6 // 10
            out.append(_units(h, keep, None) + CUT_MARK + _units(t, None, int(m) - keep))
    return pd.Series(out, dtype=object)


def _fixed(x: float | None, digits: int) -> str | None:
    if x is None or x != x:
        return None
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def to_fixed(x: Column | str, digits: int) -> Column:
    """A number with so many decimals, of its exact binary value, halves away from zero. An Arrow UDF: for few rows."""

    @F.pandas_udf(T.StringType())
    def fixed(values: pd.Series) -> pd.Series:
        return pd.Series([_fixed(v, digits) for v in values], dtype=object)

    return fixed(col(x).cast("double"))


def fixed1(x: Column | str) -> Column:
    """``to_fixed(x, 1)`` for numbers from 0 to 2**45, without leaving the JVM.

    Formatting rounds the shortest decimal of a double, so it is wrong where that
    ends in a 5 which the binary value doesn't quite reach.  There 20 x rounds to
    an odd whole number from below: the exact rounding error of the sum
    ``16 x + 4 x`` is negative.
    """
    x = col(x).cast("double")
    a, b = x * 16, x * 4
    s = a + b
    bb = s - a
    short = (s % 2 == 1) & ((a - (s - bb)) + (b - bb) < 0)
    return F.when(x.isNotNull(), F.format_string("%.1f", F.when(short, x - 0.01).otherwise(x)))


def _two(x: Column) -> Column:
    return F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))


def _clock(ms: Column, point: str) -> Column:
    hours, minutes, seconds = F.floor(ms / 3_600_000), F.floor((ms % 3_600_000) / 60_000), F.floor((ms % 60_000) / 1000)
    return F.concat(_two(hours), F.lit(":"), _two(minutes), F.lit(":"), _two(seconds), F.lit(point), F.lpad((ms % 1000).cast("string"), 3, "0"))


def timestamp_label(sec: Column | str) -> Column:
    """``HH:MM:SS.mmm``: rounded to ms first, negative times as zero, null as null."""
    ms = round_half_up(col(sec) * 1000)
    return _clock(F.when(ms < 0, F.lit(0).cast("long")).otherwise(ms), ".")


def srt_timestamp(ms: Column | str) -> Column:
    """``HH:MM:SS,mmm`` of rounded milliseconds; 999.6 ms is the next second, null is null."""
    ms = round_half_up(ms)
    return _clock(F.when(ms < 0, F.lit(0).cast("long")).otherwise(ms), ",")


def duration_label(sec: Column | str) -> Column:
    """``2h 1m``, ``2h`` or ``5m``; less than a minute is ``0m``."""
    h, m = F.floor(col(sec) / 3600), F.floor((col(sec) % 3600) / 60)
    return (
        F.when((h > 0) & (m > 0), F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h")))
        .otherwise(F.concat(m.cast("string"), F.lit("m")))
    )


def short_duration(sec: Column | str) -> Column:
    """``1h 2m``, ``2m15s`` or ``9s``."""
    h, m, s = F.floor(col(sec) / 3600), F.floor((col(sec) % 3600) / 60), F.floor(col(sec) % 60)
    part = lambda n, unit, before="": F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(unit))).otherwise("")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), part(m, "m", " "))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), part(s, "s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def size_label(size: Column | str) -> Column:
    """``15.0 GB``, ``1.5 MB``, ``2.0 KB`` or ``17 B``."""
    size = col(size)
    scaled = [(1024**3, " GB"), (1024**2, " MB"), (1024, " KB")]
    out = F.when(size >= scaled[0][0], F.concat(fixed1(size / scaled[0][0]), F.lit(scaled[0][1])))
    for unit, name in scaled[1:]:
        out = out.when(size >= unit, F.concat(fixed1(size / unit), F.lit(name)))
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def vision_tokens(width: Column | str, height: Column | str) -> Column:
    return F.ceil(col(width).cast("double") * col(height) / 750).cast("long")


def overage(actual: Column | str, budget: Column | str) -> Column:
    """``~3.0x over budget``; null for a budget of zero."""
    return F.concat(F.lit("~"), fixed1(F.try_divide(col(actual).cast("double"), col(budget).cast("double"))), F.lit("x over budget"))


def is_portrait(width: Column | str, height: Column | str) -> Column:
    return F.coalesce(col(height) > col(width), F.lit(False))


def is_url(text: Column | str) -> Column:
    return F.coalesce(strip(text).rlike("(?i)^https?://"), F.lit(False))


def url_hash(url: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of a URL without surrounding white space."""
    return F.substring(F.sha2(strip(url).cast("binary"), 256), 1, 16)


def has_glob(path: Column | str) -> Column:
    return col(path).rlike(r"[*?\[\]{]")


def strip_tags(text: Column | str) -> Column:
    """Without ``<...>``, line feeds as blanks, trimmed."""
    return strip(F.translate(F.regexp_replace(col(text), "<[^>]*>", ""), "\n", " "))


def srt_separators(text: Column | str) -> Column:
    """Stamps with a point before the milliseconds, with a comma there."""
    return F.regexp_replace(col(text), r"(\d{2}:\d{2}:\d{2})\.(\d{3})", "$1,$2")


def escape_xml(text: Column | str) -> Column:
    """The five entities, the ampersand first."""
    out = col(text)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


#: JPEG qualities by tag, as a percentage and as the scale of motion JPEG.
QUALITY, QSCALE = {"q85": 85, "q82": 82, "q75": 75}, {"q85": 2, "q82": 3, "q75": 5}


def text_or_empty(value: Column | str) -> Column:
    """Null as an empty text."""
    return F.coalesce(col(value).cast("string"), F.lit(""))


def number_or_zero(value: Column | str) -> Column:
    """What isn't a number as zero."""
    return F.coalesce(col(value).try_cast("double"), F.lit(0.0))
