"""Oversized texts in pieces under a limit, cut where the text pauses, with an overlap.

Method: token lengths are summed up to offsets, boundaries (ends of paragraphs
and sentences, of clauses, of words) are kept as sorted arrays of offsets, and a
binary search finds the last one under the limit.  The next piece begins
``overlap`` characters before the cut.  Where no boundary leaves progress, the
cut is hard, but not inside a character that several code points make up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\S+\s*|\s+")
_SENTENCE = re.compile(r"[.!?…]+[\"')\]»”’]*\s+$|[^\n]*\n\s*$")
_CLAUSE = re.compile(r"[,;:—–][\"')\]»”’]*\s+$|[—–]\s+$")
#: Title words and initials whose full stop ends no sentence.
_ABBREVIATED = re.compile(r"(?:^|\W)(?:[^\W\d_]|Mr|Mrs|Ms|Mx|Dr|St|Nr|No|Sr|Sra|vs|etc|ca)\.\s+$", re.I)


class Boundaries:
    """Sorted offsets at which a text may be cut, from the best kind to the plainest."""

    def __init__(self, text: str) -> None:
        tokens = _TOKEN.findall(text)
        ends = np.cumsum(np.fromiter((len(t) for t in tokens), np.int64, len(tokens)))
        kind = np.full(len(tokens), 2, np.int8)
        for i, t in enumerate(tokens):
            if not t[-1].isspace():
                kind[i] = 3
            elif (_SENTENCE.search(t) and not _ABBREVIATED.search(t)) or "\n" in t:
                kind[i] = 0
            elif _CLAUSE.search(t):
                kind[i] = 1
        self.kinds = [ends[kind <= k] for k in range(3)]

    def last(self, kind: int, low: int, high: int) -> int:
        """The last boundary of a kind in ``(low, high]``, or -1."""
        place = int(np.searchsorted(self.kinds[kind], high, "right")) - 1
        return int(self.kinds[kind][place]) if place >= 0 and self.kinds[kind][place] > low else -1


def _whole(text: str, cut: int, low: int) -> int:
    """Step back from inside a cluster of code points that make up one character."""
    at = cut
    while at > low + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️︎" or "\U0001f3fb" <= text[at] <= "\U0001f3ff" or text[at - 1] == "‍"):
        at -= 1
    return at if at > low + 1 else cut


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(begin, end)`` of the pieces of a text: none longer than ``limit``, neighbours share ``overlap`` characters."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("a limit must be at least 1, and an overlap from 0 to less than it")
    if len(text) <= limit:
        return [(0, len(text))]
    marks = Boundaries(text)
    out = []
    begin = 0
    while len(text) - begin > limit:
        high, least = begin + limit, begin + overlap
        half = max(least, begin + limit // 2)
        cut = next((c for low in (half, least) for kind in range(3 if low == least else 2) if (c := marks.last(kind, low, high)) > 0), -1)
        if cut < 0:
            cut = _whole(text, high, least)
        out.append((begin, cut))
        begin = cut - overlap
    out.append((begin, len(text)))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, number, many, begins, ends, texts, size = [], [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            own = [pa.array(rows, pa.int64())]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(own[0]), pa.array(number, pa.int32()), pa.array(many, pa.int32()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=names
            )

        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_py()
            cuts = spans(text, limit, overlap)
            for k, (a, b) in enumerate(cuts):
                rows.append(row)
                number.append(k)
                many.append(len(cuts))
                begins.append(a)
                ends.append(b)
                texts.append(text[a:b])
            size += len(text)
            if size > 1 << 23:
                yield out()
                rows, number, many, begins, ends, texts, size = [], [], [], [], [], [], 0
        yield out()


def split_texts(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """Every text as pieces of at most ``limit`` code points that share ``overlap`` with their neighbours.

    Columns: ``keys, piece, n_pieces, begin, end, text`` (offsets in code
    points; putting the pieces together without the overlaps gives the text
    back).  A text within the limit is one piece; an empty or blank one too; a
    null text has no piece; null keys stay null; repeated rows repeat; an empty
    table gives an empty result; other columns aren't read.  Texts within the
    limit never leave the JVM.  No shuffle.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("a limit must be at least 1, and an overlap from 0 to less than it")
    rows = df.select(F.struct(*(F.col(k).alias(k) for k in keys)).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    schema = T.StructType(
        [T.StructField("key", rows.schema["key"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]
    )
    names = schema.fieldNames()
    cut = rows.where(F.length("text") > limit).mapInArrow(lambda it: _pieces(it, limit, overlap, names), schema)
    whole = rows.where(F.length("text") <= limit).select("key", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("begin"), F.length("text").alias("end"), "text")
    return cut.unionByName(whole).select("key.*", "piece", "n_pieces", "begin", "end", "text")


def limits(table: DataFrame, most: int = 1000) -> dict[str, tuple[int, int]]:
    """Limit and overlap of each kind of item from the small table of limits (at most ``most`` rows).

    Rows without a kind or a limit set none; a null overlap is none; of several
    limits for a kind the lowest holds.
    """
    rows = table.select("item_kind", "max_chars", "overlap_chars").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} kinds of items")
    found = sorted(((r["item_kind"], r["max_chars"], r["overlap_chars"] or 0) for r in rows if r["item_kind"] is not None and r["max_chars"] is not None), reverse=True)
    return {kind: (limit, overlap) for kind, limit, overlap in found}


#: The limit of a kind that has none.
UNLIMITED = ((1 << 31) - 1, 0)
