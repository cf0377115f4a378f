"""Clean speaker turns out of timed transcript segments.

Method: a sweep line over the segments of a block, in order, keeps who holds the
floor, how far speech has reached in time and the words said last.  Labels and
flags open turns, so do pauses longer than what is usual in the medium; a segment
that begins with the words the one before ended with (rolling captions) loses
them.  What a block must know of those before it (how far time has reached, what
was said last, who holds the floor) short rows tell, one per block, and the usual
pause comes from a histogram of the gaps of its medium: blocks bound what a task
orders, and change nothing but the rows that a turn's text comes in.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.stream import changes, whole_groups
from cuewright.llm.speech import SOUND_NOTE, TIME_STAMP, cleaned
from cuewright.operators.latest import BLOCK, block_of, latest_in_blocks

#: Speakers that are resolved by a dictionary on each worker; the table is small and fixed.
MAX_SPEAKERS = 50_000
UNKNOWN = "unknown"
#: A pause is longer than this share of the gaps of its medium, and than so many milliseconds.
USUAL, LEAST_PAUSE = 0.99, 2000.0
_HONORIFIC = {"mr", "mrs", "ms", "mx", "dr", "sir", "dame", "lord", "lady", "prof"}
_VOICE = re.compile(r"(?:(?:speaker|voice|person)[\s_]*|s)0*(\d{1,4})")
_CANDIDATE = re.compile(r"<v(?:\.[^\s>]*)?\s+([^<>]+)>|\[([^\[\]]+)\]|:(?=\s|$)")
_DASH = re.compile(r"\s[-—–](?=\s|$)|—")
#: What a text with a label has: a mark of ``_CANDIDATE`` or of ``_DASH``.
_MAYBE = re.compile(r"[:\[—]|<v|\s[-–]")
_LEAD = re.compile(rf"(?:\s|-\s|>+|{TIME_STAMP.pattern}|\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s|{SOUND_NOTE.pattern})*", re.I)
_PAREN = re.compile(r"\s*\(([^()]*)\)$")
_WORD = re.compile(r"\S+")
#: Words that a label may have, at least; the names and offices of the speakers may take more.
LABEL_WORDS = 8
#: Buckets of the histogram of gaps to a doubling.
_FINE = 8


def _slips(name: str) -> Iterator[str]:
    """What one slip makes of a name: two letters swapped, one missing, one doubled or put in."""
    for i in range(len(name)):
        yield name[:i] + name[i + 1 :]
        yield name[:i] + name[i] + name[i:]
        if i + 1 < len(name):
            yield name[:i] + name[i + 1] + name[i] + name[i + 2 :]


class Speakers:
    """Resolves the label before a speech to a speaker, a numbered voice, or nothing."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = [r for r in rows if r["speaker_id"]]
        self.family: dict[str, list[dict]] = defaultdict(list)
        self.given: dict[str, set[str]] = defaultdict(set)
        self.office: dict[str, str] = {}
        slips: dict[str, set[str]] = defaultdict(set)
        for r in self.rows:
            family = (r["family_name"] or "").casefold()
            full = (r["full_name"] or "").casefold()
            given = full.removesuffix(family).strip()
            r |= {"family": family, "given": given}
            if family:
                self.family[family].append(r)
                self.given[given].add(given)
                for slip in _slips(family):
                    slips[slip].add(family)
                for slip in _slips(given):
                    if len(slip) > 2:
                        self.given[slip].add(given)
            if r["office"]:
                self.office[r["office"].casefold()] = r["speaker_id"]
        named = (1 + sum(len((r[c] or "").split()) for c in ("full_name", "family_name", "party")) for r in self.rows)
        #: No label has more words: an honorific, a name and a party, or an office with its article.
        self.most = max([LABEL_WORDS, *named, *(1 + len(o.split()) for o in self.office)])
        self.slips = {s: next(iter(f)) for s, f in slips.items() if len(f) == 1 and s not in self.family and len(s) > 2}
        self.known: dict[str, str | None] = {}

    def who(self, label: str) -> str | None:
        """A speaker's id, ``voice:N``, 'unknown' for a name that several share, or None."""
        if len(label) > 80 and len(label.split()) > self.most:
            return None
        if label not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[label] = self._who(" ".join(label.casefold().split()))
        return self.known[label]

    def _who(self, label: str) -> str | None:
        label = label.strip(" .-–—>")
        if voice := _VOICE.fullmatch(label):
            return f"voice:{int(voice[1])}"
        party = None
        if paren := _PAREN.search(label):
            party, label = paren[1], label[: paren.start()]
        if (office := self.office.get(label.removeprefix("the ").strip())) is not None:
            return office
        if "," in label:
            family, _, given = (x.strip() for x in label.partition(","))
            return self._match(family, given=given) if given in self.given else None
        words = label.split()
        honorific = initial = given = None
        if words and words[0].rstrip(".") in _HONORIFIC and len(words) > 1:
            honorific = words.pop(0).rstrip(".")
        if len(words) > 1 and re.fullmatch(r"[^\W\d_]\.", words[0]):
            initial = words.pop(0)[0]
        elif len(words) > 1 and " ".join(words[:-1]) in self.given:
            given, words = " ".join(words[:-1]), words[-1:]
        return self._match(words[0], honorific, initial, given, party) if len(words) == 1 else None

    def _match(self, family: str, honorific: str | None = None, initial: str | None = None, given: str | None = None, party: str | None = None) -> str | None:
        people = self.family.get(family) or self.family.get(self.slips.get(family, ""), [])
        if not people:
            return None
        tests = [
            (given, lambda r: r["given"] in self.given[given]),
            (initial, lambda r: r["given"].startswith(initial)),
            (party, lambda r: (r["party"] or "").casefold() == party),
            (honorific, lambda r: (r["honorific"] or "").casefold() == honorific),
        ]
        for wanted, test in tests:
            if wanted and len(people) > 1:
                people = [r for r in people if test(r)] or people
        ids = {r["speaker_id"] for r in people}
        return ids.pop() if len(ids) == 1 else UNKNOWN

    def labels(self, text: str) -> list[tuple[int, int, str]]:
        """Labels in a text, as ``(from, to, who)``: tags and brackets anywhere, names before a colon anywhere, before a dash at the start."""
        found: list[tuple[int, int, str]] = []
        lead = _LEAD.match(text).end()
        if dash := _DASH.search(text, lead, self._after(text, lead)):
            name = text[lead : dash.start()]
            who = self.who(name) if name and ":" not in name else None
            after = text[dash.end() :].split(None, 1)
            if who and not (after and after[0].casefold().strip(",.") == name.split()[-1].casefold()):
                found.append((lead, dash.end(), who))
        for m in _CANDIDATE.finditer(text):
            if found and m.start() < found[-1][1]:
                continue
            if name := m[1] or m[2]:
                if who := self.who(name):
                    found.append((m.start(), m.end(), who))
                continue
            floor = found[-1][1] if found else 0
            for s in self._before(text, floor, m.start()):
                if who := self.who(text[s : m.start()]):
                    found.append((s, m.end(), who))
                    break
        return found

    def _after(self, text: str, lead: int) -> int:
        """Where the words that a label before a dash may have end, with the mark after them."""
        size = 16 * self.most
        while lead + size < len(text) and len(_WORD.findall(text, lead, lead + size)) <= self.most + 1:
            size *= 4
        return lead + size

    def _before(self, text: str, floor: int, end: int) -> list[int]:
        """Where the last words before ``end`` begin, as many as a label may have; no further back than ``floor``."""
        size = 16 * self.most
        while end - size > floor and len(_WORD.findall(text, end - size, end)) <= self.most:
            size *= 4
        low = max(floor, end - size)
        starts = [w.start() for w in _WORD.finditer(text, low, end)]
        if low > floor and not text[low - 1].isspace():
            starts = starts[1:]  # begins before what was looked at
        return starts[-self.most :]


def known_speakers(speakers: DataFrame) -> list[dict]:
    """Rows for ``Speakers``."""
    people = [r.asDict() for r in speakers.select("speaker_id", "full_name", "family_name", "honorific", "party", "office").limit(MAX_SPEAKERS + 1).collect()]
    if len(people) > MAX_SPEAKERS:
        raise ValueError(f"more than {MAX_SPEAKERS} speakers: resolve labels medium by medium")
    return people


def _ms(value: float) -> float | None:
    return None if value != value or value in (np.inf, -np.inf) else float(value)


class _Part:
    """Speech of one holder inside a block."""

    __slots__ = ("kind", "opened", "who", "seg", "pos", "start", "end", "texts")

    def __init__(self, kind: int, opened: str, who: str | None, seg: int, pos: int, start: float) -> None:
        self.kind, self.opened, self.who, self.seg, self.pos, self.start, self.end, self.texts = kind, opened, who, seg, pos, start, float("nan"), []


_CARRY, _PENDING, _SETTLED, _SUMMARY = range(4)


_MARKS = str.maketrans("", "", ".,;:!?")


def _repeated(before: str, plain: str, speech: str) -> int:
    """How many words of a speech (in plain words: without case and marks) repeat the end of what was said before."""
    head = plain.split(None, 3)[:3]
    if len(head) < 3 or " ".join(head) not in before:
        return 0
    words = plain.split()
    cut = _overlap(before.split(), words)
    if cut and len(words) != len(speech.split()):  # lone marks among the words: they go with what they follow
        done = 0
        for k, word in enumerate(speech.split()):
            done += bool(word.translate(_MARKS))
            if done > cut:
                return k
        return len(speech.split())
    return cut


def _overlap(before: list[str], words: list[str]) -> int:
    """How many words a segment repeats from the end of what was said (at least three), by a failure function."""
    words, n, fail = words[: len(before)], 0, [0]
    for word in words[1:]:
        while n and words[n] != word:
            n = fail[n - 1]
        n += words[n] == word
        fail.append(n)
    n = 0
    for word in before[-len(words) :] if words else []:
        while n and (n == len(words) or words[n] != word):
            n = fail[n - 1]
        n += words[n] == word
    return n if n > 2 else 0


def _spoken(texts: list[str], people: Speakers) -> tuple[list[tuple[int, str | None, int]], list[str], list[str]]:
    """Pieces of segments between labels: ``(segment, who the label before it names, labels of the segment)``, as spoken, and in plain words."""
    pieces, places = [], []
    for row, text in enumerate(texts):
        labels = people.labels(text) if _MAYBE.search(text) else []
        cuts = [0, *(x for a, b, _ in labels for x in (a, b)), len(text)]
        for k in range(0, len(cuts), 2):
            pieces.append(text[cuts[k] : cuts[k + 1]])
            places.append((row, labels[k // 2 - 1][2] if k else None, len(labels)))
    spoken = cleaned(pieces)
    return places, spoken, [" ".join(speech.casefold().translate(_MARKS).split()) for speech in spoken]


def _more(said: str, plain: str, speech: str, most: int) -> tuple[str, str]:
    """What is new in a speech, and the last ``most`` characters of what has been said with it."""
    cut = _repeated(said, plain, speech)
    fresh = " ".join(speech.split()[cut:]) if cut else speech
    return fresh, f"{said} {plain}"[-most:] if fresh else said


class _Before:
    """What a block knows of the blocks before it."""

    __slots__ = ("reach", "said", "limit")

    def __init__(self, reach: float | None = None, said: str | None = None, limit: float = np.inf) -> None:
        self.reach, self.said, self.limit = reach, said, limit


def _block(rows: list[tuple], people: Speakers, before: _Before, wanted: bool) -> list[_Part]:
    """Parts of one block's segments ``(seg, start, end, text, flag)``, in order, and its summary."""
    places, spoken, plains = _spoken([r[3] for r in rows], people)
    parts: list[_Part] = []
    holder, events, now = None, 0, None
    reach, said = -np.inf if before.reach is None else before.reach, before.said or ""
    row_before, pos = -1, 0
    tail = max(map(len, plains)) + 1  # no repetition is longer than what repeats
    for (row, who, n_labels), speech, plain in zip(places, spoken, plains):
        seg, start, end, _, flag = rows[row]
        pos = 0 if row != row_before else pos + 1
        first_of_row, row_before = row != row_before, row
        opened = None
        if who is not None:
            if not events:
                opened, kind = "label", _PENDING
            elif who != holder:
                opened, kind = "label", _SETTLED
            holder, events = who, events + 1
        elif flag and first_of_row and not n_labels and any(c.isalnum() for c in speech):
            opened, kind, holder, events = "flag", _SETTLED, "flag", events + 1
        if opened is None and speech and (now is not None or before.said is not None) and first_of_row and start - reach > before.limit:
            opened, kind = "pause", _SETTLED if events else _CARRY
        if opened is not None or (now is None and speech):
            now = _Part(kind if opened else _CARRY, opened or "carry", holder if events else None, seg, pos, start)
            parts.append(now)
        if first_of_row and end == end:
            reach = max(reach, end)
        if speech and now is not None:
            if wanted:
                fresh, said = _more(said, plain, speech, tail)
                now.texts.append(fresh)
            now.end = np.fmax(now.end, end)
    parts.append(_Part(_SUMMARY, "", holder if events else None, rows[-1][0], 1 << 20, float("nan")))
    return parts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole blocks, and where each begins (one more entry than blocks)."""
    for batch in whole_groups(batches, [0, 1]):
        yield batch, np.append(np.flatnonzero(changes(batch, [0, 1])), batch.num_rows)


def _floats(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column).to_numpy(zero_copy_only=False), float)


def _parts(batches: Iterator[pa.RecordBatch], names: list[str], people: list[dict], pause_ms: float | None, wanted: bool) -> Iterator[pa.RecordBatch]:
    speakers = Speakers([dict(r) for r in people])
    for batch, bounds in _blocks(batches):
        block = batch.column(1).to_numpy()
        columns = [batch.column(2).to_pylist(), *(_floats(batch, c).tolist() for c in (3, 4)), batch.column(5).to_pylist(), batch.column(6).to_pylist()]
        told = batch.num_columns > 7
        reach, limit = (_floats(batch, c).tolist() if told else [] for c in (7, 8))
        at: list[int] = []
        out: list[_Part] = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            usual = pause_ms if pause_ms is not None else limit[low]
            before = _Before(_ms(reach[low]), batch.column(9)[low].as_py(), usual) if told else _Before(limit=usual)
            found = _block(list(zip(*(c[low:high] for c in columns))), speakers, before, wanted)
            out += found
            at += [low] * len(found)
        arrays = [
            batch.column(0).take(pa.array(at, pa.int64())),
            pa.array([-1 if p.kind != _SETTLED else b for p, b in zip(out, block[at].tolist())], pa.int32()),
            pa.array(block[at], pa.int32()),
            pa.array([p.kind for p in out], pa.int8()),
            pa.array([p.opened for p in out], pa.string()),
            pa.array([p.who for p in out], pa.string()),
            pa.array([p.seg for p in out], pa.int64()),
            pa.array([p.pos for p in out], pa.int32()),
            pa.array([_ms(p.start) for p in out], pa.float64()),
            pa.array([_ms(p.end) for p in out], pa.float64()),
            pa.array([" ".join(t for t in p.texts if t) if wanted else None for p in out], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


# ---------------------------------------------------------------- what blocks tell each other


def _tail(texts: list[str], people: Speakers, most: int) -> str | None:
    """The last ``most`` characters that segments say, in plain words; null if they say nothing."""
    if not most:
        return None
    n = 8
    while True:
        _, spoken, plains = _spoken(texts[-n:], people)
        if n >= len(texts) or sum(map(len, plains)) > 2 * most:
            break
        n *= 4
    said = None
    for speech, plain in zip(spoken, plains):
        if speech:
            said = _more(said or "", plain, speech, most)[1]
    return said


def _tell(batches: Iterator[pa.RecordBatch], names: list[str], people: list[dict]) -> Iterator[pa.RecordBatch]:
    """Per block: its first position, how far time reaches, its edges, a histogram of its gaps, and its tail (column 7: how long)."""
    speakers = Speakers([dict(r) for r in people])
    for batch, bounds in _blocks(batches):
        low, high = bounds[:-1], bounds[1:]
        start, end = _floats(batch, 3), _floats(batch, 4)
        gap = np.append(np.nan, start[1:] - end[:-1])
        gap[low] = np.nan
        buckets, n = np.unique(np.stack([np.repeat(np.arange(len(low)), high - low), _bucket(gap)])[:, gap > 0], axis=1, return_counts=True)
        cuts = pa.array(np.searchsorted(buckets[0], np.arange(len(low) + 1)).astype(np.int32))
        later = batch.column(7).to_pylist()
        reach = np.fmax.reduceat(end, low)
        arrays = [
            batch.column(0).take(pa.array(low)),
            batch.column(1).take(pa.array(low)),
            batch.column(2).take(pa.array(low)),
            *(pa.array(x, mask=np.isnan(x)) for x in (reach, start[low], end[high - 1])),
            pa.ListArray.from_arrays(cuts, pa.array(buckets[1].astype(np.int32))),
            pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int64))),
            batch.column(7).take(pa.array(low)),
            pa.array([_tail([t.as_py() for t in batch.column(5)[a:b]] if later[a] else [], speakers, later[a] or 0) for a, b in zip(low.tolist(), high.tolist())], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _bucket(gap: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(gap > 0, np.ceil(_FINE * np.log2(np.where(gap > 0, gap, 1))), 0).astype(np.int64)


def _pass_on(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, with how far time had reached before each, and what had been said last."""
    entity = reach = said = None
    for batch in batches:
        out = []
        for own, ends, most, tail in zip(*(batch.column(c).to_pylist() for c in (0, 3, 8, 9))):
            if own != entity:
                entity, reach, said = own, None, None
            out.append((reach, said))
            reach = ends if reach is None or (ends is not None and ends > reach) else reach
            if tail is not None:
                said = tail if said is None else f"{said} {tail}"
            said = said[-most:] if said is not None and most else said
        if out:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2)), pa.array([r for r, _ in out], pa.float64()), pa.array([x for _, x in out], pa.string())], names=names)


def _gaps(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Histograms of gaps, with those between the blocks of an entity, which come in order."""
    entity = closed = None
    for batch in batches:
        entities, opens, closes = (batch.column(c).to_pylist() for c in (0, 4, 5))
        gap = np.full(batch.num_rows, np.nan)
        for k, own in enumerate(entities):
            if own == entity and opens[k] is not None and closed is not None:
                gap[k] = opens[k] - closed
            entity, closed = own, closes[k]
        lists = batch.column(6)
        some = np.flatnonzero(gap > 0)
        rows = np.append(np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists))), some)
        arrays = [batch.column(0).take(pa.array(rows)), pa.array(np.append(np.asarray(lists.flatten()), _bucket(gap)[some]).astype(np.int32)), pa.array(np.append(np.asarray(batch.column(7).flatten()), np.ones(len(some), np.int64)).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _context(current: DataFrame, raw: DataFrame, people: list[dict]) -> DataFrame:
    """Per block: ``entity, block, first, reach, said, limit``, what the blocks before it and the gaps of its medium say."""
    kind = current.schema["entity"].dataType
    # How long a segment of a later block may be, which is as much of this one's end as it can repeat (letters may fold to three).
    sized = raw.where("entity IS NOT NULL AND block IS NOT NULL").groupBy("entity", "block").agg((F.max(F.length("text")) * 3 + 1).alias("size")).repartition("entity")
    later = sized.select("entity", "block", F.max("size").over(Window.partitionBy("entity").orderBy("block").rowsBetween(1, Window.unboundedFollowing)).cast("int").alias("later"))
    fields = [("entity", kind), ("block", T.IntegerType()), ("first", T.LongType()), ("reach", T.DoubleType()), ("opens", T.DoubleType()), ("closes", T.DoubleType()), ("bucket", T.ArrayType(T.IntegerType())), ("n", T.ArrayType(T.LongType())), ("later", T.IntegerType()), ("tail", T.StringType())]
    told = T.StructType([T.StructField(*f) for f in fields])
    names = told.fieldNames()
    ordered = current.join(later, ["entity", "block"]).select(*current.columns, "later").sortWithinPartitions("entity", "block", "position")
    blocks = ordered.mapInArrow(lambda it: _tell(it, names, people), told).where("entity IS NOT NULL AND block IS NOT NULL").repartition("entity").sortWithinPartitions("entity", "block")

    # Both readers of this exchange take all its columns.
    counted = T.StructType([told["entity"], T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    gaps = blocks.mapInArrow(lambda it: _gaps(it, counted.fieldNames()), counted).groupBy("entity", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("entity")
    ranked = gaps.select("entity", "bucket", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("all"))
    limits = ranked.where(F.col("upto") >= USUAL * F.col("all")).groupBy("entity").agg(F.greatest(F.lit(LEAST_PAUSE), F.pow(F.lit(2.0), F.min("bucket") / _FINE)).alias("limit"))

    passed = T.StructType([told["entity"], told["block"], told["first"], told["reach"], T.StructField("said", T.StringType())])
    before = blocks.mapInArrow(lambda it: _pass_on(it, passed.fieldNames()), passed)
    return before.join(limits, "entity", "left").withColumn("limit", F.coalesce("limit", F.lit(LEAST_PAUSE)))


def speaker_turns(df: DataFrame, speakers: DataFrame, entity: str = "media_id", position: str = "seg_idx", version: str = "ingested_at", pause_ms: float | None = None, block: int = BLOCK, texts: bool = True) -> DataFrame:
    """Clean, ordered speaker turns of each medium.

    Columns: entity, ``seg_idx, part`` (the place in that segment where the turn
    opens), ``speaker_id, opened_by, start_ms, end_ms, text``.  ``opened_by`` is

    * 'label': a label names somebody other than the holder of the floor;
    * 'flag': ``turn`` is true on a segment with spoken words and no label;
    * 'pause': the holder went on after a pause longer than ``pause_ms`` (by
      default than 99 % of the gaps between neighbouring segments of the medium,
      to an eighth of a doubling, and two seconds; infinite: pauses open nothing);
    * 'carry': speech at the start of a medium before anybody was named, or
      of a turn that began in an earlier block: a turn's text comes in one row
      per block, so no row grows with the transcript.

    ``speaker_id`` is from ``speakers``, or 'unknown' for flags, numbered voices
    and names that several share with nothing to tell them apart.  Of rows with
    one (entity, position) the latest version counts; null and blank texts say
    nothing; null flags are false; rows without entity or position are left out;
    unusable times are null.  An empty table gives an empty result; further
    columns aren't read.

    ``block`` positions are ordered by a task at a time; but for the 'carry' rows
    the result doesn't depend on it.  Without ``texts``, texts are null, and with
    an infinite pause besides, blocks have nothing to tell each other but who
    holds the floor.
    """
    people = known_speakers(speakers)
    rows = df.select(F.col(entity).alias("entity"), F.col(position).cast("long").alias("position"), F.col("start_ms").cast("double").alias("start"), F.col("end_ms").cast("double").alias("end"), F.col("text"), F.coalesce(F.col("turn"), F.lit(False)).alias("turn"), F.col(version).alias("version"))
    current = latest_in_blocks(rows, "entity", "position", "version", block).where(F.length(F.trim("text")) > 0).select("entity", "block", "position", "start", "end", "text", "turn")
    if texts or pause_ms is None:
        known = _context(current, rows.withColumn("block", block_of("position", block)), people)
        said = F.when(F.col("position") == F.col("first"), F.col("said"))  # one row of a block has it
        current = current.join(known, ["entity", "block"]).select(*current.columns, "reach", "limit", said.alias("said")).sortWithinPartitions("entity", "block", "position")
    schema = T.StructType(
        [T.StructField("entity", df.schema[entity].dataType), T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("kind", T.ByteType()), T.StructField("opened", T.StringType()), T.StructField("who", T.StringType()), T.StructField("seg", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())]
    )
    names = schema.fieldNames()
    parts = current.mapInArrow(lambda it: _parts(it, names, people, pause_ms, texts), schema)
    before = F.last("who", ignorenulls=True).over(Window.partitionBy("entity", "bucket").orderBy("block", "seg", "part").rowsBetween(Window.unboundedPreceding, -1))
    placed = parts.withColumn("before", before).where(F.col("kind") != _SUMMARY)
    goes_on = (F.col("kind") == _PENDING) & F.col("before").eqNullSafe(F.col("who"))
    opened = F.when(goes_on, F.lit("carry")).otherwise(F.col("opened"))
    who = F.coalesce(F.when(F.col("kind") == _CARRY, F.col("before")).otherwise(F.col("who")), F.lit(UNKNOWN))
    speaker = F.when(who.rlike("^(voice:[0-9]+|flag)$"), F.lit(UNKNOWN)).otherwise(who)
    return placed.select(
        F.col("entity").alias(entity), F.col("seg").cast(df.schema[position].dataType).alias("seg_idx"), "part", speaker.alias("speaker_id"), opened.alias("opened_by"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "text"
    )
