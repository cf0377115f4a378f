"""Languages of documents, of the parts of mixed ones, and of transcript segments.

Method: language-bitmask n-gram filters.  One table of bytes holds eight Bloom
filters side by side: bit ``l`` of a place belongs to language ``l``, so the
``AND`` of the places an n-gram hashes to is the set of all languages that have
it.  Counting set bits per language over a sentence, less what false positives
are expected to add, gives the share of its n-grams each language accounts for;
the largest share decides, if it leads by enough.

The filters are fitted here: fixed lists of function words label sentences of a
bounded sample of documents, what the filters then say labels them anew, and
labels of the data serve only to draw the sample evenly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.stream import changes, whole_groups
from cuewright.functions.textvec import SLICE_BYTES, Slice, as_strings, slices
from cuewright.llm.turns import Speakers, known_speakers

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl")
#: Documents per label (and as many without a usable one) that the filters are fitted on.
SAMPLE = 150
#: Sentences of such a document that are fitted on (of more, those that come first by a hash), and characters of a sentence.
SAMPLE_SENTENCES, SAMPLE_CHARS = 250, 400
#: Sentences with fewer n-grams than this are too short to decide alone.
LEAST_GRAMS = 8
#: Lead, as a share of the n-grams and in n-grams, that a decision needs.
LEAD, LEAD_GRAMS = 0.06, 2.5
#: An n-gram rarer than this in a language isn't of it.
RARE = 2e-5
#: Places of a filter and hash functions.
_BITS, _HASHES = 20, (np.uint32(2654435761), np.uint32(2246822519))

#: Common function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to that is was for on with as have be this from not are but had which they you were their been has will would who more if out so what about can we there when into some could than them then only its our these may any",
    "de": "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wir ich keine ohne",
    "fr": "le la les de des du et un une est que qui dans pour pas sur au avec ce il sont plus par je se ne vous nous mais ou comme elle aux cette ses leur été fait être avait sans tout ont même avant ces où très chez notre",
    "es": "el los las de del que y en un una por con no se su para es al lo como más pero sus le ya fue este ha sí porque esta son entre está cuando muy sin sobre ser tiene también me hasta hay donde quien desde nos todos antes nuestro",
    "pt": "o os as de do da dos das que e em um uma para com não por se na no mais como mas foi ao ele seu sua ou ser quando muito nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me antes nosso",
    "it": "il lo gli di del della dei delle che e un una per con non si è da in al alla sono come ma anche più nel nella ha questo se dal dalla ci o le suo sua loro essere stato perché molto fra dopo senza ogni prima quando noi hanno nostro",
    "nl": "de het een van en in is dat op te zijn voor met niet aan er om ook als dan maar bij nog uit wordt door naar heeft hij ze wel over was worden of deze tot meer dit geen hun zou kan al moet zij onze wij zo sinds zonder",
    "pl": "i w z na do nie się że jest to jak po co o ale za od przez tak już dla jego który tylko być ich czy może przed jej była które był ma oraz bez nad także tego tym pod są gdzie lub aby ten nas przy kiedy więc mu wciąż nasz",
}
#: Names of languages in labels, beside their two-letter codes.
NAMES = {
    "en": "eng english englisch anglais ingles inglés",
    "de": "deu ger german deutsch allemand aleman alemán",
    "fr": "fra fre french francais français französisch",
    "es": "spa spanish espanol español castellano spanisch",
    "pt": "por portuguese portugues português portugiesisch",
    "it": "ita italian italiano italienisch",
    "nl": "nld dut dutch nederlands niederländisch flemish vlaams",
    "pl": "pol polish polski polnisch",
}


def named_language(label: Column) -> Column:
    """The two-letter code a label names, whatever its spelling; null if it names none of ours."""
    plain = F.lower(F.regexp_replace(label, r"^[\s]+|[\s]+$", ""))
    head = F.regexp_extract(plain, r"^(\p{L}+)(?:[-_ .(].*)?$", 1)
    pairs = [F.lit(x) for code in LANGUAGES for name in [code, *NAMES[code].split()] for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), head)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes from each place on, letters only, and whether they are an n-gram: no two blanks together."""
    text = np.full(len(data) + 4, 32, np.uint8)
    text[: len(data)] = _FOLD[data]
    wide = text.astype(np.uint32)
    n = len(data)
    keys = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3 : n + 3] << np.uint32(24)
    blank = text == 32
    pair = blank[:-1] & blank[1:]
    good = ~(pair[:n] | pair[1 : n + 1] | pair[2 : n + 2])
    return keys, good


def _places(keys: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (keys ^ (keys >> np.uint32(15))) * _HASHES[k]
        return (mixed ^ (mixed >> np.uint32(13))) * _HASHES[1 - k] >> np.uint32(32 - _BITS)


@dataclass
class Filters:
    """Eight Bloom filters side by side, and how often each says yes to what it doesn't hold."""

    table: np.ndarray
    false: np.ndarray

    @classmethod
    def build(cls, grams: list[np.ndarray]) -> Filters:
        table = np.zeros(1 << _BITS, np.uint8)
        for language, keys in enumerate(grams):
            for k in range(len(_HASHES)):
                table[_places(keys.astype(np.uint32), k)] |= np.uint8(1 << language)
        fill = np.array([((table >> l) & 1).mean() for l in range(len(grams))])
        return cls(table, fill ** len(_HASHES))

    def shares(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the stretches that begin at ``cuts``, of any length: n-grams, and the share of them each language has."""
        if not len(cuts):
            return np.zeros(0), np.zeros((0, len(LANGUAGES)))
        keys, good = _grams(data)
        good &= ~_asides(data)
        mask = self.table[_places(keys, 0)] & self.table[_places(keys, 1)]
        mask[~good] = 0
        wide = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SPREAD[mask & 0x0F], out=wide[1:])  # four 16-bit counters to a word: long stretches are counted in pieces, before they run over
        ends = np.append(cuts[1:], len(data))
        pieces = np.union1d(cuts, np.arange(cuts[0], len(data), _STRETCH)) if (ends - cuts).max() > _STRETCH else cuts
        piece_ends = np.append(pieces[1:], len(data))
        counts = np.empty((len(pieces), len(LANGUAGES)))
        _unspread(wide, pieces, piece_ends, counts, 0)
        np.cumsum(_SPREAD[mask >> 4], out=wide[1:])
        _unspread(wide, pieces, piece_ends, counts, 4)
        if pieces is not cuts:
            whole = np.zeros((len(cuts), len(LANGUAGES)))
            np.add.at(whole, np.searchsorted(cuts, pieces, "right") - 1, counts)
            counts = whole
        total = np.concatenate([[0], np.cumsum(good)])
        n = (total[ends] - total[cuts]).astype(float)
        fair = (counts - n[:, None] * self.false) / (1 - self.false)
        return n, np.clip(fair, 0, None) / np.maximum(n, 1)[:, None]


_SPREAD = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)
#: Share of a text's n-grams that must lie in sentences which decide.
_RUNNING = 0.3
#: Longest piece of a stretch whose counts fit 16 bits.
_STRETCH = 60_000
#: A stretch of more bytes without an end mark (punctuation may be lost) is cut into windows; a window counts as a sentence.
_LONG, _WINDOW = 240, 64


def _unspread(wide: np.ndarray, cuts: np.ndarray, ends: np.ndarray, counts: np.ndarray, first: int) -> None:
    with np.errstate(over="ignore"):
        packed = wide[ends] - wide[cuts]
    for b in range(4):
        counts[:, first + b] = (packed >> np.uint64(16 * b)) & np.uint64(0xFFFF)


def decide(n: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading language of each stretch (-1: none leads by enough) and a confidence from 0 to 1.

    The confidence is the lead of the first over the second language, as a part
    of the first one's share.
    """
    order = np.argsort(shares, axis=1)
    best, second = order[:, -1], order[:, -2]
    rows = np.arange(len(n))
    top = shares[rows, best]
    lead = top - shares[rows, second]
    sure = (n >= LEAST_GRAMS) & (top >= 0.45) & (lead >= LEAD) & (lead * n >= LEAD_GRAMS)
    confidence = np.round(np.where(top > 0, lead / np.maximum(top, 1e-9), 0.0), 4)
    return np.where(sure, best, -1), confidence


def sentences(part: Slice) -> np.ndarray:
    """Where sentences begin: at each row, after end marks before a blank, after empty lines; long ones are cut into windows."""
    data = part.data
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    follows = np.concatenate([data[1:], [32]]).astype(np.uint8)
    end = np.isin(data, np.frombuffer(b".!?", np.uint8)) & ((follows <= 32) | np.isin(follows, np.frombuffer(b"\")]'", np.uint8)))
    end |= (data == 10) & (follows == 10)
    cuts = np.unique(np.concatenate([np.flatnonzero(end) + 1, part.offsets[:-1]]))
    cuts = cuts[cuts < n]
    sizes = np.diff(np.append(cuts, n))
    windows = np.where(sizes > _LONG, sizes // _WINDOW, 1)
    step = np.where(sizes > _LONG, _WINDOW, 0)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    return np.repeat(cuts, windows) + at * np.repeat(step, windows)


_ASIDE = re.compile(rb"\([^()]{0,200}\)|\[[^\[\]]{0,200}\]|\*[^*]{1,60}\*|<[^<>]{1,80}>")


def _asides(data: np.ndarray) -> np.ndarray:
    """Bytes inside brackets: interruptions and notes by others, in whatever language, say nothing."""
    inside = np.zeros(len(data) + 1, np.int8)
    body = data.tobytes()
    if any(mark in body for mark in (b"(", b"[", b"*", b"<")):
        spans = np.array([m.span() for m in _ASIDE.finditer(body)], np.int64).reshape(-1, 2)
        inside[spans[:, 0]] += 1
        inside[spans[:, 1]] -= 1
    return np.cumsum(inside[:-1]) > 0


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(as_strings(column))


# ---------------------------------------------------------------- fitting


def fit(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = SAMPLE, per_text: int = SAMPLE_SENTENCES, rounds: int = 3) -> Filters:
    """Filters for ``LANGUAGES``, fitted on at most ``per_label`` documents of each label and ``per_text`` sentences of each.

    This bounds only what is fitted on; ``document_languages`` reads whole texts.

    The documents of a label (and those with none) that come first by a hash of
    their key are the sample, so it is the same whatever the partitioning; one
    pass over the corpus keeps that many rows per label and task.  The sentences
    of a longer text are drawn from all of it, by a hash of their words; one of
    more than ``SAMPLE_CHARS`` characters counts as several.
    """
    named = F.coalesce(named_language(F.col(label)), F.lit("")).alias("named")
    order = Window.partitionBy("named").orderBy(F.xxhash64("key"), "text")
    picked = (
        documents.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), named)
        .where(F.length("text") > 40)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_label)
    )
    said = F.regexp_extract_all("text", F.lit(rf"(?s)(?:[^.!?]|[.!?](?!\s)){{1,{SAMPLE_CHARS}}}[.!?]*\s*"), 0)
    drawn = F.array_sort(F.transform(said, lambda s: F.struct(F.xxhash64(s).alias("hash"), s.alias("s"))))
    some = F.array_join(F.transform(F.slice(drawn, 1, per_text), lambda x: x["s"]), "\n\n")
    texts = [r["text"] for r in picked.orderBy("named", "rank").select(F.when(F.size(said) <= per_text, F.col("text")).otherwise(some).alias("text")).collect()]
    return fit_texts(texts, rounds)


def fit_texts(texts: list[str], rounds: int = 3) -> Filters:
    """Filters from unlabelled texts: function words label sentences first, then the filters do.

    What counts is how frequent an n-gram is within a language, so languages
    needn't have samples of one size.  Capitalised words are kept only where they
    are of one language: names are of none.
    """
    words = [set(FUNCTION_WORDS[l].split()) for l in LANGUAGES]
    seeds = [np.unique(np.concatenate([_grams(np.frombuffer(f" {w} ".encode(), np.uint8))[0][:-1] for w in FUNCTION_WORDS[l].split()])) for l in LANGUAGES]
    parts = [(k, s) for k, text in enumerate(texts) for s in _SENTENCE.split(_BRACKETED.sub(" ", text)) if len(s) > 10]
    said, owner = [s for _, s in parts], np.array([k for k, _ in parts], np.int64)
    labels = _with_neighbours(np.array([_by_function_words(s.lower().split(), words) for s in said], np.int64), owner)
    filters = Filters.build(seeds)
    whole = next(slices(_lower(pa.array(["\n\n".join(said)], pa.string())))) if said else None
    for _ in range(rounds if said else 0):
        filters = _refit(said, labels, seeds)
        sizes = np.array([len(s.lower().encode()) + 2 for s in said])
        cuts = np.minimum(np.cumsum(sizes) - sizes, len(whole.data) - 1)
        labels = _with_neighbours(decide(*filters.shares(whole.data, cuts))[0], owner)
    return filters


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\n+")
_BRACKETED = re.compile(r"\([^()]{0,200}\)|\[[^\[\]]{0,200}\]|[\w .,]{0,50}:(?=\s)")
_CAPITALISED = re.compile(r"\b[^\W\d_a-zà-ÿąćęłńóśźż][^\W\d_]*")


def _with_neighbours(labels: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sentences that nothing decides take the language of their text, if it is nearly all in one."""
    if not len(labels):
        return labels
    counts = np.zeros((owner.max() + 1, len(LANGUAGES)))
    np.add.at(counts, (owner[labels >= 0], labels[labels >= 0]), 1)
    total = counts.sum(axis=1)
    clear = np.where((total >= 2) & (counts.max(axis=1) >= 0.9 * total), counts.argmax(axis=1), -1)
    return np.where(labels >= 0, labels, clear[owner])


def _by_function_words(said: list[str], words: list[set[str]]) -> int:
    hits = sorted(((sum(w.strip(".,;:!?") in known for w in said), l) for l, known in enumerate(words)), reverse=True)
    return hits[0][1] if hits[0][0] >= 2 and hits[0][0] >= hits[1][0] + 2 else -1


def _refit(said: list[str], labels: np.ndarray, seeds: list[np.ndarray]) -> Filters:
    where: dict[str, Counter] = {}
    for s, l in zip(said, labels.tolist()):
        if l >= 0 and not s.isupper():
            for w in _CAPITALISED.findall(s):
                where.setdefault(w, Counter())[l] += 1
    own = {w for w, c in where.items() if len(c) == 1 and max(c.values()) >= 3}
    keys = []
    for l in range(len(LANGUAGES)):
        text = "\n".join(_CAPITALISED.sub(lambda m: m[0] if m[0] in own else "\n", s) if not s.isupper() else "" for s, k in zip(said, labels.tolist()) if k == l)
        grams, good = _grams(np.frombuffer(text.lower().encode(), np.uint8))
        keys.append(grams[good])
    everything = np.unique(np.concatenate(keys))
    many = np.array([np.bincount(np.searchsorted(everything, k), minlength=len(everything)) for k in keys])
    rate = many / np.maximum(many.sum(axis=1, keepdims=True), 1)
    # A gram belongs to the languages in which it is not much rarer than where it is most common.
    belongs = (rate >= np.maximum(0.08 * rate.max(axis=0), RARE)) & (many >= 2)
    return Filters.build([np.union1d(everything[b], seed) for b, seed in zip(belongs, seeds)])


# ---------------------------------------------------------------- documents


def _documents(batches: Iterator[pa.RecordBatch], filters: Filters, names: list[str]) -> Iterator[pa.RecordBatch]:
    codes = pa.array(LANGUAGES, pa.string())
    for batch in batches:
        for part in slices(_lower(batch.column(1)), SLICE_BYTES // 2):
            cuts = sentences(part)
            n, shares = filters.shares(part.data, cuts)
            own, sure = decide(n, shares)
            row = np.searchsorted(part.offsets, cuts, "right") - 1
            weight = np.zeros((part.rows, len(LANGUAGES)))
            count = np.zeros((part.rows, len(LANGUAGES)), np.int64)
            known = own >= 0
            np.add.at(weight, (row[known], own[known]), n[known])
            np.add.at(count, (row[known], own[known]), 1)
            # What no sentence decides, the whole text may.
            votes = np.zeros((part.rows, len(LANGUAGES)))
            grams = np.zeros(part.rows)
            np.add.at(votes, row, shares * n[:, None])
            np.add.at(grams, row, n)
            whole, whole_sure = decide(grams, votes / np.maximum(grams, 1)[:, None])
            total = weight.sum(axis=1)
            # In a list of names a window or two may look like a language: that is no running text.
            total[total < _RUNNING * grams] = 0
            main = np.where(total > 0, weight.argmax(axis=1), whole)
            part_of = weight[np.arange(part.rows), np.maximum(main, 0)] / np.maximum(total, 1)
            confidence = np.where(total > 0, part_of * whole_sure, whole_sure)
            # Runs of sentences in one language; those too short to decide go with the run.
            last = np.maximum.accumulate(np.where(known, np.arange(len(own)), -1)) if len(own) else own
            fill = np.where(last >= np.searchsorted(row, row), own[last], main[row])
            opens = np.ones(len(cuts), bool)
            opens[1:] = (row[1:] != row[:-1]) | (fill[1:] != fill[:-1])
            at = np.flatnonzero(opens)
            ends = np.append(cuts[at[1:]], len(part.data)) if len(at) else np.zeros(0, np.int64)
            points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
            base = points[part.offsets[row[at]]]
            run_n, run_shares = filters.shares(part.data, cuts[at])
            run_sure = decide(run_n, run_shares)[1]
            n_sentences = np.add.reduceat(known.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays(
                [codes.take(pa.array(fill[at], mask=fill[at] < 0)), pa.array((points[cuts[at]] - base).astype(np.int32)), pa.array((points[ends] - base).astype(np.int32)), pa.array(n_sentences.astype(np.int32)), pa.array(run_sure)],
                names=["lang", "begin", "end", "sentences", "confidence"],
            )
            span_cuts = np.searchsorted(row[at], np.arange(part.rows + 1)).astype(np.int32)
            tallies = np.argwhere(count > 0)
            tally = pa.StructArray.from_arrays([codes.take(pa.array(tallies[:, 1])), pa.array(count[tallies[:, 0], tallies[:, 1]].astype(np.int32))], names=["lang", "sentences"])
            tally_cuts = np.searchsorted(tallies[:, 0], np.arange(part.rows + 1)).astype(np.int32)
            none = main < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(part.first, part.rows),
                    codes.take(pa.array(np.maximum(main, 0), mask=none)),
                    pa.array(np.round(confidence, 4), mask=none),
                    pa.ListArray.from_arrays(pa.array(tally_cuts), tally),
                    pa.ListArray.from_arrays(pa.array(span_cuts), spans),
                ],
                names=names,
            )


def document_languages(df: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every document and of the parts of mixed ones.

    Columns: ``key, detected, confidence, tally`` (sentences by language, those
    long enough to decide) and ``parts`` (runs of sentences in one language:
    ``lang, begin, end`` in code points, ``sentences, confidence``).  A text
    without running words (null, blank, a list of names) has null ``detected``.
    One row per input row; repeated rows repeat; further columns aren't read.
    A text longer than a slice is cut into sentences all the same.  Narrow: no shuffle.
    """
    schema = T.StructType(
        [
            T.StructField("key", df.schema[key].dataType),
            T.StructField("detected", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("tally", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("sentences", T.IntegerType())]))),
            T.StructField("parts", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("sentences", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))),
        ]
    )
    shared = df.sparkSession.sparkContext.broadcast(filters)
    names = schema.fieldNames()
    found = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lambda it: _documents(it, shared.value, names), schema)
    return found.withColumnRenamed("key", key)


# ---------------------------------------------------------------- segments


def _without_label(column: pa.Array, people: Speakers) -> pa.Array:
    """Texts without the label at their head, where there is one: other words before a colon or a dash are spoken.

    A label isn't in the language of the speech.  It ends within as many words
    as one may have, and a few for a time stamp and the like before it.
    """
    head = rf"^(?:-\s+)?(?:\S*[^\s:—–-]\s+){{0,{people.most + 4}}}(?:\S*[:—]|[-–])(?:\s|$)"
    maybe = pc.match_substring_regex(column, head)
    spoken = []
    for text in column.filter(maybe).to_pylist():
        end = re.match(head, text)
        label = next((x for x in people.labels(text) if end and x[0] < end.end()), None)
        spoken.append(f"{text[: label[0]]} {text[label[1] :]}" if label else text)
    return pc.replace_with_mask(column, maybe, pa.array(spoken, column.type))


def _segments(batches: Iterator[pa.RecordBatch], filters: Filters, names: list[str], speakers: list[dict]) -> Iterator[pa.RecordBatch]:
    """Per (entity, block, language): the segments in it, and how sure each is; languages are told on whole texts."""
    people = Speakers([dict(r) for r in speakers])
    codes = pa.array(LANGUAGES, pa.string())
    for batch in whole_groups(batches, [0, 1]):
        group = np.cumsum(changes(batch, [0, 1])) - 1
        own, sure = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        spoken = _without_label(_lower(batch.column(3)), people)
        for part in slices(spoken, SLICE_BYTES // 2):
            cuts = np.unique(np.concatenate([part.offsets[:-1], np.arange(0, len(part.data), _STRETCH)]))
            cuts = cuts[cuts < len(part.data)]
            n, shares = filters.shares(part.data, cuts)
            row = np.searchsorted(part.offsets, cuts, "right") - 1
            grams, votes = np.zeros(part.rows), np.zeros((part.rows, len(LANGUAGES)))
            np.add.at(grams, row, n)
            np.add.at(votes, row, shares * n[:, None])
            place = slice(part.first, part.first + part.rows)
            own[place], sure[place] = decide(grams, votes / np.maximum(grams, 1)[:, None])
        known = np.flatnonzero(own >= 0)
        known = known[np.lexsort((known, own[known], group[known]))]
        both = group[known] * len(LANGUAGES) + own[known]
        opens = np.ones(len(known), bool)
        opens[1:] = both[1:] != both[:-1]
        at = np.flatnonzero(opens)
        offsets = pa.array(np.append(at, len(known)).astype(np.int32))
        rows = pa.array(known[at])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows),
                batch.column(1).take(rows).cast(pa.int32()),
                codes.take(pa.array(own[known[at]])),
                pa.array(np.diff(np.append(at, len(known)))),
                pa.ListArray.from_arrays(offsets, batch.column(2).take(pa.array(known))),
                pa.ListArray.from_arrays(offsets, pa.array(sure[known])),
            ],
            names=names,
        )


def segment_languages(current: DataFrame, filters: Filters, entity: str = "media_id", position: str = "seg_idx", text: str = "text", speakers: DataFrame | None = None) -> DataFrame:
    """Segments by medium, block and language: ``entity, block, lang, n, positions, confidences``.

    ``current`` comes from ``latest_in_blocks``.  A row lists the positions of one
    block in one language, so what is joined per medium later are a few rows per
    block and not its segments.  Segments that no language leads in (no words,
    names only, a word or two) are in no list.  Labels that name one of
    ``speakers`` or number a voice are no part of the speech.
    """
    people = known_speakers(speakers) if speakers is not None else []
    schema = T.StructType(
        [
            T.StructField("entity", current.schema[entity].dataType),
            T.StructField("block", T.IntegerType()),
            T.StructField("lang", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("positions", T.ArrayType(T.LongType())),
            T.StructField("confidences", T.ArrayType(T.DoubleType())),
        ]
    )
    shared = current.sparkSession.sparkContext.broadcast(filters)
    names = schema.fieldNames()
    rows = current.select(F.col(entity).alias("entity"), "block", F.col(position).cast("long").alias("position"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(lambda it: _segments(it, shared.value, names, people), schema)
    return found.withColumnRenamed("entity", entity)


def main_languages(by_block: DataFrame, entity: str = "media_id") -> DataFrame:
    """The language most segments of each medium are in: ``entity, block, main``, one row per block; ties go to the first in the alphabet.

    A row per block, so that who joins it to the positions of a medium does so
    block by block: only counts of blocks ever meet by medium alone.  Counts
    positions, not ``n``, so that both sides of that join read the same exchange.
    """
    counts = by_block.groupBy(entity, "block", "lang").agg(F.sum(F.size("positions")).alias("n")).repartition(entity)
    totals = counts.withColumn("total", F.sum("n").over(Window.partitionBy(entity, "lang")))
    main = F.min_by("lang", F.struct(-F.col("total"), F.col("lang"))).over(Window.partitionBy(entity))
    return totals.withColumn("main", main).groupBy(entity, "block").agg(F.first("main").alias("main"))
