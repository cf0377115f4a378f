"""Reading level of English documents on the scale of graded passages.

Method: regularised ordinal regression (proportional odds) over features of
lexical diversity, word rarity, connectives, a proxy of clause depth, and
length, fitted on the graded passages.  Word rarity comes from counts over all
documents: words are counted per task before anything is exchanged, and only
words above a fixed share of all words are known as common, which bounds what is
sent to the workers by one over that share.

Two regressions are fitted, with and without the features that need
punctuation; texts that have lost theirs are placed by the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.textvec import Slice, fold, new_rows, slices, span_hash, words
from cuewright.llm.lang import Filters, _asides, decide, sentences

#: Documents of fewer words, as blanks part them, have no level.
LEAST_WORDS = 100
#: Words with at least this share of all words of the corpus are known by their counts.
COMMON = 2e-5
#: A sentence of at least so many words in at least this share of the documents is a formula.
USUAL, USUAL_WORDS = 0.005, 12
#: Words that connect clauses, and words that open dependent ones.
CONNECTIVES = (
    "although because since unless whereas therefore consequently notwithstanding insofar albeit despite however moreover furthermore nevertheless "
    "thus hence accordingly whereupon thereby provided given while though until whether likewise otherwise meanwhile instead and but so or if when"
).split()
OPENERS = "which that whose whom who where whereupon whereby wherein whether if because although since unless while when what how why as than thereby such".split()
FEATURES = (
    "letters", "long", "very_long", "short", "diversity", "rarity", "rare", "connectives", "openers", "low_letters", "mid_letters", "high_letters",
    "sentence", "commas", "semicolons", "depth", "mid_sentence", "mid_sentence_letters", "short_sentences", "long_sentences",
    "mean_score", "mid_score", "mean_place",
)
#: Those that need no punctuation.
LEXICAL = tuple(range(12))
#: The last three say how hard single sentences are, by a regression over these features of sentences.
SENTENCE_FEATURES = ("letters", "long", "very_long", "short", "words", "commas", "connectives", "openers", "clauses", "long_words")
#: Words in a window, for features of the plainer and the harder parts of a text.
WINDOW = 12
#: A text with more words to an end mark than this has lost its punctuation.
LOST = 75


_CALL = re.compile(rb"\n[^\n:]{2,50}: [^\n]{0,60}[.!?](?=\n|$)")


def _calls(data: np.ndarray) -> np.ndarray:
    """Bytes of short lines under a label of their own: calls by others."""
    inside = np.zeros(len(data) + 1, np.int8)
    body = data.tobytes()
    if b": " in body:
        spans = np.array([m.span() for m in _CALL.finditer(body)], np.int64).reshape(-1, 2)
        inside[spans[:, 0]] += 1
        inside[spans[:, 1]] -= 1
    return np.cumsum(inside[:-1]) > 0


def _hashes(listed: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(listed).encode(), np.uint8)
    sizes = np.array([len(w) for w in listed])
    start = np.cumsum(sizes + 1) - sizes - 1
    return np.sort(span_hash(data, start, start + sizes))


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _sentence_ends(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Places of end marks; a word of one or two letters before one is an initial or a title, which ends nothing."""
    marks = np.flatnonzero(outside & np.isin(data, np.frombuffer(b".!?", np.uint8)))
    follows = np.append(data, 32)[marks + 1]
    return marks[(follows <= 32) & (data[np.maximum(marks - 2, 0)] > 32) & (data[np.maximum(marks - 3, 0)] > 32)]


def _sentence_keys(row: np.ndarray, sentence: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence: its first word, its words, and a key of them in order."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(row)))
    place = np.arange(len(row)) - np.repeat(at, n)
    with np.errstate(over="ignore"):
        mixed = hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        return at, n, np.add.reduceat(mixed, at) if len(at) else np.zeros(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task, all its long sentences by the text they are in, and its documents; kind 0 counts words, 1 sentences, 2 documents."""
    kept: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    documents = 0
    seen: set[int] = set()

    def merged() -> tuple[np.ndarray, np.ndarray]:
        if not kept:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(kept), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        kept[:], counts[:] = [keys], [n]
        return keys, n

    def rows(kind: int, keys: np.ndarray, texts: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(texts.view(np.int64)), pa.array(n)], names=["kind", "key", "text", "n"])

    def settled() -> Iterator[pa.RecordBatch]:
        keys, n = merged()
        yield rows(0, keys, np.zeros(len(keys), np.uint64), n)
        yield rows(2, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([documents]))
        kept.clear()
        counts.clear()

    for batch in batches:
        documents += batch.num_rows
        for part in slices(fold(batch.column(0))):
            found = words(part)
            ends = _sentence_ends(part.data, np.ones(len(part.data), bool))
            at, n, sentence = _sentence_keys(found.row, np.searchsorted(ends, found.start, "right"), found.hash)
            row = found.row[at]
            use = np.flatnonzero((n >= USUAL_WORDS) & new_rows(part, seen)[row])
            use = use[np.lexsort((sentence[use], row[use]))]
            first = np.ones(len(use), bool)
            first[1:] = (row[use][1:] != row[use][:-1]) | (sentence[use][1:] != sentence[use][:-1])
            one = np.flatnonzero(first)
            if len(one):
                texts = span_hash(part.data, part.offsets[:-1], part.offsets[1:])
                yield rows(1, sentence[use[one]], texts[row[use[one]]], np.diff(np.append(one, len(use))))
            keys, n_keys = np.unique(found.hash, return_counts=True)
            kept.append(keys)
            counts.append(n_keys)
        if len(seen) > 1 << 20:
            seen.clear()  # copies that are met again are told by their text later
        if sum(map(len, kept)) > 1 << 20 and len(merged()[0]) > 1 << 19:
            yield from settled()
            documents = 0
    yield from settled()


@dataclass
class Corpus:
    """What all documents say together: common words with their information in bits, and usual long sentences."""

    words: np.ndarray
    bits: np.ndarray
    usual: np.ndarray


def corpus_counts(documents: DataFrame, text: str = "text") -> Corpus:
    """Counts over all documents, of which only frequent keys leave the workers.

    Words with at least ``COMMON`` of all words: at most one over that share,
    whatever the size of the corpus.  Sentences of ``USUAL_WORDS`` words and more
    that are as frequent as ``USUAL`` of the documents (formulas), where texts
    that are there many times count once; their number is bounded too.  Counts
    don't depend on how documents lie in tasks.
    """
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("text", T.LongType()), T.StructField("n", T.LongType())])
    told = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, schema)
    # A text's sentences count as often as they are in one copy of it; those that are too few for any formula aren't kept.
    per_text = told.repartition("kind", "key").groupBy("kind", "key", "text").agg(F.sum("n").alias("all"), F.max("n").alias("one"))
    counted = per_text.groupBy("kind", "key").agg(F.sum(F.when(F.col("kind") == 1, F.col("one")).otherwise(F.col("all"))).alias("n")).where("kind <> 1 OR n >= 5")
    counted = counted.persist()
    try:
        totals = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        n_words, n_documents = totals.get(0) or 0, totals.get(2) or 0
        least = F.when(F.col("kind") == 0, n_words * COMMON).otherwise(max(5.0, n_documents * USUAL))
        rows = counted.where((F.col("kind") < 2) & (F.col("n") >= least)).collect()
    finally:
        counted.unpersist()
    keys = np.array([r["key"] for r in rows if r["kind"] == 0], np.int64).view(np.uint64)
    bits = -np.log2(np.array([r["n"] for r in rows if r["kind"] == 0], float) / max(n_words, 1))
    order = np.argsort(keys)
    return Corpus(keys[order], bits[order], np.sort(np.array([r["key"] for r in rows if r["kind"] == 1], np.int64).view(np.uint64)))


def _grouped(row: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of words with equal ``(row, group)``: its row, words, and letters to a word."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(row)))
    return row[at], n.astype(float), np.add.reduceat(size, at) / n


def _quantile(row: np.ndarray, value: np.ndarray, rows: int, q: float) -> np.ndarray:
    """The value at ``q`` of those of each row; 0 where there is none."""
    out = np.zeros(rows)
    if len(row):
        ordered = value[np.lexsort((value, row))]
        n = np.bincount(row, minlength=rows)
        has = n > 0
        out[has] = ordered[(np.cumsum(n) - n)[has] + np.floor(q * (n[has] - 1) + 0.5).astype(np.int64)]
    return out


class Measures:
    """Features of texts, vectorised over slices."""

    def __init__(self, corpus: Corpus) -> None:
        self.keys, self.bits, self.usual = corpus.words, corpus.bits, corpus.usual
        self.most = float(-np.log2(COMMON))
        self.connectives, self.openers = _hashes(CONNECTIVES), _hashes(OPENERS)

    def of(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of each row but for the last three, its words, features of each sentence, and the row of each."""
        data, rows = part.data, part.rows
        outside = ~(_asides(data) | _calls(data))
        found = words(part)
        written = data > 32
        opens = written.copy()
        opens[1:] &= ~written[:-1]
        opens[part.offsets[:-1][part.offsets[:-1] < len(data)]] = written[part.offsets[:-1][part.offsets[:-1] < len(data)]]
        all_words = np.bincount(np.searchsorted(part.offsets, np.flatnonzero(opens), "right") - 1, minlength=rows)
        use = (data[found.start] > 57) & outside[found.start]  # numbers tell nothing
        at_end = _sentence_ends(data, outside)
        sentence = np.searchsorted(at_end, found.start, "right")
        first, n_of, keys = _sentence_keys(found.row, sentence, found.hash)
        formula = (n_of >= USUAL_WORDS) & _isin(keys, self.usual)
        use &= ~np.repeat(formula, n_of)
        row, hashes, size = found.row[use], found.hash[use], (found.end - found.start)[use]
        n = np.maximum(np.bincount(row, minlength=rows), 1).astype(float)

        def rate(mask: np.ndarray) -> np.ndarray:
            return np.bincount(row, mask, minlength=rows) / n

        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0)) if len(self.keys) else np.zeros(len(hashes), np.int64)
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        bits = np.where(known, self.bits[at] if len(self.keys) else self.most, self.most)
        distinct = np.zeros(rows)
        if len(row):
            order = np.lexsort((hashes, row))
            new = np.ones(len(order), bool)
            new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
            distinct = np.bincount(row[order][new], minlength=rows).astype(float)
        marks = np.flatnonzero(outside & np.isin(data, np.frombuffer(b",;", np.uint8)))
        mark_row = np.searchsorted(part.offsets, marks, "right") - 1
        ends = np.bincount(np.searchsorted(part.offsets, at_end, "right") - 1, minlength=rows) - np.bincount(found.row[first[formula]], minlength=rows)
        commas = np.bincount(mark_row[data[marks] == 44], minlength=rows)
        semicolons = np.bincount(mark_row[data[marks] == 59], minlength=rows)
        opens, connects = _isin(hashes, self.openers), _isin(hashes, self.connectives)
        openers = rate(opens)
        per_sentence = n / np.maximum(ends, 1)
        # Quartiles over windows of words, and medians over sentences: a text may mix plain and hard parts.
        window = (np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]) // WINDOW
        own, w_size, w_letters = _grouped(row, window, size)
        low, mid, high = (_quantile(own, w_letters, rows, q) for q in (0.25, 0.5, 0.75))
        own, s_words, s_letters = _grouped(row, sentence[use], size)
        many = np.maximum(np.bincount(own, minlength=rows), 1)
        head = np.flatnonzero(np.diff(row * (len(at_end) + 1) + sentence[use], prepend=-1)) if len(row) else np.zeros(0, np.int64)
        in_sentence = np.bincount(np.maximum(np.searchsorted(found.start[use][head], marks[data[marks] == 44], "right") - 1, 0), minlength=max(len(head), 1))[: len(head)]

        def part_of(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask.astype(float), head) / s_words if len(head) else np.zeros(0)

        long_words = part_of(size >= 8)
        by_sentence = np.stack(
            [s_letters, long_words, part_of(size >= 12), part_of(size <= 3), np.log(np.maximum(s_words, 1)), in_sentence / np.maximum(s_words, 1), part_of(connects), part_of(opens), in_sentence, np.sqrt(long_words * s_words)],
            axis=1,
        )
        features = np.stack(
            [
                rate(size),
                rate(size >= 8),
                rate(size >= 12),
                rate(size <= 3),
                distinct / np.sqrt(2 * n),
                rate(bits),
                rate(bits > 14),
                rate(connects),
                openers,
                low,
                mid,
                high,
                np.log(per_sentence),
                commas / n,
                semicolons / n,
                np.log1p((openers * n + commas + semicolons) / np.maximum(ends, 1)),
                np.log1p(_quantile(own, s_words, rows, 0.5)),
                _quantile(own, s_letters, rows, 0.5),
                np.bincount(own, s_words <= 12, minlength=rows) / many,
                np.bincount(own, s_words >= 24, minlength=rows) / many,
            ],
            axis=1,
        )
        return features, all_words, by_sentence, own


@dataclass
class Ordinal:
    """Proportional odds: a slope for each feature, and thresholds between the levels."""

    use: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    slope: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, use: tuple[int, ...], ridge: float = 0.05, steps: int = 100) -> Ordinal:
        """Most likely slopes and thresholds, by Newton's method; the likelihood is concave, so steps that don't raise it are halved."""
        levels, rank = np.unique(y, return_inverse=True)
        mean, scale = x[:, use].mean(axis=0), x[:, use].std(axis=0) + 1e-9
        z = np.clip((x[:, use] - mean) / scale, -3, 3)
        k, d, n = len(levels) - 1, len(use), len(z)
        # How the upper and the lower end of each row's level depend on slopes and thresholds.
        places = np.pad(np.eye(k), ((1, 1), (0, 0)))
        upper, lower = np.hstack([-z, places[1:][rank]]), np.hstack([-z, places[:-1][rank]])
        penalty = np.append(np.full(d, ridge), np.full(k, 1e-9))

        def odds(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
            a, b = (1 / (1 + np.exp(-np.clip(side @ at, -40, 40))) for side in (upper, lower))
            a, b = np.where(rank == k, 1.0, a), np.where(rank == 0, 0.0, b)
            p = np.maximum(a - b, 1e-12)
            return float((penalty * at**2).sum() / 2 - np.log(p).mean()), a, b, p

        at = np.append(np.zeros(d), np.linspace(-1.5, 1.5, k))
        loss, a, b, p = odds(at)
        for _ in range(steps if k else 0):
            da, db = a * (1 - a) / p, b * (1 - b) / p
            gradient = penalty * at - (da @ upper - db @ lower) / n
            haa, hbb, hab = da**2 - da * (1 - 2 * a), db**2 + db * (1 - 2 * b), -da * db
            cross = upper.T @ (hab[:, None] * lower)
            curve = (upper.T @ (haa[:, None] * upper) + lower.T @ (hbb[:, None] * lower) + cross + cross.T) / n + np.diag(penalty)
            step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
            size = 1.0
            while size > 1e-6 and not (new := odds(at - size * step))[0] < loss:
                size /= 2
            if size <= 1e-6 or loss - new[0] < 1e-12:
                break
            at, (loss, a, b, p) = at - size * step, new
        return cls(use, mean, scale, at[:d], np.sort(at[d:]), levels)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x[:, self.use] - self.mean) / self.scale, -3, 3) @ self.slope

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.cuts, self.score(x))]


@dataclass
class Model:
    measures: Measures
    sentence: Ordinal
    full: Ordinal | None = None
    lexical: Ordinal | None = None

    def features(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All features of each row, and its words."""
        features, n_words, by_sentence, row = self.measures.of(part)
        score, placed = self.sentence.score(by_sentence), self.sentence.place(by_sentence)
        n = np.maximum(np.bincount(row, minlength=part.rows), 1)
        own = [np.bincount(row, score, minlength=part.rows) / n, _quantile(row, score, part.rows, 0.5), np.bincount(row, placed, minlength=part.rows) / n]
        return np.column_stack([features, *own]), n_words

    def levels(self, features: np.ndarray) -> np.ndarray:
        lost = features[:, FEATURES.index("sentence")] > np.log(LOST)
        return np.where(lost, self.lexical.place(features), self.full.place(features))


def fit_texts(texts: list[str], levels: list[int], corpus: Corpus) -> Model:
    """Fit on graded texts: sentences first, each with the level of its text, then whole texts."""
    measures = Measures(corpus)
    y = np.array(levels)
    parts = list(slices(fold(pa.array(texts, pa.string()))))
    found = [measures.of(p) for p in parts]
    rows = np.concatenate([p.first + f[3] for p, f in zip(parts, found)])
    model = Model(measures, Ordinal.fit(np.concatenate([f[2] for f in found]), y[rows], tuple(range(len(SENTENCE_FEATURES))), ridge=0.01))
    x = np.concatenate([model.features(p)[0] for p in parts])
    model.full = Ordinal.fit(x, y, tuple(range(len(FEATURES))), ridge=0.1)
    model.lexical = Ordinal.fit(x, y, LEXICAL, ridge=0.1)
    return model


#: Graded passages are few; more than this are not fitted on.
MAX_PASSAGES = 20_000


def fit(passages: DataFrame, documents: DataFrame, text: str = "text", level: str = "reading_level") -> Model | None:
    """Fit on at most ``MAX_PASSAGES`` graded passages, and word counts of all documents; None without any passage."""
    rows = passages.select(F.col(text).alias("text"), F.col(level).alias("level")).where("text IS NOT NULL AND level IS NOT NULL").orderBy(F.xxhash64("text"), "text", "level").limit(MAX_PASSAGES).collect()
    if not rows:
        return None
    return fit_texts([r["text"] for r in rows], [r["level"] for r in rows], corpus_counts(documents))


def _levels(batches: Iterator[pa.RecordBatch], model: Model, filters: Filters, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(fold(batch.column(1))):
            features, n_words = model.features(part)
            cuts = sentences(part)
            n, shares = filters.shares(part.data, cuts)
            own = decide(n, shares)[0]
            row = np.searchsorted(part.offsets, cuts, "right") - 1
            counts = np.zeros((part.rows, shares.shape[1]), np.int64)
            weight = np.zeros((part.rows, shares.shape[1]))
            known = own >= 0
            np.add.at(counts, (row[known], own[known]), 1)
            np.add.at(weight, (row[known], own[known]), n[known])
            english = (weight.argmax(axis=1) == 0) & (weight[:, 0] > 0.3 * np.bincount(row, n, minlength=part.rows))
            use = np.flatnonzero(english & (counts[:, 1:].max(axis=1) < 3) & (n_words >= LEAST_WORDS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part.first + use)), pa.array(model.levels(features[use]).astype(np.int32))], names=names)


def reading_levels(documents: DataFrame, model: Model | None, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, reading_level`` of each English document of at least 100 words that isn't mixed.

    Text in brackets (interruptions, notes) doesn't count for the level.  Null,
    empty and short texts, and those in other or several languages, have no row;
    a null key stays null; repeated rows repeat; an empty table gives an empty
    result, and so does a model fitted on nothing; further columns aren't read.
    Narrow: no shuffle.
    """
    schema = T.StructType([T.StructField("key", documents.schema[key].dataType), T.StructField("reading_level", T.IntegerType())])
    if model is None:
        return documents.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    shared = documents.sparkSession.sparkContext.broadcast((model, filters))
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _levels(it, *shared.value, schema.fieldNames()), schema).withColumnRenamed("key", key)
