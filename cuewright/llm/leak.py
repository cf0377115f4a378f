"""Evaluation passages that leak into a corpus.

Method: seed and extend.  Hashes of ``seed_words`` consecutive words of the test
items are looked up in every document; those that are common in the corpus
(procedural formulas, turns of phrase) count for little, and the words at the
head of an item that only common ones cover, in many surroundings, are its
formula.  Documents that share some rare seeds with an item, or more of its
seeds of any kind, are aligned with it, word by word, by a Smith-Waterman
recurrence that may also jump: from any earlier end of a stretch
to any later beginning, for a fixed price, so that a passage broken into several
stretches is scored as a whole.  Alignments stay near the seeds of their item, so
neither a book nor a long item makes a full table of cells.  The corpus is
scanned twice; what is exchanged are the items' own seeds in each text, so that
copies of a text, wherever they lie, count once.  What is a turn of phrase is
decided over all items.  Nothing depends on how rows lie in tasks or items in
blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.textvec import Slice, Words, fold, new_rows, ngrams, ragged, slices, span_hash, words

#: Words in a seed.
SEED_WORDS = 3
#: A seed in more than this share of the documents (and in more than ``COMMON_LEAST``) is common.
COMMON_SHARE, COMMON_LEAST = 0.004, 12
#: A seed in more than this share of the items (and in more than two) is a turn of phrase.
COMMON_ITEMS = 0.01
#: Share of an item's words that a document must hold, in order.
COVERED = 0.4
#: Share of an item's rare seeds that a document must hold to be aligned with it.
CANDIDATE = 0.1
#: Share of all its seeds, common and shared ones too, that will do as well: copies of a leak make its own seeds common.
CANDIDATE_ANY = 0.15
#: A first sentence is a formula in no fewer surroundings than these (the inverse of the chance that two are the same).
SURROUNDINGS = 8
#: Places that the surroundings of a first sentence are hashed to.
PLACES = 64
#: Words of items that one scan of the corpus is held against; more items take more scans.
BLOCK_WORDS = 200_000
#: Texts that a task remembers, so that most copies needn't be exchanged to be told.
KEPT_TEXTS = 1_000_000
#: Words of an item that are aligned at a time, and how far from a seed of theirs they are looked for.
TILE, REACH = 512, 1024
#: Price of a jump between stretches, in matches; a stretch of no more words doesn't count.
JUMP = 6
#: A match, another word, a word too many or too few: what agrees in less than two words of three is no stretch.
_MATCH, _MISS, _GAP = 2, 4, 3


class Items:
    """Words of a block of test items and their seeds, for binary search."""

    def __init__(self, ids: list, texts: list[str], n: int) -> None:
        self.ids, self.n = ids, n
        self.words: list[np.ndarray] = []
        self.first_sentence: list[int] = []
        seeds, owner = [], []
        column = fold(pa.array(texts, pa.string()))
        for part in slices(column):
            found = words(part)
            cuts = np.searchsorted(found.row, np.arange(part.rows + 1))
            for k in range(part.rows):
                own = found.hash[cuts[k] : cuts[k + 1]]
                self.words.append(own)
                body = part.data[part.offsets[k] : part.offsets[k + 1]].tobytes()
                stop = re.search(rb"[.!?](?=\s|$)", body)
                end = part.offsets[k] + (stop.start() if stop else len(body))
                self.first_sentence.append(int(np.searchsorted(found.start[cuts[k] : cuts[k + 1]], end)))
                grams, _ = ngrams(own, np.zeros(len(own), np.int64), n)
                seeds.append(grams)
                owner.append(np.full(len(grams), part.first + k))
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.seeds, self.seed_of = np.unique(flat, return_inverse=True)
        self.owner = np.concatenate(owner).astype(np.int64) if owner else np.zeros(0, np.int64)
        #: Last seeds of first sentences that something of the item follows, sorted, with their items.
        ends = [(int(seed), k, head) for k, (grams, head) in enumerate(zip(np.split(self.seed_of, np.cumsum([len(g) for g in seeds])[:-1]) if seeds else [], self.first_sentence)) if n <= head < len(self.words[k]) for seed in grams[head - n : head - n + 1]]
        self.end_seed, self.end_item, self.end_head = (np.array(x, np.int64) for x in zip(*sorted(ends))) if ends else (np.zeros(0, np.int64),) * 3
        #: Items of each seed: ``by_seed[first[s]:first[s + 1]]``.
        self.order = np.argsort(self.seed_of, kind="stable")
        self.by_seed, self.first = self.owner[self.order], np.searchsorted(self.seed_of[self.order], np.arange(len(self.seeds) + 1))

    def look_for(self, wanted: np.ndarray) -> None:
        """Look for these seeds only; a bitmap of at least 32 places to a seed answers for nearly all of a corpus."""
        self.wanted = wanted
        bits = max(20, int(len(self.seeds) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.seeds[wanted] >> self.shift).astype(np.int64)] = True

    def settle(self, counts: np.ndarray, documents: int, around: np.ndarray, phrases: np.ndarray) -> None:
        """Decide which seeds find which items, and cut off the formula that opens an item.

        A first sentence is a formula if all its seeds are common in the corpus,
        clearly more so than the rest of the item and than its own way on from
        there, and what stands ``around`` it elsewhere (counts by item and place)
        varies: where it doesn't, copies of one text made it common.  A sentence
        that is the whole item opens nothing, so it is none.  Seeds that
        several items share are turns of phrase.  A few of either find no item;
        but an item of which most seeds are common is itself copied all over the
        corpus, and one of which nearly all are shared is there many times, so
        those find it all the same.
        """
        common = counts > max(COMMON_LEAST, COMMON_SHARE * documents)
        shared = np.isin(self.seeds, phrases)
        place = np.searchsorted(self.owner, np.arange(len(self.words) + 1))
        self.rare_of_item = np.zeros(len(self.words), np.int64)
        finds, holds, skipped = np.zeros(len(self.owner), bool), np.zeros(len(self.owner), bool), np.zeros(len(self.words), np.int64)
        self.seeds_of_item = np.zeros(len(self.words), np.int64)
        for k in range(len(self.words)):
            span = slice(place[k], place[k + 1])
            own, head = self.seed_of[span], self.first_sentence[k]
            first, rest = own[: max(head - self.n + 1, 0)], own[head:]
            varied = around[k].sum() ** 2 >= SURROUNDINGS * (around[k] ** 2).sum()
            if len(first) and len(rest) and common[first].all() and varied and np.median(counts[first]) >= 1.5 * max(np.median(counts[rest]), np.median(counts[own[head - self.n + 1 : head]])):
                self.words[k] = self.words[k][head:]
                skip = skipped[k] = head
            else:
                skip, rest = 0, own
            good = np.ones(len(rest), bool)
            if len(rest) and common[rest].mean() <= 0.5:
                good &= ~common[rest]
            if len(rest) and shared[rest].mean() <= 0.8:
                good &= ~shared[rest]
            finds[span.start + skip : span.stop] = good
            holds[span.start + skip : span.stop] = True
            self.rare_of_item[k] = len(np.unique(rest[good]))
            self.seeds_of_item[k] = len(np.unique(rest))
        self.finds, self.holds = finds[self.order], holds[self.order]
        self.at = self.order - (place[:-1] + skipped)[self.by_seed]  # the place of each seed in its item, without what was cut off
        wanted = np.zeros(len(self.seeds), bool)
        wanted[self.seed_of[holds]] = True
        self.look_for(wanted)


def _hits(part: Slice, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Of the words of a slice: which begin a seed, which seed, in which row."""
    found = words(part)
    grams, whole = ngrams(found.hash, found.row, items.n)
    if not len(grams) or not len(items.seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), found
    maybe = np.flatnonzero(items.filter[(grams >> items.shift).astype(np.int64)] & whole)
    place = np.minimum(np.searchsorted(items.seeds, grams[maybe]), len(items.seeds) - 1)
    sure = items.seeds[place] == grams[maybe]
    at, seed = maybe[sure], place[sure]
    wanted = items.wanted[seed]
    at, seed = at[wanted], seed[wanted]
    return at, seed, found.row[at], found


def matched_words(item: np.ndarray, text: np.ndarray, item_at: np.ndarray | None = None, text_at: np.ndarray | None = None) -> int:
    """Most words of ``item`` found in ``text``, in order, in stretches that are worth their price.

    Score and matches share a number (score times a unit beyond any number of
    matches, plus matches), so the best score, and of those with it the most
    matches, falls out of maxima.  ``item_at`` and ``text_at`` are places of the
    seeds that both share: each tile of ``TILE`` words of the item is aligned
    with words of the text that are near a seed of that tile or of its
    neighbours; without them, with the whole text.
    """
    unit, m = len(item) + 1, len(text)
    reach = min(REACH, len(item))
    above = np.zeros(m + 1, np.int64)  # the row before; zero where it wasn't computed
    best = np.zeros(m + 1, np.int64)  # best of all earlier rows, up to each column
    for low in range(0, len(item), TILE):
        columns = np.arange(m)
        if text_at is not None:
            own = text_at[(item_at >= low - TILE) & (item_at < low + 2 * TILE)]
            near = np.zeros(m + 1, np.int64)
            np.add.at(near, np.maximum(own - reach, 0), 1)
            np.add.at(near, np.minimum(own + reach, m), -1)
            columns = np.flatnonzero(np.cumsum(near[:-1]))
        if not len(columns):
            above[:] = 0
            continue
        # Before each stretch of columns stands the place it begins at: nothing matches there.
        opens = np.flatnonzero(np.diff(columns, prepend=-2) > 1)
        at = np.insert(columns + 1, opens, columns[opens])
        wall = opens + np.arange(len(opens))
        here = text[at - 1]
        score, upto = above[at], best[at]
        ramp = at * (_GAP * unit)  # skipped columns cost what they would cost
        for word in item[low : low + TILE]:
            start = np.maximum(np.maximum(score[:-1], upto[:-1] - JUMP * _MATCH * unit), 0)
            down = np.empty(len(at), np.int64)
            down[1:] = np.where(here[1:] == word, start + _MATCH * unit + 1, score[:-1] - _MISS * unit)
            down[wall] = 0
            np.maximum(down, score - _GAP * unit, out=down)
            down[down < unit] = 0
            score = np.maximum.accumulate(down + ramp) - ramp
            score[score < unit] = 0  # without a score there are no matches either
            upto = np.maximum(upto, np.maximum.accumulate(score))
        above[:] = 0
        above[at] = score
        best[at] = upto
        best = np.maximum.accumulate(best)
    return int(best[-1] % unit)


def _surroundings(at: np.ndarray, seed: np.ndarray, found: Words, items: Items) -> np.ndarray:
    """Of each first sentence: its row, and where in a table of items and places it goes by the words before and after it.

    One that goes on as the item does is the item's, and one that is the whole document says nothing.
    """
    first = np.searchsorted(items.end_seed, seed)
    many = np.searchsorted(items.end_seed, seed, "right") - first
    entry, at = ragged(first, many), np.repeat(at, many)
    item, end, last = items.end_item[entry], at + items.n, len(found.hash) - 1
    mixed, some = np.zeros(len(at), np.uint64), np.zeros(len(at), bool)
    for step in range(items.n):
        for place in (end + step, end - items.end_head[entry] - 1 - step):
            inside = (place >= 0) & (place <= last)
            inside &= found.row[np.clip(place, 0, last)] == found.row[at]
            word = np.where(inside, found.hash[np.clip(place, 0, last)], np.uint64(0))
            mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            some |= inside
    following = np.clip(end, 0, last)
    own = np.array([items.words[k][h] for k, h in zip(item.tolist(), items.end_head[entry].tolist())], np.uint64)
    same = (found.hash[following] == own) & (found.row[following] == found.row[at]) & (end <= last)
    return np.stack([found.row[at], item * PLACES + (mixed >> np.uint64(58)).astype(np.int64)], axis=1)[some & ~same]


def _count(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """Of each text with seeds, once per task: its hash, and its seeds and surroundings as 32-bit numbers; and how many documents there are."""
    many = len(items.seeds)
    seen: set[int] = set()
    for batch in batches:
        if len(seen) > KEPT_TEXTS:
            seen.clear()
        hashes, bodies = [np.zeros(1, np.uint64)], [b""]
        for part in slices(fold(batch.column(0))):
            fresh = new_rows(part, seen)
            at, seed, row, found = _hits(part, items)
            at, seed, row = at[fresh[row]], seed[fresh[row]], row[fresh[row]]
            if not len(seed):
                continue
            pairs = np.unique(row * many + seed)
            around = _surroundings(at, seed, found, items)
            rows = np.concatenate([pairs // many, around[:, 0]])
            told = np.concatenate([pairs % many, many + around[:, 1]])
            order = np.argsort(rows, kind="stable")
            own, first = np.unique(rows[order], return_index=True)
            texts = span_hash(part.data, part.offsets[:-1], part.offsets[1:])
            hashes.append(texts[own])
            cuts = np.append(first, len(rows)) * 4
            body = told[order].astype("<i4").tobytes()
            bodies += [body[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        n = np.zeros(len(bodies), np.int64)
        n[0] = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(n), pa.array(bodies, pa.binary())], names=["hash", "n", "body"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of seeds and surroundings over texts, each once, ordered by hash; -1 counts the documents."""
    counts, documents, before = np.zeros(0, np.int64), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column(1).to_numpy()
        documents += int(n.sum())
        texts = batch.filter(pa.array(n == 0))
        hashes = texts.column(0).to_numpy()
        if not len(hashes):
            continue
        new = np.diff(hashes, prepend=hashes[0]) != 0
        new[0] = hashes[0] != before
        before = hashes[-1]
        told = np.frombuffer(b"".join(texts.column(2).filter(pa.array(new)).to_pylist()), "<i4")
        more = np.bincount(told, minlength=len(counts))
        more[: len(counts)] += counts
        counts = more
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], documents))], names=["seed", "n"])


def _align(batches: Iterator[pa.RecordBatch], items: Items, ids: pa.Array, share: float) -> Iterator[pa.RecordBatch]:
    many = len(items.words)
    for batch in batches:
        out_row, out_item, out_share = [], [], []
        for part in slices(fold(batch.column(1))):
            at, seed, row, found = _hits(part, items)
            if not len(at):
                continue
            n_items = items.first[seed + 1] - items.first[seed]
            entry = ragged(items.first[seed], n_items)
            pair, at = np.repeat(row, n_items) * many + items.by_seed[entry], np.repeat(at, n_items)
            keys = pair * len(items.seeds) + np.repeat(seed, n_items)
            near = []
            for use, least, of_item in ((items.finds, CANDIDATE, items.rare_of_item), (items.holds, CANDIDATE_ANY, items.seeds_of_item)):
                both, hits = np.unique(np.unique(keys[use[entry]]) // len(items.seeds), return_counts=True)
                near.append(both[hits >= np.maximum(2, least * of_item[both % many])])
            near = np.union1d(*near)
            cuts = np.searchsorted(found.row, np.arange(part.rows + 1))
            own = np.flatnonzero(items.holds[entry] & np.isin(pair, near))
            own = own[np.argsort(pair[own], kind="stable")]
            for p, low, high in zip(near.tolist(), np.searchsorted(pair[own], near).tolist(), np.searchsorted(pair[own], near, "right").tolist()):
                r, k = divmod(p, many)
                item, places = items.words[k], own[low:high]
                covered = matched_words(item, found.hash[cuts[r] : cuts[r + 1]], items.at[entry[places]], at[places] - cuts[r]) / len(item)
                if covered >= share:
                    out_row.append(part.first + r)
                    out_item.append(k)
                    out_share.append(covered)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out_row, pa.int64())), ids.take(pa.array(out_item, pa.int64())), pa.array(out_share, pa.float64())], names=["key", "item", "covered"])


def _item_seeds(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Distinct seeds of each item."""
    for batch in batches:
        for part in slices(fold(batch.column(0))):
            found = words(part)
            grams, whole = ngrams(found.hash, found.row, n)
            row = found.row[: len(grams)]
            keys = np.unique(np.stack([row[whole].astype(np.uint64), grams[whole]]), axis=1)[1] if whole.any() else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["seed"])


def phrases(texts: DataFrame, seed_words: int = SEED_WORDS) -> np.ndarray:
    """Hashes of the seeds that more than ``COMMON_ITEMS`` of the items share (and more than two), over all items.

    There are no more of them than the mean number of words of an item over that
    share, so they go to the driver.
    """
    least = max(2.0, COMMON_ITEMS * texts.count())
    seeds = texts.mapInArrow(lambda it: _item_seeds(it, seed_words), T.StructType([T.StructField("seed", T.LongType())]))
    found = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("seed").collect()
    return np.sort(np.array([r["seed"] for r in found], np.int64).view(np.uint64))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = COVERED, seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that hold at least ``share`` of a test item's words, in order, in long stretches.

    Columns: ``key, item_key, covered`` (the share), one row per pair; a
    document that is there twice gives two rows.  A formula at the head of an
    item that is common in the corpus doesn't count.  Null and empty texts, and
    items with fewer words than a seed, leak nothing; a null key stays null;
    empty tables give an empty result; further columns, whatever their names,
    aren't read.

    The items are the stated query set: they are held against the whole corpus
    in blocks of ``block_words`` words, so what is shipped to a worker is bounded
    whatever their number.  Rows don't depend on it, nor on how documents lie in
    partitions: texts are told apart by 64-bit hashes where copies count once.
    """
    doc_type, item_type = documents.schema[key].dataType, items.schema[item_key].dataType
    spark = documents.sparkSession
    texts = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    questions = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL AND item IS NOT NULL")
    shared = phrases(questions.select("text"), seed_words)
    results: list[DataFrame] = []
    pending: list = []
    size = 0

    def flush() -> None:
        nonlocal pending, size
        if not pending:
            return
        block = Items([r[0] for r in pending], [r[1] for r in pending], seed_words)
        block.look_for(np.ones(len(block.seeds), bool))
        sent = spark.sparkContext.broadcast(block)
        told = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("body", T.BinaryType())])
        schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("n", T.LongType())])
        once = texts.select("text").mapInArrow(lambda it: _count(it, sent.value), told).repartition("hash").sortWithinPartitions("hash")
        counted = once.mapInArrow(_sums, schema).groupBy("seed").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(block.seeds) + len(block.words) * PLACES, np.int64)
        total = 0
        for r in counted:
            if r["seed"] < 0:
                total = r["n"]
            else:
                counts[r["seed"]] = r["n"]
        block.settle(counts[: len(block.seeds)], total, counts[len(block.seeds) :].reshape(-1, PLACES), shared)
        rare = spark.sparkContext.broadcast(block)
        ids = pa.array(block.ids, _arrow_type(item_type))
        out = T.StructType([T.StructField("key", doc_type), T.StructField("item", item_type), T.StructField("covered", T.DoubleType())])
        results.append(texts.mapInArrow(lambda it: _align(it, rare.value, ids, share), out))
        pending, size = [], 0

    for row in questions.toLocalIterator():
        pending.append(row)
        size += row["text"].count(" ") + 1
        if size >= block_words:
            flush()
    flush()
    if not results:
        out = T.StructType([T.StructField("key", doc_type), T.StructField("item", item_type), T.StructField("covered", T.DoubleType())])
        results.append(spark.createDataFrame([], out))
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found.select(F.col("key").alias(key), F.col("item").alias(item_key), "covered")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
