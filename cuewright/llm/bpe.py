"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Method: speculate and verify.  A text is cut into pre-tokens with vectorised
class boundaries, distinct pre-tokens are encoded once per worker, and for the
new ones

1. greedy longest match proposes tokens for all of them at the same time;
2. every adjacent pair of proposed tokens is tested, again for all at the same
   time, for whether merging could have crossed the border between them;
3. only pre-tokens with a failing pair are merged exactly, rank by rank; of a
   long one only the surroundings of that pair, until their borders hold.

Step 2 is exact, not a heuristic: token ids are merge ranks, every token of the
vocabulary is what its own bytes merge to (checked when the vocabulary is
loaded), so a sequence is the result of merging if and only if no border
between neighbours would ever have been crossed.  That is also why a long
pre-token (a line of marks, a gene sequence) can be mended piece by piece.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.textvec import Slice, mix, ragged, slices

#: Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Distinct pre-tokens kept by a worker; beyond it the memory is emptied and filled anew.
KEPT_WORDS = 400_000
#: Pre-tokens of more bytes are long: their longest matches come from a table of all positions.
LONG_WORD = 64
#: Positions of such a table.
TABLE = 1 << 18
#: Tokens on either side of a failing pair that are merged anew at first.
AROUND = 4

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_NONE = np.int32(-1)


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Where the installed public tokenizers keep the ranks of ``name``."""
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


def _classes() -> np.ndarray:
    """The class of every code point, as the pre-tokenizer's pattern tells them apart."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for low in range(0, 0x110000, 0x10000):
        if low in (0xF0000, 0x100000) or 0x40000 <= low < 0xE0000:
            continue  # private use and unassigned planes
        table[low : low + 0x10000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(low, low + 0x10000)]
    table[WHITE_SPACE] = SPACE
    return table


class Vocabulary:
    """Ranks of a byte-level BPE, with what the vectorised steps need: hashes, halves and pairs."""

    def __init__(self, path: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        size = max(self.tokens) + 1
        self.left = np.full(size, _NONE)
        self.right = np.full(size, _NONE)
        pairs: dict[tuple[int, int], int] = {}
        irregular = []
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                continue
            halves = self.merge(token, below=rank)
            if len(halves) == 2:
                self.left[rank], self.right[rank] = halves
                pairs[halves[0], halves[1]] = rank
            else:
                irregular.append(rank)
        #: Tokens that merging never makes; the longest match must not propose them.
        self.irregular = set(irregular)
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.base = [self.ranks[bytes([b])] for b in range(256)]
        self.sizes = np.zeros(size, np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self._hash_tokens()
        self.classes = _classes()

    def merge(self, word: bytes, below: int = 1 << 30) -> list[int]:
        """Exact merging: the lowest rank first, from the left, as long as it is lower than ``below``.

        Pairs wait in a heap by rank and place and parts are linked, so a word of
        n bytes takes n log n steps.
        """
        ranks, n = self.ranks, len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n))  # where the part that begins here ends, where the one before begins
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2], below)) < below]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = stop[i]
            if middle <= i or middle >= end or stop[middle] != end:
                continue  # one of the two has been merged since
            stop[i], stop[middle] = end, 0
            if end < n:
                before[end] = i
                if (rank := ranks.get(word[i : stop[end]], below)) < below:
                    heappush(heap, (rank, i, stop[end]))
            if i and (rank := ranks.get(word[before[i] : end], below)) < below:
                heappush(heap, (rank, before[i], end))
        parts, i = [], 0
        while i < n:
            parts.append(ranks[word[i : stop[i]]])
            i = stop[i]
        return parts

    def _hash_tokens(self) -> None:
        """Token hashes by length, sorted for binary search; single bytes need none."""
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        for token, rank in self.ranks.items():
            if len(token) > 1 and rank not in self.irregular:
                by_length.setdefault(len(token), []).append((token, rank))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, items in by_length.items():
            hashes = _hash_rows(np.frombuffer(b"".join(t for t, _ in items), np.uint8).reshape(-1, length))
            order = np.argsort(hashes)
            self.by_length[length] = (hashes[order], np.array([r for _, r in items], np.int64)[order])
        self.longest = max(self.by_length, default=1)
        #: Hashes of all beginnings of tokens by length: what isn't one needn't be followed any further.
        begun: dict[int, set[bytes]] = {}
        for items in by_length.values():
            for token, _ in items:
                for k in range(2, len(token)):
                    begun.setdefault(k, set()).add(token[:k])
        self.begun = {k: np.sort(_hash_rows(np.frombuffer(b"".join(heads), np.uint8).reshape(-1, k))) for k, heads in begun.items()}

    def matches(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from each place on that ends before ``stop``: which, and its length."""
        size = np.minimum(stop - at, self.longest)
        found, length = np.array(self.base, np.int64)[data[at]], np.ones(len(at), np.int64)
        hashes = np.zeros(len(at), np.uint64)
        alive = np.arange(len(at))
        for k in range(1, int(size.max(initial=0)) + 1):
            alive = alive[size[alive] >= k]
            with np.errstate(over="ignore"):
                hashes[alive] = hashes[alive] * np.uint64(1099511628211) + data[at[alive] + k - 1].astype(np.uint64) + np.uint64(1)
            if k == 1:
                continue
            value = mix(hashes[alive])
            if (table := self.by_length.get(k)) is not None:
                place = np.minimum(np.searchsorted(table[0], value), len(table[0]) - 1)
                hit = table[0][place] == value
                found[alive[hit]], length[alive[hit]] = table[1][place[hit]], k
            if (begun := self.begun.get(k)) is None:
                break
            alive = alive[begun[np.minimum(np.searchsorted(begun, value), len(begun) - 1)] == value]
            if not len(alive):
                break
        return found, length

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens in order of (word, position), and counts."""
        long = end - start > LONG_WORD
        word = np.flatnonzero(~long)
        at = start[word]
        out_word, out_at, out_token = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            found, length = self.matches(data, at, end[word])
            out_word.append(word)
            out_at.append(at)
            out_token.append(found)
            at = at + length
            left = at < end[word]
            at, word = at[left], word[left]
        for w in np.flatnonzero(long).tolist():
            places, tokens = self._propose_long(data, int(start[w]), int(end[w]))
            out_word.append(np.full(len(places), w))
            out_at.append(places)
            out_token.append(tokens)
        words, places, tokens = (np.concatenate(x) for x in (out_word, out_at, out_token))
        order = np.lexsort((places, words))
        return tokens[order], np.bincount(words, minlength=len(start))

    def _propose_long(self, data: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of one long word, from the longest matches at all of its positions."""
        places, tokens, at = [], [], start
        while at < end:
            here = np.arange(at, min(at + TABLE, end))
            found, length = self.matches(data, here, np.full(len(here), end))
            steps, own, k = length.tolist(), [], 0
            while k < len(steps):
                own.append(k)
                k += steps[k]
            places.append(at + np.array(own))
            tokens.append(found[own])
            at += k
        return np.concatenate(places), np.concatenate(tokens)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses the border of ``a[i]`` and ``b[i]``.

        Walk down the right spine of ``a`` and the left spine of ``b`` at once,
        undoing the later of both merges each time.  A pair that meets at the
        border crosses it if its rank comes before the merge that takes away
        the left symbol, or not after the one that takes away the right symbol
        (of equal ranks the left one merges first).
        """
        good = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        taken_x = np.full(len(a), 1 << 40)  # rank of the merge that takes x, and y
        taken_y = np.full(len(a), 1 << 40)
        todo = np.arange(len(a))
        while len(todo):
            keys = (x[todo].astype(np.uint64) << np.uint64(32)) | y[todo].astype(np.uint64)
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[place] == keys, self.pair_ranks[place], 1 << 41)
            crosses = (rank < taken_x[todo]) & (rank <= taken_y[todo])
            good[todo[crosses]] = False
            todo = todo[~crosses]
            can_x, can_y = self.left[x[todo]] >= 0, self.left[y[todo]] >= 0
            go = can_x | can_y
            todo, can_x, can_y = todo[go], can_x[go], can_y[go]
            on_x = can_x & (~can_y | (x[todo] > y[todo]))
            down_x, down_y = todo[on_x], todo[~on_x]
            taken_x[down_x] = x[down_x]
            x[down_x] = self.right[x[down_x]]
            taken_y[down_y] = y[down_y]
            y[down_y] = self.left[y[down_y]]
        return good

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words one after the other, their counts, and how many words needed exact merging."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        sizes = np.array([len(w) for w in words])
        end = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        tokens, counts = self.propose(data, end - sizes, end)
        word = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(word[1:] == word[:-1])
        bad = np.unique(word[inner[~self.compatible(tokens[inner], tokens[inner + 1])]])
        if len(bad):
            parts = np.split(tokens, np.cumsum(counts)[:-1])
            for i in bad:
                parts[i] = np.array(self.merge(words[i]), np.int64) if len(words[i]) <= LONG_WORD else self._mend(words[i], parts[i])
                counts[i] = len(parts[i])
            tokens = np.concatenate(parts)
        return tokens, counts, len(bad)


    def _mend(self, word: bytes, tokens: np.ndarray) -> np.ndarray:
        """Exact tokens of a long word out of proposed ones.

        The tokens around failing pairs are merged anew as words of their own;
        what comes out is joined to the rest and tested again.  Surroundings of a
        pair that still fails are four times as wide the next time, so in the
        end they are the whole word.
        """
        around, merged = AROUND, {}
        while len(bad := np.flatnonzero(~self.compatible(tokens[:-1], tokens[1:]))):
            ends = np.cumsum(self.sizes[tokens])
            low, high = np.maximum(bad - around + 1, 0), np.minimum(bad + around + 1, len(tokens))
            apart = np.append(True, low[1:] > high[:-1])
            low, high = low[apart], high[np.append(apart[1:], True)]
            parts, at = [], 0
            for a, b in zip(low.tolist(), high.tolist()):
                piece = word[int(ends[a - 1]) if a else 0 : int(ends[b - 1])]
                if piece not in merged:
                    merged[piece] = np.array(self.merge(piece), np.int64)
                parts += [tokens[at:a], merged[piece]]
                at = b
            tokens = np.concatenate([*parts, tokens[at:]])
            around *= 4
        return tokens


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """Hashes of byte strings of one length."""
    hashes = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            hashes = hashes * np.uint64(1099511628211) + rows[:, k].astype(np.uint64) + np.uint64(1)
    return mix(hashes)


def pretoken_starts(codes: np.ndarray, row_start: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of a slice; ``row_start`` marks the first of each text.

    Same cuts as the pattern ``'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
    runs of one class; one blank before a run joins it; the last white space
    before a run stands alone if it isn't a blank; a lone apostrophe that no
    blank precedes takes an ending of one or two lower-case letters.
    """
    n = len(codes)
    kind = classes[codes]
    start = row_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    here = np.flatnonzero(start & (kind != SPACE) & ~row_start)
    here = here[kind[here - 1] == SPACE]
    start[here - 1] = True
    start[here] = codes[here - 1] != 32
    mark = np.flatnonzero(codes == 39)
    mark = mark[mark < n - 1]
    mark = mark[(kind[mark + 1] == LETTER) & ~row_start[mark + 1]]
    before = np.maximum(mark - 1, 0)
    mark = mark[row_start[mark] | ((kind[before] != OTHER) & (codes[before] != 32))]
    if len(mark):
        padded = np.concatenate([codes, [0, 0, 0]])
        first, second = padded[mark + 1], padded[mark + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)
        rows = np.concatenate([row_start, [True, True, True]])
        two &= ~rows[mark + 2] & ~one
        start[mark[one | two] + 1] = False
        ends = np.concatenate([mark[one] + 2, mark[two] + 3])
        start[ends[ends < n]] = True
    return start


class Encoder:
    """A worker's encoder: keeps the ids of the distinct pre-tokens it has met."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        tokens, counts, _ = self.vocabulary.encode_words(words)
        n = len(self.known)
        while len(self.begin) < n + len(words):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while len(self.ids) < self.used + len(tokens):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(tokens)] = tokens
        self.count[n : n + len(words)] = counts
        self.begin[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(tokens)
        for i, w in enumerate(words):
            self.known[w] = n + i

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text begins in them (one more entry than texts)."""
        if not len(part.data):
            return np.zeros(0, np.int32), np.zeros(part.rows + 1, np.int64)
        first_byte = np.flatnonzero((part.data & 0xC0) != 0x80)
        codes = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        row_start = np.zeros(len(codes), bool)
        at = np.searchsorted(first_byte, part.offsets[:-1])
        row_start[at[at < len(codes)]] = True
        starts = np.flatnonzero(pretoken_starts(codes, row_start, self.vocabulary.classes))
        offsets = np.append(first_byte[starts], len(part.data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part.data))])
        distinct = words.dictionary_encode()
        names = distinct.dictionary.to_pylist()
        if len(self.known) + len(names) > KEPT_WORDS:
            self._forget()
        new = [w for w in names if w not in self.known]
        if new:
            self._learn(new)
        entry = np.fromiter((self.known[w] for w in names), np.int64, len(names))[distinct.indices.to_numpy()]
        counts = self.count[entry]
        ids = self.ids[ragged(self.begin[entry], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[np.searchsorted(offsets[:-1], part.offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Token ids of every text, without special tokens: ``key, out array<int>``, one row per input row.

    All characters and strings that look like markers are ordinary text.  A null
    text and an empty text give an empty list; a null key stays null; repeated
    rows each give a row; an empty table gives an empty one; further columns,
    whatever their names, are not read.  A very long text is a slice of its own.
    One narrow stage: no shuffle, nothing is collected.

    :param vocabulary: file of base64 tokens and ranks; by default the installed
        ``byte_bpe_50k``, looked up on each executor.
    """
    field = df.schema[key]
    schema = T.StructType([T.StructField(key, field.dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(os.fspath(vocabulary or vocabulary_path()))
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, offsets = own.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.rows), lists], names=[key, out])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
