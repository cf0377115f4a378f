import base64
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from cuewright.functions.textvec import slices
from cuewright.llm import bpe

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

PIECES = ["'", "s", "t", "re", "ll", "'ve", " ", "  ", "\n", "\t", "a", "é", "é", "½", "3", ".", "<|endoftext|>", "ﬁ", "\xa0", "👩‍👩", "議", "A", "don", "\r\n", "\x1c", "\x85", "​", '"', "—", "ing", "tion", "xqz"]


@pytest.fixture(scope="module")
def exact():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts, limit=1 << 20):
    own = bpe.encoder(bpe.vocabulary_path())
    out = []
    for part in slices(pa.array(texts, pa.string()), limit):
        ids, cuts = own.encode(part)
        out += [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    return out


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_same_ids_as_exact_merging(exact, limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", None, "x" * 3000, " " * 500, "\n"]
    assert encode(texts, limit) == [exact.encode_ordinary(t or "") for t in texts]


def test_random_bytes_of_words(exact):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzäößéøł"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(5000)]
    vocabulary = bpe.encoder(bpe.vocabulary_path()).vocabulary
    tokens, counts, repaired = vocabulary.encode_words([w.encode() for w in words])
    assert 0 < repaired < len(words)  # some proposals fail, not all
    assert [p.tolist() for p in np.split(tokens, np.cumsum(counts)[:-1])] == [exact.encode_ordinary(w) for w in words]


def test_memory_of_a_worker_is_bounded(monkeypatch, exact):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    texts = [f"word{i} other{i * 7}" for i in range(500)]
    assert encode(texts, 100) == [exact.encode_ordinary(t) for t in texts]


def test_table(spark, exact):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "c", "x"), (4, "long " * 50_000, "x")]
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in found) == sorted((k or 0, exact.encode_ordinary(t or "")) for k, t, _ in rows)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("letters", "n"), [("ACGT", 1_000_000), ("etaoinshrdlu", 200_000), ("a", 1_000_000), ("-", 300_000), ("-=_*#", 200_000), ("0123456789", 200_000), ([chr(c) for c in range(0x4E00, 0x9FFF)], 300_000), (["the", "quick", "national", "under"], 50_000), ([" "], 100_000), ("é", 70_000)])
def test_runs_without_blanks_are_exact(exact, letters, n):
    rng = random.Random(n)
    run = "".join(rng.choices(letters, k=n))
    began = time.monotonic()
    got = encode([f"before {run} after", run, None])
    assert time.monotonic() - began < 30
    assert got == [exact.encode_ordinary(f"before {run} after"), exact.encode_ordinary(run), []]


def test_long_words_are_mended(monkeypatch, exact):
    """With one token on either side the borders of what is merged anew often fail again."""
    vocabulary = bpe.encoder(bpe.vocabulary_path()).vocabulary
    rng = random.Random(11)
    for around in (1, 4):
        monkeypatch.setattr(bpe, "AROUND", around)
        for size in (65, 100, 700):
            words = ["".join(rng.choice("abcdefghilmnoprstuy") for _ in range(size)) for _ in range(100)]
            tokens, counts, repaired = vocabulary.encode_words([w.encode() for w in words])
            assert repaired > 50
            assert [p.tolist() for p in np.split(tokens, np.cumsum(counts)[:-1])] == [exact.encode_ordinary(w) for w in words]
            assert [vocabulary.merge(w.encode()) for w in words] == [exact.encode_ordinary(w) for w in words]
