import random
import time

import numpy as np
import pytest

from cuewright.llm import leak
from cuewright.llm.leak import _GAP, _MATCH, _MISS, JUMP, leaks, matched_words

WORDS = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "lu", "mo", "ra", "se", "ti", "vu") for b in ("ker", "lan", "mit", "nor", "pel", "rus", "sta", "tol", "wex", "zin")]


def passage(rng, n=60):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(item, text):
    """The same score by plain dynamic programming, cell by cell."""
    n, m = len(item), len(text)
    zero = (0, 0)
    cell = [[zero] * (m + 1) for _ in range(n + 1)]
    best = [[zero] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = [zero, (cell[i][j - 1][0] - _GAP, cell[i][j - 1][1]), (cell[i - 1][j][0] - _GAP, cell[i - 1][j][1])]
            if item[i - 1] == text[j - 1]:
                start = max(cell[i - 1][j - 1], (best[i - 1][j - 1][0] - _MATCH * JUMP, best[i - 1][j - 1][1]), zero)
                options.append((start[0] + _MATCH, start[1] + 1))
            else:
                options.append((cell[i - 1][j - 1][0] - _MISS, cell[i - 1][j - 1][1]))
            cell[i][j] = max(options)
            if cell[i][j][0] <= 0:
                cell[i][j] = zero
            best[i][j] = max(best[i - 1][j], best[i][j - 1], cell[i][j])
    return best[n][m][1]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_matches_plain_programming(seed):
    rng = random.Random(seed)
    item = [rng.randrange(12) for _ in range(rng.randrange(1, 18))]
    text = [rng.randrange(12) for _ in range(rng.randrange(1, 10))] + item[: rng.randrange(18)] + [rng.randrange(12) for _ in range(5)] + item[rng.randrange(len(item)) :]
    got = matched_words(np.array(item, np.uint64), np.array(text, np.uint64))
    assert got == brute(item, text)


def test_alignment_of_copies():
    rng = random.Random(2)
    item = np.array(rng.sample(range(10_000), 50), np.uint64)
    noise = np.array(rng.sample(range(20_000, 90_000), 300), np.uint64)
    assert matched_words(item, np.concatenate([noise, item, noise])) == 50
    assert matched_words(item, np.concatenate([item[:25], noise, item[25:]])) == 50
    assert matched_words(item, np.delete(item, [10, 20, 30])) == 47
    assert matched_words(item, noise) == 0 and matched_words(item, item[:0]) == 0
    assert matched_words(item, np.concatenate([item[25:], noise, item[:25]])) == 25  # in order only


def test_leaks(spark):
    rng = random.Random(5)
    formula = "the chamber shall now resume with the same officer in the chair".split()
    items = [formula + passage(rng) if i % 2 else passage(rng) for i in range(20)]
    docs, wanted = [], set()
    for d in range(600):
        body = passage(rng, 150)
        if d % 3 == 0:
            body = formula + body
        if d % 10 == 0:
            k = rng.randrange(20)
            own = items[k][12:] if k % 2 else items[k]
            kind = rng.choice(["whole", "half", "third", "edited"])
            part = {"whole": own, "half": own[:36], "third": own[:15], "edited": [w for i, w in enumerate(own) if i % 9]}[kind]
            body[70:70] = [w.upper() if rng.random() < 0.3 else w for w in part]
            if kind != "third":
                wanted.add((d, k))
        docs.append((d, " ".join(body).replace(" ", "\n", 3) + ".", "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "word", "x"), (None, " ".join(items[0]), "x"), (903, "filler words " * 30_000 + " ".join(items[0]), "x"), (904, " ".join(items[2]), "x"), (904, " ".join(items[2]), "x")]
    wanted |= {(None, 0), (903, 0), (904, 2)}
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    questions = spark.createDataFrame([(i, "t", " ".join(w)) for i, w in enumerate(items)] + [(50, "t", None), (None, "t", "x"), (51, "t", "one two"), (52, "t", "")], "item_id long, task string, text string")
    found = [(r.doc_id, r.item_id) for r in leaks(table, questions).collect()]
    assert set(found) == wanted and len(found) == len(wanted) + 1  # the repeated document repeats
    blocks = {(r.doc_id, r.item_id) for r in leaks(table, questions, block_words=100).collect()}
    assert blocks == wanted
    assert leaks(table.limit(0), questions).count() == 0 and leaks(table, questions.limit(0)).count() == 0


def test_a_leak_that_is_copied_all_over_is_found(spark):
    rng = random.Random(9)
    formula = "the chamber shall now resume with the same officer in the chair.".split()
    items = [formula + passage(rng), passage(rng)]
    docs = [(d, " ".join(formula + passage(rng, 100))) for d in range(400)]
    docs += [(1000 + d, " ".join(formula + passage(rng, 1) + items[0][len(formula) :])) for d in range(200)]  # small changes each
    docs += [(2000 + d, "so " + " ".join(items[1])) for d in range(200)]  # exact copies
    found = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    assert found == {(1000 + d, 0) for d in range(200)} | {(2000 + d, 1) for d in range(200)}


@pytest.mark.parametrize("stop", [None, 10, 27, 60])
def test_part_of_an_item_in_many_near_copies_is_found(spark, stop):
    rng = random.Random(13)
    item = passage(rng)
    if stop:
        item[stop - 1] += "."  # the first sentence: less than the part, the part, or all
    part = item[20:47] if stop is None else item[:27]
    speech, docs = passage(rng, 120), [(d, " ".join(passage(rng, 100))) for d in range(400)]
    for d in range(200):  # a word changed in each copy, once inside the part
        copy = speech[:60] + part + speech[60:]
        copy[60 + 12 if d == 7 else rng.choice([*range(60), *range(90, 147)])] = "changed"
        docs.append((1000 + d, " ".join(copy)))
    docs += [(2000, " ".join(passage(rng, 50) + part + passage(rng, 50))), (2001, " ".join(passage(rng, 50) + part[:15] + passage(rng, 50)))]
    found = {r.doc_id for r in leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()}
    assert found == {1000 + d for d in range(200)} | {2000}


def test_later_parts_of_a_long_item_count(spark):
    rng = random.Random(17)
    item = [f"word{rng.randrange(10**6)}" for _ in range(12_000)]
    body = passage(rng, 200)
    docs = [(0, body + item), (1, item[7_100:] + body), (2, body + item[4_000:8_000]), (3, item[:6_000] + body), (4, body)]
    found = {r.doc_id: r.covered for r in leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()}
    assert found == {0: 1.0, 1: 4_900 / 12_000, 3: 0.5}


@pytest.mark.parametrize("seed", range(20))
def test_tiles_change_nothing_where_seeds_are_near(monkeypatch, seed):
    """Tiles of a few words, with seeds all along: the same as the whole table of cells."""
    monkeypatch.setattr(leak, "TILE", 4)
    monkeypatch.setattr(leak, "REACH", 40)
    rng = random.Random(seed)
    item = [rng.randrange(12) for _ in range(rng.randrange(4, 30))]
    text = [rng.randrange(12) for _ in range(10)] + item[: rng.randrange(18)] + [rng.randrange(12) for _ in range(5)] + item[rng.randrange(len(item)) :]
    at = [(i, j) for i in range(len(item)) for j in range(len(text))]
    got = matched_words(np.array(item, np.uint64), np.array(text, np.uint64), *(np.array(x) for x in zip(*at)))
    assert got == brute(item, text) == matched_words(np.array(item, np.uint64), np.array(text, np.uint64))


def test_books_and_long_items_cost_what_lies_near_seeds():
    rng = random.Random(3)
    item = np.array([rng.randrange(10**9) for _ in range(30_000)], np.uint64)
    book = np.array([rng.randrange(10**9) for _ in range(400_000)], np.uint64)
    text = np.concatenate([book[:200_000], item[3_000:20_000], book[200_000:], item[20_000:]])
    places = np.arange(3_000, 29_990, 7)
    began = time.monotonic()
    assert matched_words(item, text, places, np.where(places < 20_000, places + 197_000, places + 397_000)) == 27_000
    assert time.monotonic() - began < 60


def test_nothing_depends_on_blocks_or_partitions(spark):
    """Turns of phrase are told over all items, copies of a text over all tasks."""
    rng = random.Random(23)
    shared, formula = passage(rng, 9), "the chamber shall now resume with the same officer in the chair.".split()
    items = [passage(rng, 25) + shared + passage(rng, 25) if k < 4 else (formula if k % 2 else []) + passage(rng) for k in range(60)]
    copied = passage(rng, 40) + items[7][20:50]
    docs = [(d, " ".join([*(formula if d % 3 else []), *passage(rng, 60), *shared])) for d in range(300)]
    docs += [(1000 + d, " ".join(items[k][: 40 + d % 9] + passage(rng, 30))) for d, k in enumerate(rng.choices(range(60), k=100))]
    docs += [(2000 + d, " ".join(copied)) for d in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    questions = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    wanted = sorted(map(tuple, leaks(table, questions).collect()))
    assert {d for d, *_ in wanted} >= {2000 + d for d in range(200)} and len(wanted) >= 300
    for partitions, block_words in ((1, 200_000), (8, 700), (64, 1_500)):
        assert sorted(map(tuple, leaks(table.repartition(partitions), questions.repartition(3), block_words=block_words).collect())) == wanted


def test_a_copy_of_an_item_of_any_length_is_found(spark):
    rng = random.Random(29)
    item = [f"word{rng.randrange(10**6)}" for _ in range(20_000)]
    docs = [(0, " ".join(passage(rng, 300) + item)), (1, " ".join(item[:7_000])), (2, " ".join(passage(rng, 500)))]
    found = [tuple(r) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()]
    assert found == [(0, 5, 1.0)]
