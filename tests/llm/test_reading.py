import os
import random

import numpy as np
import pyarrow as pa
import pytest

from cuewright.functions.textvec import fold, slices
from cuewright.llm import lang, reading

PLAIN = ["The bus is late.", "We want a new road.", "My son saw the dog.", "It was wet and cold.", "They shut the old shop.", "I do not like it."]
MIDDLE = ["The water office promised to repair the bridge before the winter.", "Most families who wrote to me asked about the small school.", "The town paid for the boat although nobody had used it."]
HARD = [
    "Notwithstanding the assurances offered by the department, the administrative arrangement substantially undermines the responsibilities of municipal authorities, which explains why residents have objected.",
    "Because the contracts were renewed without competition, the environmental assessment fails to address the maintenance of essential services, unless the department publishes its assumptions.",
]
POOLS = {1: (PLAIN, 40), 2: (MIDDLE, 20), 3: (HARD, 9)}


def text(rng, level):
    pool, n = POOLS[level]
    other = POOLS[rng.choice([k for k in POOLS if abs(k - level) <= 1])][0]
    return " ".join(rng.choice(pool if rng.random() < 0.85 else other) for _ in range(n))


def table(spark, rng, n=60):
    return spark.createDataFrame([(i, text(rng, i % 3 + 1), i % 3 + 1) for i in range(n)], "passage_id long, text string, reading_level int")


def test_levels_of_new_texts(spark):
    rng = random.Random(1)
    passages = table(spark, rng)
    rows = [(i, text(rng, i % 3 + 1), "x") for i in range(90)]
    odd = [(200, None, "x"), (201, "", "x"), (202, "too short", "x"), (203, " ".join(["Der Ausschuss hat noch nicht über die Brücke entschieden und wir warten auf eine Antwort."] * 12), "x"), (None, text(rng, 1), "x"), (1, rows[1][1], "x"), (204, " ".join(PLAIN * 3000), "x")]
    documents = spark.createDataFrame(rows + odd, "doc_id long, text string, reading_level string").repartition(3)
    model = reading.fit(passages, documents)
    filters = lang.fit_texts([r[1] for r in rows] + [odd[3][1]] * 5)
    found = [(r.doc_id, r.reading_level) for r in reading.reading_levels(documents, model, filters).collect()]
    levels = [(k, v) for k, v in found if k is not None and k < 90]
    assert len(levels) == 91 and sum(v == k % 3 + 1 for k, v in levels) / 91 > 0.9
    assert not {200, 201, 202, 203} & {k for k, _ in found} and (204, 1) in found and any(k is None for k, _ in found)
    assert reading.reading_levels(documents.limit(0), model, filters).count() == 0
    nothing = reading.fit(passages.limit(0), documents)
    assert nothing is None and reading.reading_levels(documents, nothing, filters).count() == 0


def test_calls_and_notes_change_nothing():
    corpus = reading.Corpus(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64))
    measures = reading.Measures(corpus)
    base = " ".join(HARD * 4)
    noisy = base.replace("objected. ", "objected. (Laughter on several benches.)\nBROWN: No, no!\n", 1)
    features = [measures.of(next(slices(fold(pa.array([t])))))[0][0] for t in (base, noisy)]
    assert np.allclose(features[0], features[1], atol=0.15)
    empty = measures.of(next(slices(fold(pa.array(["", "?", "1 2"])))))
    assert np.isfinite(empty[0]).all()


def test_counts_are_those_of_the_corpus(spark):
    formula = "the question was put from the chair and the chamber agreed to it at once."
    docs = spark.createDataFrame([(f"word{i}. {formula if i % 2 else 'other thing.'}",) for i in range(400)] + [(None,), ("",)], "text string").repartition(7)
    corpus = reading.corpus_counts(docs)
    assert len(corpus.usual) == 1 and len(corpus.words) <= 1 / reading.COMMON
    assert reading.corpus_counts(docs.limit(0)).words.size == 0


def test_ordinal_regression_keeps_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = np.digitize(2 * x[:, 0] - x[:, 1], [-2, 0, 2]) + 1
    model = reading.Ordinal.fit(x, y, (0, 1), ridge=0.001)
    assert (model.place(x) == y).mean() > 0.9 and (np.diff(model.cuts) > 0).all() and model.slope[0] > 0 > model.slope[1]


FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy_on_graded_passages(spark):
    """Each fifth of the passages is placed by what the others say."""
    corpus = reading.corpus_counts(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = spark.read.parquet(f"{FOLDER}/graded_passages.parquet").orderBy("passage_id").select("text", "reading_level").collect()
    right = 0
    for fold_of in range(5):
        known, other = ([r for i, r in enumerate(rows) if (i % 5 == fold_of) == held] for held in (False, True))
        model = reading.fit_texts([r[0] for r in known], [r[1] for r in known], corpus)
        x = np.concatenate([model.features(p)[0] for p in slices(fold(pa.array([r[0] for r in other])))])
        right += int((model.levels(x) == [r[1] for r in other]).sum())
    assert right / len(rows) >= 0.9


def test_regression_of_one_level_and_of_parted_ones():
    x = np.arange(20, dtype=float).reshape(-1, 1)
    assert (reading.Ordinal.fit(x, np.full(20, 3), (0,)).place(x) == 3).all()
    assert (reading.Ordinal.fit(x, np.repeat([1, 4], 10), (0,)).place(x) == np.repeat([1, 4], 10)).all()


def test_formulas_count_wherever_they_lie(spark):
    """A formula of just over 0.5 % of the documents, nearly all in one task; a speech with copies in every task makes none."""
    formula = "the question was put from the chair and the chamber agreed to it at once."
    copied = "this long sentence is in one speech only which is there many times over and over."
    known = reading.corpus_counts(spark.createDataFrame([(f"{formula} a{i}.",) for i in range(9)], "text string")).usual
    groups = [[f"word{g}x{i}. {formula if i < (28 if g == 0 else 1) else 'other thing.'}" for i in range(1_500)] for g in range(4)]
    copies = [[f"word{g}x{i}. {formula if i < 2 else 'other thing.'}" for i in range(40)] + [copied] * 6 for g in range(8)]
    for tasks in (groups, copies):
        docs = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for g in tasks for t in g], len(tasks)), "text string")
        for parts in (len(tasks), 1):
            assert reading.corpus_counts(docs.coalesce(parts)).usual.tolist() == known.tolist() and len(known) == 1
