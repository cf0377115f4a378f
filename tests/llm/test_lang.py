import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.llm import lang
from cuewright.operators.latest import latest_in_blocks

SAY = {
    "en": ["The committee has not decided about the bridge.", "We would like to know what happens to the school and the ferry.", "It was dark and they were late for the train."],
    "de": ["Der Ausschuss hat noch nicht über die Brücke entschieden.", "Wir möchten wissen, was mit der Schule und der Fähre geschieht.", "Es war dunkel und sie kamen zu spät zum Zug."],
    "fr": ["La commission n'a pas encore décidé pour le pont.", "Nous voulons savoir ce qui arrive à l'école et au bateau.", "Il faisait nuit et ils étaient en retard pour le train."],
    "es": ["La comisión todavía no ha decidido sobre el puente.", "Queremos saber qué pasa con la escuela y con el barco.", "Era de noche y llegaron tarde para tomar el tren."],
    "pt": ["A comissão ainda não decidiu sobre a ponte.", "Queremos saber o que acontece com a escola e com o barco.", "Era noite e eles chegaram atrasados para o comboio."],
    "it": ["La commissione non ha ancora deciso per il ponte.", "Vogliamo sapere che cosa succede alla scuola e al traghetto.", "Era buio e sono arrivati in ritardo per il treno."],
    "nl": ["De commissie heeft nog niet over de brug beslist.", "Wij willen weten wat er met de school en de veerboot gebeurt.", "Het was donker en zij waren te laat voor de trein."],
    "pl": ["Komisja jeszcze nie zdecydowała o moście dla miasta.", "Chcemy wiedzieć, co się stanie ze szkołą i z promem.", "Było ciemno i oni przyszli za późno na pociąg."],
}


@pytest.fixture(scope="module")
def filters():
    return lang.fit_texts([" ".join(s) for s in SAY.values() for _ in range(3)])


def detect(spark, filters, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, detected string")
    return [r for r in lang.document_languages(df, filters).orderBy("doc_id").collect()]


def test_languages_of_documents(spark, filters):
    rows = detect(spark, filters, [" ".join(s) for s in SAY.values()] + [" ".join(s).upper() for s in SAY.values()])
    assert [r.detected for r in rows] == [*SAY, *SAY]
    assert all(0 < r.confidence <= 1 for r in rows)


def test_parts_of_mixed_documents(spark, filters):
    text = " ".join(SAY["en"]) + "\n\n" + " ".join(SAY["pl"]) + " " + SAY["en"][0] * 1
    [row] = detect(spark, filters, [text])
    assert row.detected == "en" and {t.lang: t.sentences for t in row.tally} == {"en": 4, "pl": 3}
    assert [p.lang for p in row.parts] == ["en", "pl", "en"]
    assert "".join(text[p.begin : p.end] for p in row.parts) == text and text[row.parts[1].begin : row.parts[1].end].strip().startswith("Komisja")


def test_asides_and_texts_without_words(spark, filters):
    rows = detect(spark, filters, [None, "", " \n", "1 2 3", "Ka Zu, Bo Xi; Qu Vy", " ".join(SAY["de"]) + " (We would like to know what happens to the school.)"])
    assert [r.detected for r in rows] == [None] * 5 + ["de"] and [t.lang for t in rows[5].tally] == ["de"]
    assert lang.document_languages(spark.createDataFrame([], "doc_id long, text string"), filters).count() == 0


def test_lost_punctuation_still_shows_parts(spark, filters):
    text = " ".join(SAY["en"] * 2).replace(".", "") + " " + " ".join(SAY["fr"] * 2).replace(".", "")
    [row] = detect(spark, filters, [text])
    assert {t.lang for t in row.tally} == {"en", "fr"} and min(t.sentences for t in row.tally) >= 3


def test_long_texts_keep_their_counts(spark, filters):
    [row] = detect(spark, filters, [" ".join(SAY["it"]) * 5000])
    assert row.detected == "it" and len(row.parts) == 1


@pytest.mark.parametrize(("label", "code"), [("en", "en"), (" EN_us", "en"), ("pt-BR", "pt"), ("Deutsch", "de"), ("fre", "fr"), ("und", None), ("", None), ("--", None), (None, None), ("Swedish", None), ("es-419", "es"), ("nld", "nl"), ("Polski (auto)", "pl")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(lang.named_language(F.col("l"))).first()[0] == code


def test_segments_by_block(spark, filters):
    rows = [("m", i, SAY["it" if i != 7 else "en"][i % 3], None) for i in range(20)] + [("m", 20, "Nalund", None), ("m", 21, None, None), ("n", 0, "Speaker 1: " + SAY["es"][0], None), (None, 0, "x", None)]
    df = spark.createDataFrame(rows, "media_id string, seg_idx int, text string, ingested_at timestamp")
    by_block = lang.segment_languages(latest_in_blocks(df, "media_id", "seg_idx", "ingested_at", block=8), filters)
    found = sorted((r.media_id, r.lang, r.positions) for r in by_block.collect())
    assert ("m", "en", [7]) in found and sum(len(p) for m, g, p in found if g == "it") == 19 and ("n", "es", [0]) in found
    assert {tuple(r) for r in lang.main_languages(by_block).collect()} == {("m", 0, "it"), ("m", 1, "it"), ("m", 2, "it"), ("n", 0, "es")}


def test_no_exchange_by_medium_alone_carries_positions(spark, tmp_path):
    """One medium has nine tenths of all segments; its foreign ones come out all the same."""
    from cuewright.llm.queries import p3_found

    rows = [("hot" if i % 10 else f"m{i}", i, SAY["de" if i % 97 == 5 else "it"][i % 3], None, None, None, None) for i in range(9_000)]
    tables = {
        "segments": spark.createDataFrame(rows, "media_id string, seg_idx int, text string, ingested_at timestamp, start_ms double, end_ms double, turn boolean"),
        "documents": spark.createDataFrame([(i, " ".join(SAY[c]), c) for i, c in enumerate(list(SAY) * 3)], "doc_id long, text string, lang string"),
        "videos": spark.createDataFrame([("hot", ["en"], None)], "media_id string, subtitle_languages array<string>, fetched_at timestamp"),
        "speakers": spark.createDataFrame([], "speaker_id string, full_name string, family_name string, honorific string, party string, office string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    found = p3_found(spark, str(tmp_path))
    rows_found = [tuple(r) for r in found.collect()]
    assert {r for r in rows_found if r[0] == "segment"} == {("segment", "hot", i, "de") for i in range(9_000) if i % 97 == 5 and i % 10}
    assert ("video", "hot", -1, "it") in rows_found
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [after for line, after in zip(plan, plan[1:]) if re.search(r"RepartitionByExpression \[media_id#\d+\]", line)]
    assert below and all("Aggregate [media_id" in line for line in below)  # counts of blocks only


def test_sentences_of_long_texts_are_drawn_from_all_of_them(spark):
    late = " ".join(SAY["en"] * 300) + " " + " ".join(f"{a} {b}" for a, b in zip(SAY["pl"] * 400, SAY["pl"] * 400))
    documents = spark.createDataFrame([(1, late, "x"), (2, " ".join(SAY["en"]), None), (3, None, None), (4, "word " * 50_000, None)], "doc_id long, text string, lang string")
    filters = lang.fit(documents)
    [row] = detect(spark, filters, [" ".join(SAY["pl"])])
    assert row.detected == "pl"


def test_filters_say_no_mostly(filters):
    assert (filters.false < 0.02).all()
    n, shares = filters.shares(np.frombuffer(b"", np.uint8), np.zeros(0, np.int64))
    assert len(n) == 0 and shares.shape == (0, 8)
    none = lang.fit_texts([])
    part = next(lang.slices(pa.array(["the cat and the dog are with them for the day"])))
    assert lang.decide(*none.shares(part.data, np.array([0])))[0][0] in (-1, 0)  # function words alone decide little


def test_fitting_on_a_bounded_sample(spark):
    rows = [(i, " ".join(SAY[g]), g if i % 3 else None) for i, g in enumerate([*SAY] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    first, again = lang.fit(df, per_label=3), lang.fit(df.repartition(2), per_label=3)
    assert (first.table == again.table).all()


def test_parts_of_any_length_are_as_sure(spark, filters):
    short, long = detect(spark, filters, [" ".join(SAY["it"] * 100), " ".join(SAY["it"] * 2_000)])
    assert len(long.parts) == 1 and abs(long.parts[0].confidence - short.parts[0].confidence) < 0.01
    data = np.frombuffer(" ".join(SAY["fr"] * 2_000).encode(), np.uint8)
    whole, pieces = filters.shares(data, np.array([0])), filters.shares(data, np.arange(0, len(data), 50_000))
    assert whole[0][0] == pieces[0].sum() and np.allclose(whole[1][0], np.average(pieces[1], axis=0, weights=pieces[0]), atol=1e-3)


def test_words_before_a_colon_are_spoken(spark, filters):
    column = pa.array(["to quote the report:", "we know - they said", "mr brown: yes", "mr brown – yes", "speaker 2: yes", ">> mr brown: a: b", "no mark", "", "so it was: mr brown: yes"])
    people = lang.Speakers([{"speaker_id": "s1", "full_name": "Cy Brown", "family_name": "Brown", "honorific": "Mr", "party": None, "office": None}])
    kept = [" ".join(x.split()) for x in lang._without_label(column, people).to_pylist()]
    assert kept == ["to quote the report:", "we know - they said", "yes", "yes", "yes", "a: b", "no mark", "", "so it was: mr brown: yes"]
    rows = [("m", i, SAY["it"][i % 3], None) for i in range(5)] + [("m", 5, "We would like to know what happens to it:", None), ("m", 6, "It was dark and they were late - for the", None)]
    df = spark.createDataFrame(rows, "media_id string, seg_idx int, text string, ingested_at timestamp")
    found = lang.segment_languages(latest_in_blocks(df, "media_id", "seg_idx", "ingested_at"), filters).where("lang = 'en'").collect()
    assert [r.positions for r in found] == [[5, 6]]


def test_labels_of_any_length_are_no_speech(spark):
    from cuewright.llm.turns import Speakers

    office = "Minister for the Harbours, the Ferries, the Bridges and the Lighthouses of the Northern and the Southern Islands"
    people = Speakers([{"speaker_id": "s1", "full_name": "Ada Brown", "family_name": "Brown", "honorific": "Ms", "party": "Green Shore", "office": office}])
    texts = [f"{office}: {SAY['es'][0]}", f"[00:01:02] the {office} — x", "Brown— y", f"to quote the {office} again: z", "a: b"]
    got = [t.as_py().split() for t in lang._without_label(lang._lower(pa.array(texts)), people)]
    assert got == [SAY["es"][0].lower().split(), ["[00:01:02]", "x"], ["y"], texts[3].lower().split(), ["a:", "b"]]
