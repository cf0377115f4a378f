import random
from datetime import datetime

import pytest

from cuewright.llm.turns import Speakers, _overlap, speaker_turns

T1 = datetime(2024, 1, 1)
SEG = "media_id string, seg_idx int, start_ms double, end_ms double, text string, turn boolean, ingested_at timestamp, speaker_id string, who string"
PEOPLE = [
    ("s1", "Ada Brown", "Brown", "Ms", "Green Shore", "Presiding Officer"),
    ("s2", "Cy Brown", "Brown", "Mr", "Reform Union", None),
    ("s3", "Dan Kuzenberg", "Kuzenberg", "Dr", "Independent", "Minister for Harbours"),
    (None, None, None, None, None, None),
]
SPEAKERS = "speaker_id string, full_name string, family_name string, honorific string, party string, office string"


def people():
    names = ["speaker_id", "full_name", "family_name", "honorific", "party", "office"]
    return Speakers([dict(zip(names, p)) for p in PEOPLE])


@pytest.mark.parametrize(
    ("label", "who"),
    [
        ("Kuzenberg", "s3"), ("DR KUZENBERG", "s3"), ("Dr. D. Kuzenberg", "s3"), ("Kuzenberg, Dan", "s3"), ("Kuzneberg", "s3"), ("Dan Kuzenbeerg", "s3"), ("Dr Kuzenberg (Independent)", "s3"),
        ("The Minister for Harbours", "s3"), ("presiding officer", "s1"), ("Brown", "unknown"), ("Mr Brown", "s2"), ("A. Brown", "s1"), ("Brown (Reform Union)", "s2"), ("Cy Brown", "s2"),
        ("Speaker 2", "voice:2"), ("SPEAKER_04", "voice:4"), ("S1", "voice:1"), ("Note", None), ("As Dr Kuzenberg said", None), ("", None), ("Church Dan Kuzenberg", None),
    ],
)
def test_labels_resolve(label, who):
    assert people().who(label) == who


@pytest.mark.parametrize(
    ("text", "who"),
    [
        ("Kuzenberg: words", ["s3"]), (">> Mr Brown: words", ["s2"]), ("- [00:01:02] Cy Brown: x", ["s2"]), ("[Dr Kuzenberg] x", ["s3"]), ("<v Ada Brown> x", ["s1"]), ("Speaker 2 - x", ["voice:2"]),
        ("first words Dan Kuzenberg: then", ["s3"]), ("Mr Brown: x. Kuzenberg: y", ["s2", "s3"]), ("As Ms Brown said: no", []), ("My point is simple: x", []), ("[applause] x", []), ("Dr Kuzenberg - Kuzenberg told us", []), ("Dr Kuzenberg and I agree", []), ("Kuzenberg:", ["s3"]),
    ],
)
def test_labels_in_text(text, who):
    assert [w for _, _, w in people().labels(text)] == who


def turns(spark, segments, **options):
    rows = [("m", i, i * 1000.0, i * 1000.0 + 900, t, f, T1, "x", "y") for i, (t, f) in enumerate(segments)]
    found = speaker_turns(spark.createDataFrame(rows, SEG), spark.createDataFrame(PEOPLE, SPEAKERS), **options)
    return sorted(((r.seg_idx, r.part, r.speaker_id, r.opened_by, r.text) for r in found.collect()))


def opened(found):
    return [(s, w) for s, _, w, o, _ in found if o in ("label", "flag")]


TALK = [
    ("hello all", True), ("Kuzenberg: I uh, speak", False), ("and go on", None), ("Dr Kuzenberg: still me", True), ("(laughter)", True), ("Mr Brown:", False), ("my words [00:00:09] here Kuzenberg: no", False),
    ("someone", True), ("Speaker 1: x", False), ("Speaker 2: y", False), ("S2: z", True), (None, True), (" ", True), ("♪", True),
]


def test_turns(spark):
    found = turns(spark, TALK)
    assert opened(found) == [(0, "unknown"), (1, "s3"), (5, "s2"), (6, "s3"), (7, "unknown"), (8, "unknown"), (9, "unknown")]
    text = {s: t for s, _, _, o, t in found if o == "label"}
    assert text[1] == "I speak and go on still me" and text[5] == "my words here" and text[6] == "no"


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_blocks_change_no_opening(spark, block):
    assert opened(turns(spark, TALK, block=block)) == opened(turns(spark, TALK))
    held = [("Kuzenberg: a", False), *[("b", None)] * 5, ("Kuzenberg: c", True), ("Brown: d", False)]
    assert opened(turns(spark, held, block=block)) == [(0, "s3"), (7, "unknown")]


def test_rolling_captions_are_said_once(spark):
    found = turns(spark, [("Kuzenberg: we will open the", False), ("will open the old bridge", False), ("open the old bridge", False)])
    assert found[0][4] == "we will open the old bridge"


def test_pauses_split_turns(spark):
    rows = [("m", 0, 0.0, 900.0, "Kuzenberg: a b c", None, T1, "", ""), ("m", 1, 1000.0, 1900.0, "d", None, T1, "", ""), ("m", 2, 90_000.0, 91_000.0, "e", None, T1, "", ""), ("m", 3, None, None, "f", None, T1, "", ""), ("m", 4, 95_000.0, 94_000.0, "g", None, T1, "", "")]
    found = speaker_turns(spark.createDataFrame(rows, SEG), spark.createDataFrame(PEOPLE, SPEAKERS), pause_ms=30_000).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.opened_by, r.speaker_id, r.text) for r in found] == [(0, "label", "s3", "a b c d"), (2, "pause", "s3", "e f g")]


def test_empty_tables_and_missing_keys(spark):
    empty = spark.createDataFrame([], SEG)
    assert speaker_turns(empty, spark.createDataFrame(PEOPLE, SPEAKERS)).count() == 0
    rows = [(None, 0, 0.0, 1.0, "Kuzenberg: x", True, T1, "", ""), ("m", None, 0.0, 1.0, "Kuzenberg: x", True, T1, "", ""), ("m", 1, 0.0, 1.0, "Kuzenberg: x", True, None, "", "")]
    found = speaker_turns(spark.createDataFrame(rows, SEG), spark.createDataFrame([], SPEAKERS)).collect()
    assert [(r.seg_idx, r.speaker_id, r.opened_by) for r in found] == [(1, "unknown", "flag")]


@pytest.mark.parametrize("dash", [" - ", " – ", " — ", "— ", " – ", "\t- "])
def test_every_dash_ends_a_label(spark, dash):
    assert opened(turns(spark, [("hello all", True), (f"Kuzenberg{dash}my words", False)])) == [(0, "unknown"), (1, "s3")]


def test_long_captions_are_said_once(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    grown = [a, a + b, a + b + c, (b + c)[5:] + ["end"]]
    apart = [a, b[:20], a + b[:20] + c]
    for segments in (grown, apart):
        found = turns(spark, [(("Kuzenberg: " if i == 0 else "") + " ".join(w), False) for i, w in enumerate(segments)])
        wanted = a + b + c + ["end"] if segments is grown else a + b[:20] + c
        assert [t.split() for *_, t in found] == [wanted]


def test_overlaps_are_the_longest():
    rng = random.Random(3)
    for _ in range(500):
        before, words = ([rng.choice("ab") for _ in range(rng.randrange(12))] for _ in range(2))
        assert _overlap(before, words) == max([n for n in range(3, 13) if n <= min(len(before), len(words)) and before[-n:] == words[:n]], default=0)


def merged(found):
    """Turns with the rows that later blocks add to them put together."""
    out = []
    for entity, seg, part, who, opened_by, start, end, text in sorted(map(tuple, found)):
        if opened_by == "carry" and out and out[-1][0] == entity and out[-1][3] == who:
            out[-1][6:] = max((x for x in (out[-1][6], end) if x is not None), default=None), f"{out[-1][7]} {text}".strip()
        else:
            out.append([entity, seg, part, who, opened_by, start, end, text])
    return out


def test_blocks_change_only_the_rows_a_text_comes_in(spark):
    """Pauses, captions that roll or grow, holders of the floor and gaps go across the borders of blocks."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for medium, n in (("hot", 900), ("small", 30), ("quiet", 5)):
        now, said = 0.0, []
        for i in range(n):
            fresh = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
            text = said[-rng.choice([0, 0, 3, 6, 12]) :] + fresh if said and rng.random() < 0.6 else fresh
            said += fresh
            label = rng.choice(["", "", "", "", "", "Kuzenberg: ", "Speaker 2: ", "Mr Brown: "])
            now += rng.choice([0, 100, 400, 400, 900, 30_000 if rng.random() < 0.03 else 0])
            rows.append((medium, i, now if rng.random() < 0.97 else None, now + rng.choice([500, 2500, -50]), label + " ".join(text) if rng.random() < 0.95 else None, rng.random() < 0.02, T1, "x", "y"))
            now += 1500
    table = spark.createDataFrame(rows, SEG).repartition(4)
    people = spark.createDataFrame(PEOPLE, SPEAKERS)
    whole = merged(speaker_turns(table, people).collect())
    assert {r[4] for r in whole} >= {"label", "flag", "pause"}
    for block in (16, 64, 512):
        assert merged(speaker_turns(table, people, block=block).collect()) == whole


@pytest.mark.parametrize("n", [41, 60, 500])
@pytest.mark.parametrize("block", [1, 4096])
def test_overlaps_of_any_length_are_removed(spark, n, block):
    a, b, c = ([f"{x}{i}" for i in range(n)] for x in "abc")
    found = turns(spark, [("Kuzenberg: " + " ".join(a + b), False), (" ".join(b + c), False), (" ".join(c + ["end"]), False)], block=block)
    assert " ".join(t for *_, t in found).split() == a + b + c + ["end"]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_pauses_at_borders_of_blocks(spark, block):
    rows = [("m", i, s, s + 900, t, None, T1, "", "") for i, (s, t) in enumerate([(0.0, "Kuzenberg: a b c"), (1000.0, "d"), (90_000.0, "e"), (91_000.0, "f"), (200_000.0, "g")])]
    found = speaker_turns(spark.createDataFrame(rows, SEG), spark.createDataFrame(PEOPLE, SPEAKERS), pause_ms=30_000, block=block)
    assert [(r[1], r[3], r[4], r[7]) for r in merged(found.collect())] == [(0, "s3", "label", "a b c d"), (2, "s3", "pause", "e f"), (4, "s3", "pause", "g")]


def test_names_and_offices_of_any_length_are_labels():
    office = "Minister for " + ", ".join(f"the Affairs of Region Number {i}" for i in range(30))
    own = Speakers([dict(zip(["speaker_id", "full_name", "family_name", "honorific", "party", "office"], p)) for p in [*PEOPLE, ("s9", "Maria del Carmen Ines Sofia Alba Rosa Luz Vega", "Vega", "Dr", "Union of Free Towns and Harbours", office)]])
    for label in (office, f"The {office}", office.upper(), "Maria del Carmen Ines Sofia Alba Rosa Luz Vega (Union of Free Towns and Harbours)", office.replace(" ", "   ")):
        for text in (f"{label}: x", f"first words. {label}: x", f"[{label}] x", f"<v {label}> x", f"{label} - x"):
            assert [w for _, _, w in own.labels(text)] == ["s9"], text
    assert own.labels("word " * 200_000 + "Kuzenberg: x")[0][2] == "s3" and own.labels("a b: " * 3_000) == []


def test_openings_alone_need_no_texts(spark):
    full = turns(spark, TALK)
    found = turns(spark, TALK, pause_ms=float("inf"), texts=False)
    assert opened(found) == opened(full) and {t for *_, t in found} == {None}
