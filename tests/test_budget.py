import json
import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions.text import CUT_MARK
from cuewright.operators import budget, media
from cuewright.plans import tools

TEXTS = ["plain", 'quo"te\\', "line\nfeed\ttab", "a😀… \x01", ""]


def payload(items):
    return len(json.dumps({"content": items}, ensure_ascii=False, separators=(",", ":")).encode("utf-16-le")) // 2


def test_lengths_add_up(spark):
    items = [{"type": "text", "text": x} for x in TEXTS] + [{"type": "image", "data": "QUJD", "mimeType": "image/jpeg"}]
    df = spark.createDataFrame([([(i["type"], i.get("text"), i.get("data"), i.get("mimeType")) for i in items],)], "c array<struct<type:string,text:string,data:string,mimeType:string>>")
    row = df.select(budget.payload_length("c").alias("n"), budget.payload_summary("c").alias("s"), budget.assert_fits("c", 10, "Too long").alias("e"), budget.assert_fits("c", 10_000, "Too long").alias("ok")).first()
    assert row.n == payload(items)
    assert row.s == f"Payload: {payload(items)} chars total, 4 base64 image chars."
    assert row.e.code == "BUDGET_EXCEEDED" and row.ok is None
    lengths = df.select(F.transform("c", lambda i: budget.item_length(i))).first()[0]
    assert 14 + sum(lengths) + len(items) - 1 == row.n
    assert spark.range(1).select(budget.image_item_length(F.lit(4))).first()[0] == lengths[-1]


def test_python_and_column_lengths_agree():
    out = tools.Payload(10_000)
    for x in TEXTS:
        out.text(x)
    out.image(0, 8)
    assert out.length == payload([{"type": "text", "text": x} for x in TEXTS] + [{"type": "image", "data": "x" * 8, "mimeType": "image/jpeg"}])


def test_append_if_fits(spark):
    base = F.array(budget.text_item(F.lit("ab")))
    n = spark.range(1).select(budget.payload_length(budget.append_if_fits(base, budget.text_item(F.lit("cd")), 1000))).first()[0]
    for most, size in ((n, 2), (n - 1, 1)):
        assert spark.range(1).select(F.size(budget.append_if_fits(base, budget.text_item(F.lit("cd")), most))).first()[0] == size


def test_prefix_and_all_or_error(spark):
    sizes = [10, 20, 30, 40]
    df = spark.createDataFrame([("m", i, n) for i, n in enumerate(sizes)], "m string, i int, n long")
    assert [r.running for r in budget.running_length(df, "m", "i", "n").orderBy("i").collect()] == [24, 45, 76, 117]
    assert sorted(r.i for r in budget.prefix_that_fits(df, "m", "i", "n", 76).collect()) == [0, 1, 2]
    assert budget.all_or_error(df, "m", "i", "n", 117).first().error is None
    bad = budget.all_or_error(df, "m", "i", "n", 116).first()
    assert bad.total == 117 and bad.error.code == "BUDGET_EXCEEDED" and "~1.0x over budget" in bad.error.message


def test_hints(spark):
    row = spark.createDataFrame([(10, 20)], "w int, h int").select(budget.hints("w", "h").alias("g"), budget.hints("h", "w", mode="frame").alias("f")).first()
    assert row.g.startswith("This video is portrait (10x20)") and "thumb_width=120" in row.g
    assert row.f.startswith("Try:") and "timestamps" in row.f


def reference_fold(kind, block, chunks, grids, most):
    """The same packing, measured on whole serializations each time."""
    content = []

    def length(items):
        return payload(items)

    def add(item):
        if length([*content, item]) > most:
            return False
        content.append(item)
        return True

    def cut(text, n):
        if len(text) <= n:
            return text
        keep = int(n * 0.6)
        return text[:keep] + CUT_MARK + text[-(n - keep) :]

    content.append({"type": "text", "text": block})
    if length(content) > most:
        return None
    for k, g in enumerate(grids):
        if g["grid_idx"] in chunks:
            add({"type": "text", "text": f"\n--- TRANSCRIPT {g['span']} ---\n" + cut(chunks[g["grid_idx"]], max(32, most - length(content) - 1024))})
        if not add({"type": "text", "text": f"\n--- FRAME GRID {k + 1}/{len(grids)} ---\nGrid {k + 1}/{len(grids)} {g['label']}"}) or not add({"type": "image", "data": "x" * g["data_chars"], "mimeType": "image/jpeg"}):
            return None
    if None in chunks:
        add({"type": "text", "text": "\n--- TRANSCRIPT (remaining) ---\n" + cut(chunks[None], max(32, most - length(content) - 256))})
    images = sum(len(i.get("data", "")) for i in content)
    content.append({"type": "text", "text": f"Payload: {length(content)} chars total, {images} base64 image chars."})
    return content if length(content) <= most else None


@pytest.mark.parametrize("seed", range(40))
def test_fold_matches_plain_packing(seed):
    rng = random.Random(seed)
    grids = [{"grid_idx": i, "start_sec": float(i), "span": f"{i}s", "label": "covers it", "data_chars": rng.randrange(10, 900)} for i in range(rng.randrange(1, 5))]
    texts = {k: "word " * rng.randrange(1, 500) for k in [*range(len(grids)), None] if rng.random() < 0.8}
    most = rng.randrange(300, 6000)
    items, total, error = tools.pack("video", "File: x", {k: (v, v, len(v)) for k, v in texts.items()}, grids, most)
    wanted = reference_fold("video", "File: x", texts, grids, most)
    if wanted is None:
        assert error["code"] == "BUDGET_EXCEEDED" and items == []
    else:
        assert error is None and total == payload(wanted) and [i["text"] for i in items] == [i.get("text") for i in wanted]


def test_fold_of_sound_and_pictures():
    long = "x" * 5000
    items, total, error = tools.pack("audio", "File: a", {None: (long, long, 5000)}, [], 2000)
    assert error is None and total <= 2000 and items[1]["text"].startswith("\n--- TRANSCRIPT ---\n")
    assert [i["type"] for i in tools.pack("audio", "File: a" + "y" * 300, {None: (long, long, 5000)}, [], 620)[0]] == ["text", "text"]  # no room: no transcript
    assert tools.pack("image", "File: a", {}, [{"data_chars": 10}], 1000)[0][1]["type"] == "image"
    assert tools.pack("image", "File: a", {}, [{"data_chars": 5000}], 1000)[2]["code"] == "BUDGET_EXCEEDED"
    assert tools.pack("audio", "y" * 900, {}, [], 500)[2]["code"] == "BUDGET_EXCEEDED"


@pytest.mark.parametrize(("kind", "size", "sec", "bad"), [("video", 10 * 1024**3 + 1, 1.0, True), ("video", 10 * 1024**3, 7200.0, False), ("audio", None, 7201.0, True), ("image", 5, 999999.0, False), ("video", None, None, False)])
def test_preflight(spark, kind, size, sec, bad):
    df = spark.createDataFrame([(kind, size, sec)], "type string, file_size_bytes long, duration_sec double")
    error = media.preflight(df).first().error
    assert (error is not None) == bad
    if size and size > 10 * 1024**3:
        assert "10.0 GB" in error.message


def test_cache_keeps_models_apart(spark):
    df = spark.createDataFrame([("f", "a", "t", i) for i in range(3)] + [("f", "b", "t", 9), ("g", "a", "x" * 20, 10), ("h", "a", None, None)], "f string, model string, text string, used int")
    kept = media.admit_to_cache(df, ["f", "model"], "text", "used", entries=3, most_chars=10).collect()
    assert [(r.f, r.model, r.used) for r in kept] == [("f", "b", 9), ("f", "a", 2), ("h", "a", None)]


def test_distinct_in_order(spark):
    df = spark.createDataFrame([(["b", "a", "b", None], None, ["c", "a"])], "x array<string>, y array<string>, z array<string>")
    assert df.select(media.union_in_order("x", "y", "z")).first()[0] == ["b", "a", "c"]
    paths = spark.createDataFrame([(2, "p"), (0, "q"), (1, "p"), (3, None)], "i int, p string")
    assert sorted(tuple(r) for r in media.first_seen(paths, "p", "i").collect()) == [("p", 1), ("q", 0)]


def test_batches_have_a_limit(spark):
    from cuewright.errors import MediaError

    with pytest.raises(MediaError):
        media.check_batch(spark.range(2), 1)
    assert media.check_batch(spark.range(2), 1, lift=True).count() == 2


def test_payloads_count_all_segments(spark, tmp_path):
    from cuewright.plans.queries import QUERIES

    media = {"plain": ["one", "two…"], "notes": ["🎵 la 🎵", 'say "𝄞"', "three", None], "edge": ["🎵" * 23_980], "beyond": ["🎵" * 23_981]}
    rows = [(m, i, 0.0, 1.0, x, False) for m, texts in media.items() for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "media_id string, seg_idx int, start_ms double, end_ms double, text string, turn boolean")
    df.withColumn("ingested_at", F.timestamp_micros(F.lit(0))).write.parquet(f"{tmp_path}/segments.parquet")
    found = {r.media_id: (r.total, r.n, r.over) for r in QUERIES["payload_length"](spark, str(tmp_path)).collect()}
    wanted = {}
    for m, texts in media.items():
        items = [{"type": "text", "text": x} for x in texts if x is not None]
        wanted[m] = (payload(items), len(items), payload(items) > 48_000)
    assert found == wanted and {m for m in wanted if wanted[m][2]} == {"beyond"}
