import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from cuewright import errors
from cuewright.functions import text as t


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def test_utf16_length_counts_units(spark):
    assert one(spark, t.utf16_length("x"), x="a😀…") == 4


def test_fixed1_rounds_the_binary_value(spark):
    rng = random.Random(3)
    values = [0.0, 0.05, 0.25, 1.45, 4.15, 12.25, 12.75, 99.95, 1e9 + 0.05] + [rng.randrange(0, 10**6) / 1000 for _ in range(3000)] + [k / 20 for k in range(2000)] + [rng.uniform(0, 1e6) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(t.fixed1("x")).collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]


def test_to_fixed(spark):
    got = [r[0] for r in spark.createDataFrame([(0.125,), (1.0005,), (None,), (-0.25,)], "x double").select(t.to_fixed("x", 2)).collect()]
    assert got == ["0.13", "1.00", None, "-0.25"]


@pytest.mark.parametrize(("ms", "label"), [(0.0, "00:00:00,000"), (1500.0, "00:00:01,500"), (65000.0, "00:01:05,000"), (3661234.0, "01:01:01,234"), (999.6, "00:00:01,000"), (-5.0, "00:00:00,000"), (360_000_000.0, "100:00:00,000"), (None, None)])
def test_srt_timestamp(spark, ms, label):
    assert spark.createDataFrame([(ms,)], "x double").select(t.srt_timestamp("x")).first()[0] == label


def test_timestamp_label(spark):
    assert one(spark, t.timestamp_label("x"), x=0.7) == "00:00:00.700"
    assert one(spark, t.timestamp_label("x"), x=83.4566) == "00:01:23.457"


@pytest.mark.parametrize(("sec", "long", "short"), [(7200.0, "2h", "2h"), (7260.0, "2h 1m", "2h 1m"), (3660.0, "1h 1m", "1h 1m"), (300.0, "5m", "5m"), (135.0, "2m", "2m15s"), (9.0, "0m", "9s"), (0.0, "0m", "0s")])
def test_durations(spark, sec, long, short):
    assert one(spark, F.struct(t.duration_label("x"), t.short_duration("x")), x=sec) == (long, short)


@pytest.mark.parametrize(("size", "label"), [(17, "17 B"), (1024, "1.0 KB"), (1536 * 1024, "1.5 MB"), (15 * 1024**3, "15.0 GB")])
def test_size_label(spark, size, label):
    assert one(spark, t.size_label("x"), x=size) == label


def cut(text, most):
    if len(text) <= most:
        return text
    keep = int(most * 0.6)
    tail = most - keep
    return text[:keep] + t.CUT_MARK + (text[-tail:] if tail else text)


@pytest.mark.parametrize("most", [0, 1, 2, 5, 9, 10, 100])
def test_truncate_middle(spark, most):
    for text in ("", "abcdefghij", "x" * 11):
        assert one(spark, t.truncate_middle("x", most), x=text) == cut(text, most)
        units = spark.createDataFrame([(text, text, len(text), most)], "a string, b string, n int, m int").select(t.cut_middle("a", "b", "n", "m")).first()[0]
        assert units == cut(text, most)


def test_predicates_and_keys(spark):
    rows = spark.createDataFrame([("  HTTPS://x.y ",), ("http://a",), ("ftp://a",), ("/a/b",), ("",), (None,)], "u string").select(t.is_url("u"), t.url_hash("u")).collect()
    assert [r[0] for r in rows] == [True, True, False, False, False, False]
    import hashlib

    assert rows[0][1] == hashlib.sha256(b"HTTPS://x.y").hexdigest()[:16]
    assert [one(spark, t.has_glob("p"), p=p) for p in ("a*b", "a?b", "a[b", "a{b", "ab")] == [True, True, True, True, False]


def test_strings(spark):
    assert one(spark, t.strip_tags("x"), x=" <i>a\nb</i> \t") == "a b"
    assert one(spark, t.srt_separators("x"), x="00:00:01.000 --> 00:00:02.500") == "00:00:01,000 --> 00:00:02,500"
    assert one(spark, t.escape_xml("x"), x="<a & \"b\" 'c'>") == "&lt;a &amp; &quot;b&quot; &apos;c&apos;&gt;"
    assert one(spark, t.strip("x"), x="　 a \n") == "a"


@pytest.mark.parametrize(("w", "h", "tokens"), [(1920, 1080, 2765), (16, 16, 1), (1080, 1920, 2765)])
def test_vision_tokens(spark, w, h, tokens):
    assert one(spark, t.vision_tokens("w", "h"), w=w, h=h) == tokens


def test_error_structs(spark):
    row = spark.range(1).select(errors.error("FILE_TOO_LARGE", "no").alias("e"), errors.error("UNKNOWN", F.lit(None).cast("string")).alias("n")).first()
    assert (row.e.code, row.e.message, row.n) == ("FILE_TOO_LARGE", "no", None)
    assert one(spark, errors.envelope(errors.error("UNKNOWN", "why"))) == "[UNKNOWN] why"
    assert errors.text_of(errors.MediaError("UNKNOWN", "why")) == "[UNKNOWN] why" and errors.text_of(ValueError("x")) == "x"
    with pytest.raises(ValueError):
        errors.MediaError("NO_SUCH", "x")


def test_null_safe_numbers(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string").select(t.number_or_zero("v"), t.text_or_empty("v")).collect()
    assert [tuple(r) for r in rows] == [(1.5, "1.5"), (0.0, "x"), (0.0, "")]
