"""Queries of the text operators, with the SQL that checks those which SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm import bpe, lang, leak, reading, runs, split, turns
from cuewright.operators.latest import latest, latest_in_blocks


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pieces(spark: SparkSession, folder: str, only_cut: bool) -> DataFrame:
    limits = split.limits(_table(spark, folder, "split_limits"))

    def cut(kind: str, table: str, keys: list[str], text: str, version: str) -> DataFrame:
        limit, overlap = limits.get(kind, split.UNLIMITED)
        # If only texts above the limit are asked for, only they travel to where the current version is chosen.
        kept = F.when(F.length(text) > limit, F.col(text)) if only_cut else F.col(text)
        current = latest(_table(spark, folder, table).select(*keys, kept.alias("text"), version), keys, version)
        return split.split_texts(current, keys, "text", limit, overlap).withColumn("item_kind", F.lit(kind))

    segments = cut("segment", "segments", ["media_id", "seg_idx"], "text", "ingested_at")
    transcripts = cut("transcript", "understand_results", ["media_id"], "transcript", "created_at").withColumn("seg_idx", F.lit(-1))
    return segments.unionByName(transcripts)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, True).where("n_pieces > 1 AND piece = 0").select("item_kind", "media_id", "seg_idx")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All current texts as pieces a model context can take."""
    return _pieces(spark, folder, False).select("item_kind", "media_id", "seg_idx", "piece", "n_pieces", "begin", "end", "text")


def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every current text put together from its pieces, less what they share with the one before: what was cut, whole."""
    pieces = _pieces(spark, folder, False)
    new = F.substring("text", F.greatest(F.lit(0), F.col("before") - F.col("begin")) + 1, F.length("text"))
    keys = ["item_kind", "media_id", "seg_idx"]
    shared = pieces.withColumn("before", F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("piece")), F.lit(0))).withColumn("new", new)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda x: x["new"]), "")
    return shared.groupBy(*keys).agg(F.md5(joined).alias("digest"), F.max(F.length("text")).alias("longest"), F.count(F.lit(1)).alias("n")).select(*keys, "digest", (F.col("longest") > F.when(F.col("item_kind") == "segment", _most(spark, folder, "segment")).otherwise(_most(spark, folder, "transcript"))).alias("over"), (F.col("n") > 1).alias("cut"))


def _most(spark: SparkSession, folder: str, kind: str) -> Column:
    return F.lit(split.limits(_table(spark, folder, "split_limits"))[kind][0])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    filters = lang.fit(documents)
    kind = lambda name: F.lit(name).alias("item_kind")
    whole = F.lit(-1).alias("seg_idx")

    # The label takes part in the same narrow stage as the text: no join.
    keyed = documents.select(F.struct("doc_id", lang.named_language(F.col("lang")).alias("named")).alias("key"), "text")
    found = lang.document_languages(keyed, filters, key="key")
    main = F.struct(F.lit("document").alias("item_kind"), F.col("detected").alias("lang"))
    wrong = ~F.col("key.named").eqNullSafe(F.col("detected"))
    foreign = F.filter("tally", lambda t: (t["sentences"] >= 3) & (t["lang"] != F.col("detected")))
    parts = F.concat(F.transform(foreign, lambda t: t["lang"]), F.array("detected"))
    cases = F.concat(
        F.when(wrong, F.array(main)).otherwise(F.array()),
        F.when(F.size(foreign) > 0, F.transform(parts, lambda t: F.struct(F.lit("mixed").alias("item_kind"), t.alias("lang")))).otherwise(F.array()),
    )
    in_documents = found.where("detected IS NOT NULL").select(F.col("key.doc_id").cast("string").alias("item_key"), F.inline(cases)).select("item_kind", "item_key", whole, "lang")

    segments = _table(spark, folder, "segments").select("media_id", "seg_idx", "text", "ingested_at")
    current = latest_in_blocks(segments, "media_id", "seg_idx", "ingested_at")
    # Three readers share this exchange: none of them may add a filter or drop a column that another keeps.  It is by block,
    # as are the joins: a medium that holds a third of all segments is no single task's.
    by_block = lang.segment_languages(current, filters, speakers=_table(spark, folder, "speakers")).where("media_id IS NOT NULL AND block IS NOT NULL AND lang IS NOT NULL").select("media_id", "block", "lang", "positions").repartition("media_id", "block")
    mains = lang.main_languages(by_block)
    in_segments = (
        by_block.join(mains, ["media_id", "block"]).where("lang <> main").select(kind("segment"), F.col("media_id").alias("item_key"), F.explode(F.col("positions").cast("array<int>")).alias("seg_idx"), "lang")
    )

    videos = latest(_table(spark, folder, "videos").select("media_id", "subtitle_languages", "fetched_at"), ["media_id"], "fetched_at", ["subtitle_languages"])
    listed = F.coalesce(F.transform("subtitle_languages", lang.named_language), F.array().cast("array<string>"))
    in_videos = (
        videos.join(mains.groupBy("media_id").agg(F.first("main").alias("main")), "media_id").where(~F.coalesce(F.array_contains(F.array_compact(listed), F.col("main")), F.lit(False))).select(kind("video"), F.col("media_id").alias("item_key"), whole, F.col("main").alias("lang"))
    )
    return in_documents.unionByName(in_segments).unionByName(in_videos)


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document and of its parts, with confidences."""
    documents = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return lang.document_languages(documents, lang.fit(documents)).select("doc_id", "detected", "confidence", "parts")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse(_table(spark, folder, "segments"), least=2).select("media_id", "first_seg_idx", "last_seg_idx")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All segments with runs collapsed: count, start, end and duration of each event."""
    return runs.collapse(_table(spark, folder, "segments"))


def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What the runs of each medium add up to: nothing is lost, nothing counted twice."""
    found = runs.collapse(_table(spark, folder, "segments"))
    return found.groupBy("media_id").agg(F.sum("n").cast("long").alias("n"), F.min("first_seg_idx").alias("first"), F.max("last_seg_idx").alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = turns.speaker_turns(_table(spark, folder, "segments"), _table(spark, folder, "speakers"), pause_ms=math.inf, texts=False)
    return found.where("opened_by IN ('label', 'flag')").select("media_id", "seg_idx", "speaker_id")


def p5_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Clean speaker turns of every medium."""
    return turns.speaker_turns(_table(spark, folder, "segments"), _table(spark, folder, "speakers"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leak.leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = reading.fit(_table(spark, folder, "graded_passages"), documents)
    return reading.reading_levels(documents, model, lang.fit(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rebuilt": p1_rebuilt,
    "p3_found": p3_found,
    "p3_languages": p3_languages,
    "p4_found": p4_found,
    "p4_runs": p4_runs,
    "p4_totals": p4_totals,
    "p5_found": p5_found,
    "p5_turns": p5_turns,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

ORACLE: dict[str, str] = {
    "p1_found": """WITH s AS (SELECT media_id, seg_idx, text, row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY ingested_at DESC) AS rn FROM segments),
u AS (SELECT media_id, transcript, row_number() OVER (PARTITION BY media_id ORDER BY created_at DESC) AS rn FROM understand_results)
SELECT 'segment' AS item_kind, media_id, seg_idx FROM s WHERE rn = 1 AND length(text) > (SELECT max_chars FROM split_limits WHERE item_kind = 'segment')
UNION ALL SELECT 'transcript', media_id, -1 FROM u WHERE rn = 1 AND length(transcript) > (SELECT max_chars FROM split_limits WHERE item_kind = 'transcript')""",
    "p1_rebuilt": """WITH s AS (SELECT media_id, seg_idx, text, row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY ingested_at DESC) AS rn FROM segments),
u AS (SELECT media_id, transcript, row_number() OVER (PARTITION BY media_id ORDER BY created_at DESC) AS rn FROM understand_results)
SELECT 'segment' AS item_kind, media_id, seg_idx, md5(text) AS digest, false AS over, length(text) > (SELECT max_chars FROM split_limits WHERE item_kind = 'segment') AS cut FROM s WHERE rn = 1 AND text IS NOT NULL
UNION ALL SELECT 'transcript', media_id, -1, md5(transcript), false, length(transcript) > (SELECT max_chars FROM split_limits WHERE item_kind = 'transcript') FROM u WHERE rn = 1 AND transcript IS NOT NULL""",
    "p4_totals": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY ingested_at DESC) AS rn FROM segments WHERE media_id IS NOT NULL AND seg_idx IS NOT NULL)
SELECT media_id, CAST(count(*) AS BIGINT) AS n, min(seg_idx) AS first, max(seg_idx) AS last, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM s WHERE rn = 1 AND regexp_matches(text, '[\\p{L}\\p{N}_♪♫🎵🎶]') GROUP BY 1""",
}
