"""Queries of the text expressions on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.plans.dialect import Dialect, corrupted
from tidemark.sources.tables import table


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("video_id", "idx", "caption").distinct()


def f13_clear_corrupted(spark: SparkSession, d: str) -> DataFrame:
    return _captions(spark, d).select("video_id", "idx", F.when(X.is_corrupted_caption(F.col("caption")), "").otherwise(F.col("caption")).alias("caption"))


def proj_p14_display_clean(spark: SparkSession, d: str) -> DataFrame:
    return _captions(spark, d).select("video_id", "idx", X.display_clean(F.col("caption")).alias("caption"))


def x5_parse_events(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("Answer: "), F.to_json(F.array(F.struct("event", "span", F.col("seg_idx").alias("evidence_segments"), F.col("event").alias("description")))), F.lit(" end"))
    rows = table(spark, d, "frozen_kheritage_grave_excavation").select("video_id", "event_no", X.parse_events(made).alias("e"))
    return rows.select("video_id", "event_no", F.explode("e").alias("e")).select("video_id", "event_no", "e.event", "e.span").distinct()


def x6_verdicts(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit('{"match": false} {"match": '), (F.size("cites") > 1).cast("string"), F.lit("}"))
    return table(spark, d, "report").select("report_id", "sent_id", X.last_verdict(answer).alias("verdict")).distinct()


QUERIES = {f.__name__: f for f in (f13_clear_corrupted, proj_p14_display_clean, x5_parse_events, x6_verdicts)}
# Written apart from the column expressions: what they must give back on these inputs.
SQL: dict[str, str] = {
    "f13_clear_corrupted": f"SELECT DISTINCT video_id, idx, CASE WHEN {corrupted(Dialect(False), 'caption')} THEN '' ELSE caption END AS caption FROM segments",
    "x5_parse_events": "SELECT DISTINCT video_id, event_no, event, span FROM frozen_kheritage_grave_excavation",
    "x6_verdicts": "SELECT DISTINCT report_id, sent_id, coalesce(len(cites) > 1, false) AS verdict FROM report",
}
