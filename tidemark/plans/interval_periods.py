"""p3: continuous periods and gaps of the event inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import periods
from tidemark.sources.tables import table

INVENTORY = "frozen_kheritage_grave_excavation"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.gaps(table(spark, d, INVENTORY), "video_id", "start_sec", "end_sec").select(
        F.col("e").alias("video_id"), F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods.periods(table(spark, d, INVENTORY), "video_id", "start_sec", "end_sec").select(
        F.col("e").alias("video_id"), F.col("period_start").alias("period_start_ms"), F.col("period_end").alias("period_end_ms"))


QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods}

_ROWS = f"""
WITH r AS (SELECT DISTINCT video_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS t
           FROM {INVENTORY} WHERE video_id IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL),
m AS (SELECT video_id, s, t, max(t) OVER (PARTITION BY video_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM r WHERE t > s)"""

SQL = {
    "p3_found": _ROWS + " SELECT video_id, before AS gap_start_ms, s AS gap_end_ms FROM m WHERE s > before",
    "p3_periods": _ROWS + """,
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT video_id, min(s) AS period_start_ms, max(t) AS period_end_ms FROM n GROUP BY video_id, part""",
}
