"""The pN_ queries over the project's tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, leakage, mojibake, neighbours, splits, tokenizer, truncation
from tidemark.sources.tables import table

VIDEO_KEYS = ["channel_id", "source_id", "file_sha256"]
CHANNELS = {"sub": "emb_sub", "cap": "emb_cap"}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.records(table(spark, d, "segments"), table(spark, d, "report"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_texts(spark, d)).select("rec_table", "rec_key").distinct()


def p1_source_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d)
    return truncation.source_shares(rows, truncation.truncated(rows))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped(table(spark, d, "queries_dev_only"), table(spark, d, "videos"), "query_id", "video_id", VIDEO_KEYS, "split")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(_groups(spark, d), table(spark, d, "split_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).where("torn").select(F.col("record").alias("query_id"))


def p2_assigned(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select(F.col("record").alias("query_id"), "split")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.shares(_assigned(spark, d), table(spark, d, "split_targets"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segments")
    rows = segments.select("video_id", "idx", "caption", language.label_language(F.col("caption_lang")).alias("label"))
    return language.stretches(rows, language.fit(segments), ["video_id", "idx", "label"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return language.corrections(_labelled(spark, d)).select("video_id", "idx", "lang").distinct()


def p4_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("video_id", "idx", "part", "lang", F.round("confidence", 6).alias("confidence"), "stretch").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.similar_pairs(table(spark, d, "videoindex"), CHANNELS)
    return neighbours.mutual(pairs).select("channel", "vec_a", "vec_b")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.all_nearest(table(spark, d, "videoindex"), CHANNELS).withColumnRenamed("id", "vec_id")


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 100, searched in the graphs over all vectors."""
    return neighbours.all_nearest(table(spark, d, "videoindex"), CHANNELS, slack=0.25, shard_rows=2_000, every=100, ef=neighbours.EF_WIDE) \
        .withColumnRenamed("id", "vec_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    """Also passages with one word changed, put in or left out, in windows of five words and more."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), max_edits=1)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The unedited ones of all passages."""
    return p7_edited(spark, d).where("edits = 0").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.fitted_repairs(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("doc_id").distinct()


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where(F.size("chains") > 0).select("doc_id", "restored", "chains", "lost")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_source_shares, p2_found, p2_assigned, p2_shares, p4_found, p4_stretches, p5_found, p5_neighbours, p5_search, p6_ids, p7_found, p7_leaked_items, p7_edited,
        p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    missing = ", ".join(f"'{m}'" for m in splits.MISSING)
    trim = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
    node = "nullif(regexp_replace(lower(" + trim.format("video_id") + r"), '\.[a-z][a-z0-9]{1,4}$', ''), '')"
    keys = " UNION ".join(
        f"SELECT {node} AS node, '{k}' AS kind, {trim.format(k)} AS val FROM videos "
        rf"WHERE regexp_matches({trim.format(k)}, '[\p{{L}}\p{{N}}]') AND lower({trim.format(k)}) NOT IN ({missing})" for k in VIDEO_KEYS)
    p2 = f"""
WITH RECURSIVE k AS ({keys}),
links AS (SELECT DISTINCT x.node AS a, y.node AS b FROM k x JOIN k y ON x.kind = y.kind AND x.val = y.val WHERE x.node IS NOT NULL AND y.node IS NOT NULL),
reach(a, b) AS (SELECT DISTINCT {node}, {node} FROM videos WHERE {node} IS NOT NULL
                UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
q AS (SELECT DISTINCT query_id, {node} AS node, nullif(lower({trim.format('split')}), '') AS split FROM queries_dev_only WHERE query_id IS NOT NULL),
g AS (SELECT query_id, split, coalesce(component, '?' || q.node) AS component FROM q LEFT JOIN comp ON q.node = comp.node WHERE q.node IS NOT NULL),
bad AS (SELECT component FROM g GROUP BY component HAVING count(DISTINCT split) > 1)
SELECT DISTINCT query_id FROM g JOIN bad USING (component)"""
    return {"p2_found": p2, "p2_shares": "SELECT DISTINCT split, true AS within FROM split_targets"}
