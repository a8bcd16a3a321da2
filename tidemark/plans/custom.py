"""Queries of operators beyond built-in expressions; where a check in SQL isn't possible they are tested on fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import matching
from tidemark.plans import texts
from tidemark.plans.dialect import Dialect
from tidemark.session import cut_lineage
from tidemark.sources.tables import table

INVENTORY = "frozen_kheritage_grave_excavation"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, INVENTORY).select("video_id", F.col("event_no").alias("no"), F.get("span", F.lit(0)).alias("a"), F.get("span", F.lit(1)).alias("b")) \
        .where("video_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").distinct()


def j9_match_events(spark: SparkSession, d: str) -> DataFrame:
    """Odd against even events of the inventory; the sum of IoU per video is unique, the pairs need not be."""
    s = _spans(spark, d)
    found = matching.match_events(s.where("no % 2 = 1"), s.where("no % 2 = 0"))
    return found.groupBy("video_id").agg(F.round(F.sum("iou"), 6).alias("total_iou"), F.count("*").alias("pairs"))


def a10_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Mean IoU and recall at three thresholds over the reference events; unmatched ones count 0."""
    s = _spans(spark, d)
    refs = s.where("no % 2 = 1")
    found = matching.match_events(refs, s.where("no % 2 = 0")).withColumnRenamed("ref", "no")
    j = refs.join(found, ["video_id", "no"], "left").withColumn("v", F.coalesce("iou", F.lit(0.0)))
    return j.groupBy("video_id").agg(F.round(F.avg("v"), 6).alias("alignment"),
                                     *[F.round(F.avg((F.col("v") >= t).cast("double")), 6).alias(f"recall_{int(t * 10)}") for t in (0.3, 0.5, 0.7)])


def x11_substring_distance(spark: SparkSession, d: str) -> DataFrame:
    """Event names against the subtitles of their windows."""
    e = table(spark, d, INVENTORY).where("event IS NOT NULL AND seg_idx IS NOT NULL").select("video_id", "event_no", "event", F.explode("seg_idx").alias("idx")).distinct()
    s = table(spark, d, "segments").where("subtitle IS NOT NULL").select("video_id", "idx", "subtitle").distinct()
    return e.join(s, ["video_id", "idx"]).select("video_id", "event_no", "idx", F.round(matching.approx_substring("event", "subtitle"), 6).alias("distance"))


def a23_word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Captions against the caption before them, per source."""
    w = Window.partitionBy("video_id").orderBy("idx")
    s = table(spark, d, "segments").select("video_id", "idx", "caption", "caption_arm").distinct()
    p = s.withColumn("ref", F.lag("caption").over(w)).where("caption IS NOT NULL AND ref IS NOT NULL AND trim(ref) <> ''")
    n = F.size(F.split(F.trim("ref"), r"\s+"))
    return p.groupBy("caption_arm").agg(F.round(F.avg(matching.word_errors("ref", "caption") / n), 6).alias("wer"))


def a24_chrf(spark: SparkSession, d: str) -> DataFrame:
    """Captions against the caption before them, white space left out."""
    s = table(spark, d, "segments").groupBy("video_id", "idx").agg(F.regexp_replace(F.max("caption"), texts.BLANK, "").alias("cap"))
    p = s.withColumn("ref", F.lag("cap").over(Window.partitionBy("video_id").orderBy("idx"))).where("cap <> '' AND ref <> ''")
    return p.select("video_id", "idx", F.round(matching.chrf("ref", "cap"), 6).alias("f2"))


def b15_grouped_auc(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression on segment features in three folds of videos, AUC by rank sums on the held-out fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    s = table(spark, d, "segments").groupBy("video_id", "idx").agg(F.max("motion_score").alias("m"), F.max("is_static").alias("still"), F.max(F.length("subtitle")).alias("n"))
    s = s.where("m IS NOT NULL AND still IS NOT NULL").select(
        "video_id", "idx", F.col("still").cast("double").alias("label"), F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("n"), (F.col("idx") % 12).cast("double").alias("i"),
        F.pmod(F.crc32(F.col("video_id").cast("binary")), F.lit(3)).alias("fold"))
    s = cut_lineage(s)  # read once for each fold
    s = VectorAssembler(inputCols=["n", "i"], outputCol="features").transform(s)
    parts = []
    for fold in range(3):
        train = s.where(F.col("fold") != fold)
        if train.select("label").distinct().count() < 2:
            continue
        model = LogisticRegression(maxIter=20).fit(train)
        parts.append(model.transform(s.where(F.col("fold") == fold)).select("fold", "label", F.round(vector_to_array("probability")[1], 6).alias("p")))
    if not parts:
        return spark.createDataFrame([], "fold int, auc double")
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    # Rank sums from counts per distinct score, ties at half.
    g = scored.groupBy("fold", "p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    w = Window.partitionBy("fold").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    return g.groupBy("fold").agg(F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0)), 6).alias("auc"))


def _distances(spark: SparkSession, d: str, decoy: bool = False) -> DataFrame:
    """(video_id, event_no, target, tokens, sub, cap, sub_free, cap_free): an event's name against the two texts of its windows, the least of them.

    The free distances leave numbers out; a target of numbers only keeps its own. As a decoy an event has the name of the next
    of its video by hash, unless one name contains the other.
    """
    e = table(spark, d, INVENTORY).where("trim(event) <> '' AND seg_idx IS NOT NULL").select("video_id", "event_no", F.col("event").alias("target"), F.explode("seg_idx").alias("idx")).distinct()
    if decoy:
        names = e.select("video_id", "event_no", "target").distinct()
        order = Window.partitionBy("video_id").orderBy(F.xxhash64("video_id", "event_no", "target"), "event_no")
        other = names.withColumn("other", F.lead("target").over(order)).where(
            F.col("other").isNotNull() & ~F.contains("other", "target") & ~F.contains("target", "other"))
        e = e.join(other, ["video_id", "event_no", "target"]).select("video_id", "event_no", F.col("other").alias("target"), "idx")
    s = table(spark, d, "segments").groupBy("video_id", "idx").agg(F.max("subtitle").alias("sub"), F.max("caption").alias("cap"))
    bare = lambda c: F.trim(F.regexp_replace(c, "[0-9]+", ""))
    j = e.join(s, ["video_id", "idx"]).withColumn("free", F.when(bare("target") != "", bare("target")).otherwise(F.col("target")))
    j = j.withColumn("sub_bare", bare("sub")).withColumn("cap_bare", bare("cap"))
    made = j.select("video_id", "event_no", "target", *[matching.approx_substring(t, h).alias(n) for t, h, n in (
        ("target", "sub", "s"), ("target", "cap", "c"), ("free", "sub_bare", "sf"), ("free", "cap_bare", "cf"))])
    return made.groupBy("video_id", "event_no", "target").agg(
        *[F.round(F.min(a), 6).alias(b) for a, b in (("s", "sub"), ("c", "cap"), ("sf", "sub_free"), ("cf", "cap_free"))]) \
        .withColumn("tokens", F.size(F.split(F.trim("target"), r"\s+")))


def a63_distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d)


def a64_pooled_block(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance and share of hits of both texts, by names of one and of more words, where both texts are there."""
    rows = _distances(spark, d).where("sub IS NOT NULL AND cap IS NOT NULL").withColumn("many", F.col("tokens") > 1)
    return rows.groupBy("many").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("sub", "cap")],
                                    *[F.round(F.avg((F.col(c) == 0).cast("double")), 6).alias(f"{c}_hit") for c in ("sub", "cap")])


def a25_attempted(spark: SparkSession, d: str, near: float = 0.34) -> DataFrame:
    """Among the names that either text comes near to: hits and near hits of each, and how often only one of them has it."""
    rows = _distances(spark, d).where(F.least(F.coalesce("sub", F.lit(1.0)), F.coalesce("cap", F.lit(1.0))) <= near)
    hit = {c: F.coalesce(F.col(c) <= near, F.lit(False)) for c in ("sub", "cap")}
    return rows.groupBy((F.col("tokens") > 1).alias("many")).agg(
        F.count("*").alias("attempted"), *[F.round(F.avg(F.coalesce(F.col(c) == 0, F.lit(False)).cast("double")), 6).alias(f"{c}_hit") for c in hit],
        *[F.round(F.avg(h.cast("double")), 6).alias(f"{c}_near") for c, h in hit.items()],
        F.count_if(hit["sub"] & ~hit["cap"]).alias("only_sub"), F.count_if(hit["cap"] & ~hit["sub"]).alias("only_cap"))


def a26_decoy_correction(spark: SparkSession, d: str, near: float = 0.34) -> DataFrame:
    """Per text the share of names that come near, that of decoys in the same windows, their mean distance, and the share without chance."""
    def rates(decoy: bool, suffix: str) -> DataFrame:
        long = _distances(spark, d, decoy).select(F.expr("stack(2, 'subtitle', sub, 'caption', cap) AS (arm, distance)")).where("distance IS NOT NULL")
        return long.groupBy("arm").agg(F.count("*").alias(f"n{suffix}"), F.avg((F.col("distance") <= near).cast("double")).alias(f"near{suffix}"),
                                       F.avg((F.col("distance") == 0).cast("double")).alias(f"hit{suffix}"), F.avg("distance").alias(f"mean{suffix}"))

    j = rates(False, "").join(rates(True, "_decoy"), "arm")
    r = lambda c: F.round(c, 6)
    return j.select("arm", "n", r("near").alias("near"), "n_decoy", r("near_decoy").alias("near_decoy"), r("hit_decoy").alias("hit_decoy"), r("mean_decoy").alias("mean_decoy"),
                    r(F.col("near") - F.col("near_decoy")).alias("corrected"), r(F.col("hit") - F.col("hit_decoy")).alias("corrected_hit"))


def a43_pooled_events(spark: SparkSession, d: str) -> DataFrame:
    """All reference events with equal weight, whatever their video."""
    s = _spans(spark, d)
    refs = s.where("no % 2 = 1")
    found = matching.match_events(refs, s.where("no % 2 = 0")).withColumnRenamed("ref", "no")
    v = F.coalesce("iou", F.lit(0.0))
    return refs.join(found, ["video_id", "no"], "left").agg(F.count("*").alias("events"), F.round(F.avg(v), 6).alias("alignment"),
                                                            *[F.round(F.avg((v >= t).cast("double")), 6).alias(f"recall_{int(t * 10)}") for t in (0.3, 0.5, 0.7)])


def proj_p7_search_response(spark: SparkSession, d: str) -> DataFrame:
    """The three best windows of every query as they are shown: whole seconds, three decimals, cleaned texts."""
    from tidemark.functions import text as X
    from tidemark.plans import search

    top = search.QUERIES["v6_fused_search"](spark, d).where("rank <= 3")
    s = table(spark, d, "segments").groupBy("video_id", "idx").agg(*[F.max(c).alias(c) for c in ("start_sec", "end_sec", "subtitle", "caption")])
    return top.join(s, ["video_id", "idx"], "left").select(
        "query_id", "rank", "idx", F.col("start_sec").cast("int").alias("start"), F.col("end_sec").cast("int").alias("end"), F.round("score", 3).alias("score"),
        X.display_clean(F.col("subtitle")).alias("subtitle"), X.display_clean(F.col("caption")).alias("caption"))


QUERIES = {f.__name__: f for f in (j9_match_events, a10_alignment, x11_substring_distance, a23_word_error_rate, a24_chrf, a25_attempted, a26_decoy_correction, a43_pooled_events, a63_distance_matrix, a64_pooled_block, proj_p7_search_response, b15_grouped_auc)}
SQL: dict[str, str] = {"a24_chrf": texts.chrf(Dialect(False))}
