"""Search and evaluation with the search itself as a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (queries, index, alpha) -> (query_id, idx, rank): what an evaluation asks of a search.
Search = Callable[[DataFrame, DataFrame, float], DataFrame]


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _z(c: str, w) -> Column:
    sd = F.stddev_pop(c).over(w)
    return F.when(sd < 1e-9, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / sd)


def fused_search(queries: DataFrame, index: DataFrame, alpha: float) -> DataFrame:
    """queries(query_id, video_id, v) against index(video_id, idx, es, ec, mask) of their own videos; unit vectors.

    Both channels are normalised per query, then static rows take the subtitle's score for the caption's. A null vector scores 0.
    """
    w = Window.partitionBy("query_id")
    s = queries.select("query_id", "video_id", "v").join(index, "video_id").select(
        "query_id", "idx", "mask", F.coalesce(_dot("es", "v"), F.lit(0.0)).alias("ss"), F.coalesce(_dot("ec", "v"), F.lit(0.0)).alias("sp"))
    zs, zp = _z("ss", w), _z("sp", w)
    fused = s.select("query_id", "idx", F.round(alpha * zs + (1 - alpha) * F.when(F.coalesce("mask", F.lit(False)), zs).otherwise(zp), 8).alias("score"))
    return fused.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "idx")))


def caption_search(queries: DataFrame, index: DataFrame, alpha: float) -> DataFrame:
    return fused_search(queries, index, 0.0)


def per_query(queries: DataFrame, index: DataFrame, alpha: float, search: Search = fused_search, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query_id, video_id, type, rank, mrr, hit_k ...): one row for each query; rank 0 and zeros where no true segment comes out."""
    ranked = search(queries, index, alpha)
    truth = queries.select("query_id", F.explode("gt_seg_idx").alias("idx")).distinct()
    first = ranked.join(truth, ["query_id", "idx"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = queries.select("query_id", "video_id", "type").join(first, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    hits = [((F.col("rank") > 0) & (F.col("rank") <= k)).cast("double").alias(f"hit_{k}") for k in ks]
    return rows.select("*", F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0).alias("mrr"), *hits)


def evaluate(queries: DataFrame, index: DataFrame, alpha: float, search: Search = fused_search, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Means of the metrics overall (type null) and per type, in one pass; no queries are an error."""
    if queries.isEmpty():
        raise ValueError("no queries")
    names = ["mrr", *[f"hit_{k}" for k in ks]]
    sets = per_query(queries, index, alpha, search, ks).groupingSets([[], ["type"]], "type")
    return sets.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in names])


def with_prefix(search: Search, embed: Callable[[DataFrame], DataFrame], prefix: str) -> Search:
    """A search whose queries are embedded anew with a prefix before their text; the given search itself stays as it is."""
    def run(queries: DataFrame, index: DataFrame, alpha: float) -> DataFrame:
        return search(embed(queries.withColumn("text", F.concat(F.lit(prefix), F.col("text")))), index, alpha)

    return run


def pooled(search: Search, variants: DataFrame) -> Search:
    """Searches every variant(query_id, variant, v) of a query and keeps each segment's best score."""
    def run(queries: DataFrame, index: DataFrame, alpha: float) -> DataFrame:
        many = queries.drop("v").join(variants, "query_id").withColumn("own", F.col("query_id")) \
            .withColumn("query_id", F.concat_ws("\x1f", "query_id", F.col("variant").cast("string")))
        found = search(many, index, alpha).join(many.select("query_id", "own"), "query_id")
        best = found.groupBy(F.col("own").alias("query_id"), "idx").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")))

    return run
