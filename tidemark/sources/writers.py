"""Sinks: per-video partitions, append-only logs, checked writes, immutable snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_video(df: DataFrame, path: str) -> None:
    """Replaces the table; one folder per video, committed as a whole."""
    df.write.mode("overwrite").partitionBy("video_id").parquet(path)


def index_table(df: DataFrame, path: str, expected: DataFrame, dim: int = 64) -> None:
    """Writes index rows (video_id, idx, emb_sub, emb_cap) after their gates: lengths, unit norms, one row for every expected (video_id, idx)."""
    def off(c: str):
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return F.coalesce((F.size(c) != dim) | ((norm > 0) & (F.abs(norm - 1) >= 1e-4)), F.lit(False))

    bad = df.where(off("emb_sub") | off("emb_cap")).select("video_id", "idx").take(3)
    key = ["video_id", "idx"]
    gaps = expected.select(*key).distinct().join(df.groupBy(*key).count(), key, "full_outer").where("coalesce(count, 0) <> 1").take(3)
    if bad or gaps:
        raise ValueError(f"index not written: {[tuple(r) for r in bad]} {[tuple(r) for r in gaps]}")
    df.write.mode("overwrite").parquet(path)


def blind_kit(df: DataFrame, key: str, shown: list[str], folder: str, seed: int = 42) -> None:
    """``sheet`` with hashed numbers in place of the key, in hash order, and ``keymap`` from number to key."""
    kit = df.withColumn("blind", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256))
    kit.select("blind", *shown).orderBy("blind").write.mode("errorifexists").option("header", True).csv(f"{folder}/sheet")
    kit.select("blind", key).write.mode("errorifexists").parquet(f"{folder}/keymap")


def with_success(df: DataFrame, path: str, failed: str = "failed") -> bool:
    """Appends a batch of results unless every row of it failed; whether it was written."""
    if df.where(~F.col(failed)).isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


def append_log(df: DataFrame, path: str, drop: tuple[str, ...] = ("per_seg",)) -> None:
    df.drop(*drop).write.mode("append").json(path)


def create_only(df: DataFrame, path: str) -> None:
    """Never overwrites: an existing table stays as it is."""
    df.write.mode("ignore").parquet(path)


def write_then_check(df: DataFrame, path: str, violations) -> None:
    """Writes first, so that the evidence survives, then raises on any violation of what was written."""
    df.write.mode("overwrite").parquet(path)
    bad = violations(df.sparkSession.read.parquet(path)).take(5)
    if bad:
        raise ValueError(f"{path}: {[r.asDict() for r in bad]}")


def content_hash(df: DataFrame, key: list[str]) -> DataFrame:
    """(rows, hash): independent of row order, from the sum and the exclusive or of row hashes."""
    row = F.xxhash64(*[F.to_json(F.struct(*df.columns))])
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.sum(row.cast("decimal(38,0)")).cast("string"), F.bit_xor(row).cast("string")), 256).alias("hash"))


def freeze(df: DataFrame, path: str, key: list[str], violations) -> DataFrame:
    """A validated snapshot that is written once, with a manifest; a later different table is refused."""
    bad = violations(df).take(5)
    if bad:
        raise ValueError(f"not frozen: {[r.asDict() for r in bad]}")
    spark, now = df.sparkSession, content_hash(df, key)
    create_only(df, f"{path}/data")
    create_only(now, f"{path}/manifest")
    kept = spark.read.parquet(f"{path}/manifest").first()
    if kept.hash != now.first().hash:
        raise ValueError("the frozen table differs")
    return spark.read.parquet(f"{path}/data")
