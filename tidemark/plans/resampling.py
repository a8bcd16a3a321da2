"""Bootstraps and permutations with the replicates of the reference.

Units fall into blocks by the hash of their key. How many draws of a replicate fall on each block is a multinomial draw made
once; every block then draws its own units and returns sums per replicate, so no task sees all units and none is numbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.dialect import paired, seg, spark_query
from tidemark.session import cut_lineage

REPLICATES = 2_000
FLIPS = 200_000
ROUNDS = 1_000
BLOCKS = 64
HITS = (1, 5, 10)


def _blocks(df: DataFrame, key: str) -> DataFrame:
    return cut_lineage(df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")))


def _sums(df: DataFrame, key: str, values: list[str], replicates: int, weights) -> DataFrame:
    """(b, n, values): for each replicate the sums of the values, a unit weighted by ``weights(block, units)`` (a row for each replicate)."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(key)
        x = np.column_stack([np.asarray(t[v], dtype=np.float64) for v in values])
        out, n = np.empty((replicates, len(values))), np.empty(replicates)
        for b, w in enumerate(weights(t["block"][0].as_py(), len(x))):
            out[b], n[b] = w @ x, w.sum()
        return pa.table({"b": pa.array(np.arange(replicates)), "n": n} | {v: out[:, i] for i, v in enumerate(values)})

    shape = "b bigint, n double, " + ", ".join(f"{v} double" for v in values)
    return df.groupBy("block").applyInArrow(run, shape).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", *values)])


def bootstrap(df: DataFrame, key: str, values: list[str], seed: int, replicates: int = REPLICATES) -> DataFrame:
    """(b, n, values): sums over as many units as there are, drawn with replacement; one draw for all values."""
    df = _blocks(df, key)
    size = np.zeros(BLOCKS)
    for r in df.groupBy("block").count().collect():
        size[r["block"]] = r["count"]
    share = size / max(1, size.sum())
    times = np.random.default_rng(seed).multinomial(int(size.sum()), share, size=replicates) if size.sum() else np.zeros((replicates, BLOCKS), int)

    def weights(block: int, units: int) -> Iterator[np.ndarray]:
        rng = np.random.default_rng([seed, block])
        for n in times[:, block]:
            yield np.bincount(rng.integers(0, units, n), minlength=units).astype(np.float64)

    return _sums(df, key, values, replicates, weights)


def sign_flips(df: DataFrame, value: str, seed: int, replicates: int = FLIPS) -> DataFrame:
    """(b, value): sums with the sign of every unit drawn.

    Of m units of one size a binomial number keeps its sign, so each size is drawn once a replicate; zeros have no sign.
    """
    sizes = df.select(F.abs(value).alias("d")).where("d > 0").groupBy("d").agg(F.count("*").alias("m"))
    parts = 8

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("d")
        d, m = np.asarray(t["d"]), np.asarray(t["m"])
        rng, out = np.random.default_rng([seed, t["part"][0].as_py()]), np.zeros(replicates)
        for lo in range(0, len(d), 100_000):
            x, n = d[lo:lo + 100_000], m[lo:lo + 100_000]
            step = max(1, 1_000_000 // len(x))
            for b in range(0, replicates, step):
                out[b:b + step] += (2 * rng.binomial(n, 0.5, size=(min(step, replicates - b), len(x))) - n) @ x
        return pa.table({"b": pa.array(np.arange(replicates)), value: out})

    every = df.sparkSession.range(replicates).select(F.col("id").alias("b"), F.lit(0.0).alias(value))
    drawn = sizes.withColumn("part", F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(run, f"b bigint, {value} double")
    return drawn.unionByName(every).groupBy("b").agg(F.sum(value).alias(value))


def interval(x: str) -> list:
    return [F.round(F.expr(f"percentile({x}, 0.025)"), 4), F.round(F.expr(f"percentile({x}, 0.975)"), 4)]


def _queries_of(spark: SparkSession, d: str) -> DataFrame:
    hits = ", ".join(f"CAST(k1 BETWEEN 1 AND {k} AS INT) - CAST(k0 BETWEEN 1 AND {k} AS INT) AS hit{k}" for k in HITS)
    return spark_query(lambda D: f"WITH {paired(D)} SELECT query_id, m1 - m0 AS mrr, {hits} FROM rr")(spark, d)


def _videos_of(spark: SparkSession, d: str) -> DataFrame:
    return spark_query(lambda D: f"""WITH {paired(D)} SELECT video_id, sum(m1 - m0) AS s, count(*) AS c, avg(m1 - m0) AS mean FROM rr GROUP BY
        video_id""")(spark, d)


def b1_paired_bootstrap_full(spark: SparkSession, d: str) -> DataFrame:
    """(metric, lo, hi, mean): the difference of every metric, all on the same draws."""
    metrics = ["mrr", *(f"hit{k}" for k in HITS)]
    sums = bootstrap(_queries_of(spark, d), "query_id", metrics, 42)
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) / F.col("n")).alias("m")) for m in metrics])).alias("x")).select("x.*")
    lo, hi = interval("m")
    return long.groupBy("metric").agg(lo.alias("lo"), hi.alias("hi"), F.round(F.avg("m"), 6).alias("mean"))


def b4_cluster_bootstrap_full(spark: SparkSession, d: str) -> DataFrame:
    m = bootstrap(_videos_of(spark, d), "video_id", ["s", "c", "mean"], 7).select((F.col("s") / F.col("c")).alias("w"), (F.col("mean") / F.col("n")).alias("macro"))
    (w_lo, w_hi), (m_lo, m_hi) = interval("w"), interval("macro")
    return m.agg(w_lo.alias("w_lo"), w_hi.alias("w_hi"), m_lo.alias("macro_lo"), m_hi.alias("macro_hi"))


def b5_bootstrap_p_full(spark: SparkSession, d: str) -> DataFrame:
    m = bootstrap(_videos_of(spark, d), "video_id", ["s", "c"], 9).select((F.col("s") / F.col("c")).alias("w"))
    side = F.least(F.avg((F.col("w") <= 0).cast("int")), F.avg((F.col("w") >= 0).cast("int")))
    return m.agg(F.round(F.greatest(1 / F.nullif(F.count("*"), F.lit(0)), F.least(F.lit(1.0), 2 * side)), 6).alias("p"))


def b6_sign_flip_full(spark: SparkSession, d: str) -> DataFrame:
    units = cut_lineage(_queries_of(spark, d).select("query_id", "mrr"))
    m = sign_flips(units, "mrr", 11).crossJoin(units.agg(F.abs(F.sum("mrr")).alias("obs"), F.count("*").alias("n")).where("n > 0"))
    return m.agg(F.round(F.avg((F.abs("mrr") / F.col("n") >= F.col("obs") / F.col("n") - 1e-12).cast("int")), 6).alias("p"))


def b12_ratio_bootstrap_full(spark: SparkSession, d: str) -> DataFrame:
    units = spark_query(lambda D: f"""WITH {seg(D)} SELECT video_id, sum(length(coalesce(sub, ''))) AS s, sum(length(coalesce(cap, ''))) AS c
        FROM seg GROUP BY video_id""")(spark, d)
    m = bootstrap(units, "video_id", ["s", "c"], 5).select((F.col("s") / F.nullif(F.col("c"), F.lit(0.0))).alias("r"))
    lo, hi = interval("r")
    return m.agg(lo.alias("lo"), hi.alias("hi"))


def permuted_purity(pairs: DataFrame, owner: str, label: str, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """(mean, p95, max, rounds) of the purity of the owners' labels when all labels are shuffled among all rows.

    Only the owners' sizes and the labels' totals matter: each block gets its labels by a hypergeometric draw made once a round.
    """
    labels = sorted(r["count"] for r in pairs.groupBy(label).count().collect())
    sizes = _blocks(pairs.groupBy(owner).agg(F.count("*").alias("n")), owner)
    size = np.zeros(BLOCKS, np.int64)
    for r in sizes.groupBy("block").agg(F.sum("n").alias("n")).collect():
        size[r["block"]] = r["n"]
    counted = int(sizes.where("n >= 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rng = np.random.default_rng(seed)
    # counts[round, block, label]; the marginals method takes any number of rows.
    counts = np.zeros((rounds, BLOCKS, len(labels)), np.int64)
    for b in range(rounds):
        left = np.array(labels, np.int64)
        for block in range(BLOCKS):
            counts[b, block] = rng.multivariate_hypergeometric(left, size[block], method="marginals")
            left -= counts[b, block]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), (owner, "ascending")])
        n, block = np.asarray(t["n"]), t["block"][0].as_py()
        draw, top = np.random.default_rng([seed, block]), np.zeros(rounds, np.int64)
        large = int((n > 2_000).sum())
        small = n[large:]
        place = np.repeat(np.arange(len(small)), small) * len(labels)
        for b in range(rounds):
            left = counts[b, block].copy()
            for m in n[:large]:
                got = draw.multivariate_hypergeometric(left, m, method="marginals")
                left -= got
                top[b] += got.max()
            dealt = np.repeat(np.arange(len(labels)), left)
            draw.shuffle(dealt)
            each = np.bincount(place + dealt, minlength=len(small) * len(labels)).reshape(len(small), len(labels))
            top[b] += each[small >= 2].max(axis=1, initial=0).sum() if len(small) else 0
        return pa.table({"b": pa.array(np.arange(rounds)), "top": top})

    purity = sizes.groupBy("block").applyInArrow(run, "b bigint, top bigint").groupBy("b").agg(F.sum("top").alias("top")) \
        .select(F.round(F.col("top") / F.lit(max(1, counted)), 4).alias("p")).where(F.lit(counted > 0))
    return purity.agg(F.round(F.avg("p"), 4).alias("mean"), F.sort_array(F.collect_list("p")).alias("all"), F.max("p").alias("max"), F.count("*").alias("rounds")) \
        .select("mean", F.get("all", (F.col("rounds") * 0.95).cast("int")).alias("p95"), "max", "rounds")


def b14_purity_chance_full(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark_query(lambda D: f"WITH {seg(D)} SELECT video_id, arm FROM seg")(spark, d)
    return permuted_purity(cut_lineage(pairs), "video_id", "arm", 3)


QUERIES = {f.__name__: f for f in (b1_paired_bootstrap_full, b4_cluster_bootstrap_full, b5_bootstrap_p_full, b6_sign_flip_full, b12_ratio_bootstrap_full, b14_purity_chance_full)}
