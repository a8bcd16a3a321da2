"""Splits that keep related records together: components, then largest-differencing balance.

Components. Videos that share a present value of a key belong together, also through further
videos. Every key value links its videos to a deputy for each hash part (``DEPUTIES`` parts at least,
one for ``PART_ROWS`` rows of the table) and the deputies to one representative, so no value's links
meet in one place, whatever share of the rows carries it. The smallest label then
spreads over the links by grouped minima, with pointer jumping (a label is replaced by the
label's own label), until nothing changes; each round's labels are checkpointed.

Balance. The weights of the components are balanced into many equal bins by multiway largest
differencing: each weight starts as a tuple of bins with one filled; the two tuples of the widest
spread are combined, the fullest bin of one with the emptiest of the other, until one tuple is left.
This runs in hash buckets of about ``BUCKET_ROWS`` components; the buckets' tuples are combined in
the same way, ``FAN_IN`` at a time. Whole bins then go to the split that misses its share by most.
A group is ``torn`` if its records carry two or more splits at present; the assignment says so beside
the split that mends it.

Defined results: missing key values, however spelled, relate nothing; identifiers are compared
without case, surrounding blanks and file ending; a record of an unknown entity forms its own group,
one of a null or blank entity belongs to none; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

DEPUTIES = 64
PART_ROWS = 100_000
BINS = 64
BUCKET_ROWS = 20_000
FAN_IN = 64

# Spellings of a missing value, after trimming and lower-casing.
MISSING = ("unknown", "n/a", "na", "none", "null", "nil", "nan", "pending", "tbd", "todo", "missing", "undefined",
           "unspecified", "not available", "not known", "unk", "미상", "없음")


def entity_id(c: Column) -> Column:
    """An identifier without case, surrounding blanks and file ending; null if blank."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")), r"\.[a-z][a-z0-9]{1,4}$", "")
    return F.when(plain != "", plain)


def present(c: Column) -> Column:
    """A key value without surrounding blanks, null where it is a spelling of "missing"."""
    plain = F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")
    return F.when(plain.rlike(r"[\p{L}\p{N}]") & ~F.lower(plain).isin(*MISSING), plain)


def split_name(c: Column) -> Column:
    plain = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(plain != "", plain)


def components(entities: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """(node, component): the smallest node of each node's component."""
    rows = entities.select(entity_id(F.col(entity)).alias("node"), *[present(F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)]) \
        .where(F.col("node").isNotNull())
    values = rows.select("node", F.explode(F.array(*[
        F.struct(F.lit(i).alias("kind"), F.col(f"k{i}").alias("value")) for i in range(len(keys))])).alias("k")) \
        .select("node", "k.kind", "k.value").where(F.col("value").isNotNull()).distinct()
    part = F.pmod(F.xxhash64("node"), F.lit(max(DEPUTIES, entities.count() // PART_ROWS)))
    parts = values.groupBy("kind", "value", part.alias("part")).agg(F.min("node").alias("deputy"))
    heads = parts.groupBy("kind", "value").agg(F.min("deputy").alias("head"), F.count("*").alias("n"))
    up = parts.join(heads, ["kind", "value"]).select(F.col("deputy").alias("a"), F.col("head").alias("b"))
    down = values.withColumn("part", part).join(parts, ["kind", "value", "part"]).select(F.col("node").alias("a"), F.col("deputy").alias("b"))
    one_way = up.unionByName(down).where("a <> b").distinct()
    links = cut_lineage(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(rows.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        # The smallest label among the neighbours of every node.
        best = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("component").alias("offer"))
        nearer = labels.join(best, labels.node == best.a, "left").select(
            "node", F.col("component").alias("before"), F.least("component", F.coalesce("offer", "component")).alias("component"))
        # Labels that have a smaller label themselves (roots have none, so large components don't meet here).
        jump = nearer.where("component <> node").select(F.col("node").alias("label"), F.col("component").alias("further"))
        now = nearer.join(jump, nearer.component == jump.label, "left").select(
            "node", "before", F.coalesce("further", "component").alias("component"))
        now = cut_lineage(now)
        if now.where("before <> component").isEmpty():
            return now.select("node", "component")
        labels = now.select("node", "component")


def grouped(records: DataFrame, entities: DataFrame, record: str, entity: str, keys: list[str], split: str) -> DataFrame:
    """(record, split, component): the distinct records of known groups; split null where it is none."""
    found = components(entities, entity, keys)
    own = records.select(F.col(record).alias("record"), entity_id(F.col(entity)).alias("node"), split_name(F.col(split)).alias("split")) \
        .where(F.col("record").isNotNull() & F.col("node").isNotNull()).distinct()
    return own.join(found, "node", "left").select("record", "split", F.coalesce("component", F.concat(F.lit("?"), "node")).alias("component"))


def difference(tuples: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest differencing: (loads of the bins, for each tuple the bin that each of its places went to)."""
    k = len(tuples[0])
    heap, place = [], {}
    for i, t in enumerate(tuples):
        heap.append((-(t.max() - t.min()), i, t))
        place[i] = [(i, np.arange(k))]
    heapq.heapify(heap)
    # Merged tuples keep a tree of permutations; they are composed at the end.
    parent: dict[int, tuple[int, np.ndarray]] = {}
    fresh = len(tuples)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        up, down = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        total = a[up] + b[down]
        to_a, to_b = np.empty(k, np.int64), np.empty(k, np.int64)
        to_a[up] = np.arange(k)
        to_b[down] = np.arange(k)
        parent[i], parent[j] = (fresh, to_a), (fresh, to_b)
        heapq.heappush(heap, (-(total.max() - total.min()), fresh, total))
        fresh += 1
    root = heap[0][1]
    known: dict[int, np.ndarray] = {root: np.arange(k)}
    for node in range(fresh - 2, -1, -1):  # parents have larger numbers
        if node in parent:
            up_node, perm = parent[node]
            known[node] = known[up_node][perm]
    return heap[0][2], [known[i] for i in range(len(tuples))]


def bins_of(weights: DataFrame, bins: int = BINS, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """weights(component, weight) -> (component, bin, weight): many nearly equal bins."""
    count = weights.count()
    buckets = max(1, math.ceil(count / bucket_rows))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True])
        tuples = []
        for w in pdf["weight"].to_numpy(dtype=float):
            t = np.zeros(bins)
            t[0] = w
            tuples.append(t)
        _, where = difference(tuples)
        return pd.DataFrame({"component": pdf["component"], "weight": pdf["weight"], "bucket": pdf["bucket"], "bin": [int(p[0]) for p in where]})

    placed = weights.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int"))
    placed = cut_lineage(placed.groupBy("bucket").applyInPandas(first, "component string, weight double, bucket int, bin int"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        tuples, names = [], sorted(pdf["bucket"].unique())
        for n in names:
            own = pdf[pdf["bucket"] == n]
            t = np.zeros(bins)
            t[own["bin"].to_numpy()] = own["load"].to_numpy()
            tuples.append(t)
        _, where = difference(tuples)
        return pd.DataFrame([(n, b, int(names[0]) // fan_in, int(p[b])) for n, p in zip(names, where) for b in range(bins)],
                            columns=["bucket", "bin", "to_bucket", "to_bin"]).astype("int32")

    while buckets > 1:
        loads = placed.groupBy("bucket", "bin").agg(F.sum("weight").alias("load"))
        moved = loads.groupBy((F.col("bucket") / fan_in).cast("int").alias("g")).applyInPandas(
            lambda pdf: merge(pdf), "bucket int, bin int, to_bucket int, to_bin int")
        placed = cut_lineage(placed.join(moved, ["bucket", "bin"]).select(
            "component", "weight", F.col("to_bucket").alias("bucket"), F.col("to_bin").alias("bin")))
        buckets = math.ceil(buckets / fan_in)
    return placed.select("component", "bin", "weight")


def assign(groups: DataFrame, targets: DataFrame, bins: int = BINS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(record, component, split, torn): every record gets its group's split, near the shares of targets(split, share)."""
    # Rows of one record with different splits count once in the weight.
    records = groups.groupBy("component", "record").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    weights = cut_lineage(records.groupBy("component").agg(
        F.count("*").cast("double").alias("weight"), F.coalesce(F.min("lo") < F.max("hi"), F.lit(False)).alias("torn")))
    placed = bins_of(weights.select("component", "weight"), bins, bucket_rows)
    loads = placed.groupBy("bin").agg(F.sum("weight").alias("load")).collect()  # ``bins`` rows
    shares = {r.split: float(r.share) for r in targets.select("split", "share").distinct().collect()}
    total = sum(r.load for r in loads)
    missing = {s: p / sum(shares.values()) * total for s, p in shares.items()}
    chosen = []
    for r in sorted(loads, key=lambda r: (-r.load, r.bin)):
        s = max(sorted(missing), key=lambda s: missing[s])
        missing[s] -= r.load
        chosen.append((r.bin, s))
    to = groups.sparkSession.createDataFrame(chosen, "bin int, split string")
    whole = placed.join(F.broadcast(to), "bin").select("component", "split").join(weights.select("component", "torn"), "component")
    return records.select("record", "component").join(whole, "component").select("record", "component", "split", "torn")


def shares(assigned: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """(split, within): whether a split's share of the records misses its target by no more than a bin and the largest group."""
    every = assigned.select("record", "component", "split").distinct()
    largest = every.groupBy("component").count().agg(F.max("count").alias("largest"))
    total = every.agg(F.count("*").alias("total"))
    own = every.groupBy("split").agg(F.count("*").alias("n"))
    want = targets.select("split", "share").distinct()
    whole = want.agg(F.sum("share").alias("whole"))
    return (
        want.join(own, "split", "left").crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(whole))  # one row each
        .select("split", (F.abs(F.coalesce("n", F.lit(0)) - F.col("share") / F.col("whole") * F.col("total"))
                          <= F.greatest(F.col("largest"), F.col("total") / bins) + 1).alias("within"))
    )
