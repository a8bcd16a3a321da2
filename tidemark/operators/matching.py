"""Optimal one-to-one matching of event spans, and other operators that no built-in expression covers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total gain, each used once: shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    if n == 0 or m == 0:
        return []
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # column m is a virtual start
    for row in range(n):
        owner[m] = row
        col, least, back, done = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        while owner[col] != -1:
            done[col] = True
            reduced = cost[owner[col]] - u[owner[col]] - v[:m]
            better = ~done[:m] & (reduced < least)
            least[better], back[better] = reduced[better], col
            nxt = int(np.argmin(np.where(done[:m], np.inf, least)))
            step = least[nxt]
            seen = np.flatnonzero(done)
            u[owner[seen]] += step
            v[seen] -= step
            least[~done[:m]] -= step
            col = nxt
        while col != m:
            owner[col] = owner[back[col]]
            col = back[col]
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def inclusive_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of inclusive integer spans, all of a against all of b."""
    inter = np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0]) + 1
    inter = np.maximum(0, inter)
    size = lambda s: s[:, 1] - s[:, 0] + 1
    return inter / np.maximum(1, size(a)[:, None] + size(b)[None, :] - inter)


def match_events(references: DataFrame, generated: DataFrame, entity: str = "video_id", lot_rows: int = 20_000) -> DataFrame:
    """(entity, ref, gen, iou): the one-to-one matching of largest total IoU per entity; pairs without overlap left out.

    Both sides have entity, no, a, b. Only events that overlap directly or through others are matched
    together: they form blocks of the merged time line, so an entity's size isn't a task's size.
    Null spans and reversed spans take no part; empty input gives an empty result.
    """
    from pyspark.sql import Window

    side = lambda df, kind: df.select(entity, F.lit(kind).alias("kind"), "no", "a", "b").where("b >= a")
    both = side(references, 0).unionByName(side(generated, 1)).distinct()
    order = Window.partitionBy(entity).orderBy("a", "b", "kind", "no")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = both.withColumn("open", F.when(F.coalesce(F.col("a") > before, F.lit(True)), 1).otherwise(0)) \
        .withColumn("block", F.sum("open").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("open")
    kind = references.schema[entity].dataType.simpleString()
    number = references.schema["no"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, block in pdf.groupby([entity, "block"], sort=False):
            r, g = block[block["kind"] == 0].sort_values("no"), block[block["kind"] == 1].sort_values("no")
            iou = inclusive_iou(r[["a", "b"]].to_numpy(), g[["a", "b"]].to_numpy())
            rows += [(block[entity].iloc[0], r["no"].iloc[i], g["no"].iloc[j], float(iou[i, j])) for i, j in best_assignment(iou) if iou[i, j] > 0]
        return pd.DataFrame(rows, columns=[entity, "ref", "gen", "iou"])

    # Many small blocks share a task's call, of about ``lot_rows`` events; a block is never split.
    lots = max(256, both.count() // lot_rows)
    sized = blocks.where(F.col(entity).isNotNull()).withColumn("lot", F.pmod(F.xxhash64(entity, "block"), F.lit(lots)))
    return sized.groupBy("lot").applyInPandas(run, f"`{entity}` {kind}, ref {number}, gen {number}, iou double")


def substring_distance(needle: str, hay: str) -> float:
    """Least edit distance of the needle to any part of the hay, over the needle's length; 1.0 for an empty needle."""
    if not needle:
        return 1.0
    h = np.array([ord(c) for c in hay], dtype=np.int64)
    row = np.zeros(len(h) + 1, dtype=np.int64)
    steps = np.arange(len(h) + 1)
    for i, c in enumerate(needle, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (h != ord(c)))
        # Insertions run to the right: a running minimum of value minus place.
        row = np.minimum.accumulate(new - steps) + steps
    return float(row.min()) / len(needle)


def token_distance(ref: str, hyp: str) -> int:
    """Edit distance in words."""
    x, y = ref.split(), hyp.split()
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        left, row = row, [i]
        for j, q in enumerate(y, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (p != q)))
    return row[-1]


def character_f(ref: str, hyp: str, most: int = 6, beta: float = 2.0) -> float:
    """F-score of character n-grams of 1 to ``most`` as multisets: mean precision and recall over the lengths both texts have."""
    precision, recall = [], []
    for n in range(1, min(most, len(ref), len(hyp)) + 1):
        a, b = (Counter(t[i:i + n] for i in range(len(t) - n + 1)) for t in (hyp, ref))
        hit = sum(min(c, b[g]) for g, c in a.items() if g in b)
        precision.append(hit / (len(hyp) - n + 1))
        recall.append(hit / (len(ref) - n + 1))
    p, r = (sum(x) / len(x) if x else 0.0 for x in (precision, recall))
    return (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def _pairwise(function, kind: str):
    """A batch function of two string columns, null where either is null; made when used, not on the workers' import."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="Int32" if kind == "int" else "float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def approx_substring(needle, hay):
    return _pairwise(substring_distance, "double")(needle, hay)


def word_errors(ref, hyp):
    return _pairwise(token_distance, "int")(ref, hyp)


def chrf(ref, hyp):
    return _pairwise(character_f, "double")(ref, hyp)


def with_model(rows: DataFrame, answer, column: str, retries: int = 1) -> DataFrame:
    """Rows with ``column``, filled by ``answer(batch) -> list``; a failing batch is tried again, then left null.

    The hook for captioners, judges and language models, which are inputs of this engine.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [None] * len(b)
            for _ in range(retries + 1):
                try:
                    out = list(answer(b))
                    break
                except Exception:
                    continue
            b[column] = pd.Series(out, index=b.index, dtype=object)
            yield b

    return rows.mapInPandas(run, schema)
