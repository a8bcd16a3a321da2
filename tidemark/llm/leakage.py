"""Evaluation passages inside training texts: CGK embedding, bit-sampling LSH, exact edit verification.

Texts become words (split at blanks; case, punctuation, invisible characters and Unicode form
removed). Every window of ``words`` successive words of an item (all of a shorter item) and every
window of a document that is up to ``max_edits`` words shorter or longer is embedded by the CGK random
walk of the item's window size: the output copies the word under a pointer, and a random bit of that
word decides whether the pointer moves on, for three times the window's length. Windows at a small
edit distance end at a small Hamming distance, so keys of sampled output positions collide; the number
of repetitions, each with a walk and a sample of its own, follows from the target recall. Every
collision is verified by the edit distance in words.

With ``max_edits`` 0 equal windows always collide and one repetition has full recall; at any number of
edits all equal windows are found. An edit parts at most two pairs of successive words, so a window of
a document is embedded only if all its other pairs stand in some item; this loses nothing. Pairs and keys of
the items reach the workers as bitmaps of 16 bits for each of them, from 2^``BITMAP_BITS`` bits on and
at most 2^``BITMAP_MOST``; only windows they let through are joined with the item windows. Beyond
2^``BITMAP_MOST`` / 16 item windows they let more through, up to all: the join grows, the result stays.
Distinct phrases are verified, then joined with the documents that hold them.

Defined results: null, empty and wordless texts hold nothing and leak nothing; repeated rows and
copies give every (document, item) once; items and documents of any length are processed whole; a
document shorter than the window can't hold it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.matching import token_distance
from tidemark.session import cut_lineage

WORDS = 8
SAMPLED = 6
BITMAP_BITS, BITMAP_MOST = 22, 27
TARGET_RECALL = 0.95
#: A window has at most one edit for so many words; shorter ones must be equal.
WORDS_AN_EDIT = 5

_DROP = re.compile(r"[^\w\s]|_")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    return _DROP.sub("", unicodedata.normalize("NFKC", text)).casefold().split()


def _symbols(ws: list[str], seen: dict[str, int]) -> np.ndarray:
    import xxhash

    out = np.empty(len(ws), dtype=np.uint64)
    for i, w in enumerate(ws):
        h = seen.get(w)
        if h is None:
            if len(seen) >= 500_000:
                seen.clear()
            h = seen[w] = xxhash.xxh64_intdigest(w) | 1
        out[i] = h
    return out


def repetitions(max_edits: int, target: float = TARGET_RECALL, sampled: int = SAMPLED, size: int = WORDS) -> int:
    """Repetitions for the target recall: an edit moves the walks apart for a few of 3 * size outputs."""
    if max_edits == 0:
        return 1
    same = max(0.05, 1 - 4.0 * max_edits / (3 * size))
    return math.ceil(math.log(1 - target) / math.log(1 - same**sampled))


def cgk_keys(windows: np.ndarray, rep: int, sampled: int = SAMPLED, size: int | None = None) -> np.ndarray:
    """One LSH key for each row of symbols: a CGK walk, then sampled output positions hashed together.

    ``size``: the window size whose walk is taken, where the windows are some words shorter or longer.
    """
    n, width = windows.shape
    size = size or width
    rng = np.random.default_rng([size, rep])
    steps = 3 * size
    multiply = rng.integers(1, 1 << 62, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    # The first output is always the first word; all others depend on the walk.
    chosen = set(rng.choice(steps, min(sampled, steps), replace=False).tolist())
    padded = np.concatenate([windows, np.zeros((n, 1), dtype=np.uint64)], axis=1).ravel()
    at = np.arange(n, dtype=np.int64) * (width + 1)
    last = at + width
    key = np.full(n, size * 1000003 + rep, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(max(chosen) + 1):
            sym = padded[at]
            if j in chosen:
                key = (key ^ sym) * _MIX
                key ^= key >> np.uint64(29)
            at += ((sym * multiply[j]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, last, out=at)
    return key.view(np.int64)


def _pair_keys(flat: np.ndarray) -> np.ndarray:
    """A key of every word with the word behind it."""
    with np.errstate(over="ignore"):
        key = ((flat[:-1] * _MIX) ^ flat[1:]) * _MIX
        return (key ^ (key >> np.uint64(29))).view(np.int64)


def _window_rows(ids: list, texts: list, sizes: list[int], reps: int, edits: int | None, keep: np.ndarray | None,
                 pairs: np.ndarray | None, seen: dict[str, int], sampled: int) -> Iterator[tuple]:
    """(id, keys, words) of the windows; ``edits`` None: an item's own size only; ``keep``, ``pairs``: bitmaps of wanted keys and of the items' pairs of words."""
    many = [words(t) for t in texts]
    symbols = [_symbols(w, seen) for w in many]
    lengths = np.array([len(w) for w in many], dtype=np.int64)
    flat = np.concatenate(symbols) if symbols else np.empty(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    if pairs is not None and len(flat):
        known = np.concatenate([[0], np.cumsum(_in_bitmap(pairs, _pair_keys(flat)))])
    for size in sizes:
        spare = min(edits or 0, size // WORDS_AN_EDIT)
        for width in range(size - spare, size + spare + 1):
            fits = lengths >= width
            if edits is None:
                fits &= np.minimum(lengths, max(sizes)) == size
            if not fits.any():
                continue
            n = lengths[fits] - width + 1
            doc = np.repeat(np.flatnonzero(fits), n)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = starts[doc] + pos
            if pairs is not None:
                # An edit parts two pairs at most: all others stand in an item.
                near = known[begin + width - 1] - known[begin] >= width - 1 - 2 * spare
                doc, pos, begin = doc[near], pos[near], begin[near]
            view = np.lib.stride_tricks.sliding_window_view(flat, width)
            for lo in range(0, len(begin), 200_000):
                part = view[begin[lo:lo + 200_000]]
                keys = np.stack([cgk_keys(part, rep, sampled, size) for rep in range(reps if spare or not edits else 1)], axis=1)
                hit = np.ones(keys.shape, dtype=bool) if keep is None else _in_bitmap(keep, keys)
                for h in np.flatnonzero(hit.any(axis=1)).tolist():
                    d, p = int(doc[lo + h]), int(pos[lo + h])
                    yield ids[d], keys[h][hit[h]].tolist(), many[d][p:p + width]


def _in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    b = keys.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0


def _bitmap(item_keys: DataFrame) -> np.ndarray:
    """64 bits a word, of the keys of the items; the driver gets no more than its words."""
    count = item_keys.select("key").distinct().count()
    bits = min(BITMAP_MOST, max(BITMAP_BITS, math.ceil(math.log2(16 * max(1, count)))))
    b = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    got = item_keys.groupBy(F.shiftright(b, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("set")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bitmap[np.asarray(got["word"])] = np.asarray(got["set"]).view(np.uint64)
    return bitmap


def _pairs(df: DataFrame, text: str) -> DataFrame:
    """(key) of all pairs of successive words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            many = [_pair_keys(_symbols(words(t), seen)) for t in b[text]]
            yield pd.DataFrame({"key": np.unique(np.concatenate([np.empty(0, np.int64), *many]))})

    return df.select(text).where(F.col(text).isNotNull()).mapInPandas(run, "key bigint")


def _windows(df: DataFrame, key: str, text: str, sizes: list[int], reps: int, edits: int | None,
             bitmap: np.ndarray | None, pairs: np.ndarray | None, sampled: int) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            out: dict[tuple, list[int]] = {}  # a text's equal windows once; those of several sizes have the keys of each
            for i, k, w in _window_rows(b[key].tolist(), b[text].tolist(), sizes, reps, edits, bitmap, pairs, seen, sampled):
                out.setdefault((i, " ".join(w)), []).extend(k)
            yield pd.DataFrame([(i, w, sorted(set(k))) for (i, w), k in out.items()], columns=[key, "words", "keys"])

    return df.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInPandas(
        run, f"`{key}` {kind}, words string, keys array<bigint>")


def _edits(x: list[str], y: list[str], most: int) -> int:
    """Edit distance in words, or more than ``most`` if it is larger."""
    n, a, b = min(len(x), len(y)), 0, 0
    while a < n and x[a] == y[a]:
        a += 1
    while b < n - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a:len(x) - b], y[a:len(y) - b]
    if not x or not y or len(x) == len(y) == 1:
        return max(len(x), len(y))
    return 2 if most < 2 else token_distance(" ".join(x), " ".join(y))  # both ends differ: one edit can't do


def _verified(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        n = [(x, y, _edits(x.split(" "), y.split(" "), min(most, (y.count(" ") + 1) // WORDS_AN_EDIT))) for x, y in zip(b["words"], b["item_words"])]
        yield pd.DataFrame([(x, y, e) for x, y, e in n if e <= min(most, (y.count(" ") + 1) // WORDS_AN_EDIT)], columns=["words", "item_words", "edits"])


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
          size: int = WORDS, max_edits: int = 0, target_recall: float = TARGET_RECALL, sampled: int = SAMPLED) -> DataFrame:
    """(doc_key, item_key, edits): the least edit distance of a window of the document to one of the item.

    Of ``max_edits`` a window may have one for each ``WORDS_AN_EDIT`` words of the item's.
    """
    reps = repetitions(max_edits, target_recall, sampled, size)
    every = list(range(1, size + 1))
    item_windows = cut_lineage(_windows(items, item_key, text, every, reps, None, None, None, sampled)
                               .select(item_key, F.col("words").alias("item_words"), F.explode("keys").alias("key")).distinct())
    n = F.length("item_words") - F.length(F.translate("item_words", " ", "")) + 1
    sizes = sorted(int(r[0]) for r in item_windows.select(n).distinct().collect())  # at most ``size`` rows
    candidates = cut_lineage(_windows(documents, doc_key, text, sizes, reps, max_edits, _bitmap(item_windows), _bitmap(_pairs(items, text)), sampled))
    # Of ``max_edits`` + 1 pieces of an item's window one is left whole.
    ws, cut = F.split("item_words", " "), [F.floor(n * j / (max_edits + 1)).cast("int") for j in range(max_edits + 2)]
    pieces = F.array(*[F.array_join(F.slice(ws, a + 1, b - a), " ") for a, b in zip(cut, cut[1:])])
    # A phrase of many documents meets the items once.
    met = candidates.select("words", "keys").distinct().select("words", F.explode("keys").alias("key")) \
        .join(item_windows.select("key", "item_words").distinct().withColumn("pieces", pieces), "key") \
        .where(F.exists("pieces", lambda p: F.contains(F.col("words"), p))).select("words", "item_words").distinct()
    near = met.mapInPandas(lambda batches: _verified(batches, max_edits), "words string, item_words string, edits int")
    return (
        candidates.select(doc_key, "words").join(near, "words")
        .join(item_windows.select(item_key, "item_words").distinct(), "item_words")
        .groupBy(doc_key, item_key).agg(F.min("edits").alias("edits"))
    )
