"""The relational shell around models: captions with resume and retries, a transcript cache, reports by map and reduce.

The models are callables that get a batch and return a list; they run in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X

#: Chunk, overlap, least share of a chunk that its answer cites, largest share one sentence may cite, least diversity.
CHUNK, OVERLAP, COVERED, DUMP, DISTINCT = 60, 5, 0.5, 0.5, 0.3


def caption_all(segments: DataFrame, captioner: Callable[[str, bool], str], corrupted: Callable[[str], bool], samples: int = 2) -> DataFrame:
    """segments(video_id, idx, rep_frame, caption) with ``caption`` filled, ``failed`` and ``calls``.

    Captions that are there stay. An error is tried once more, a corrupted answer up to ``samples`` times with sampling on;
    the last answer is kept. A segment without a frame fails without a call.
    """
    def one(frame) -> tuple[str | None, bool, int]:
        answer, calls = None, 0
        if frame is None or frame != frame:
            return None, True, 0
        for _ in range(2):
            calls += 1
            try:
                answer = captioner(frame, False)
                break
            except Exception:
                continue
        if answer is None:
            return None, True, calls
        for _ in range(samples):
            if not corrupted(answer):
                break
            calls += 1
            try:
                answer = captioner(frame, True)
            except Exception:
                continue
        return answer, False, calls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = b["caption"].isna() | (b["caption"].str.strip() == "")
            got = [one(f) if t else (c, False, 0) for f, c, t in zip(b["rep_frame"], b["caption"], todo)]
            yield pd.DataFrame({"video_id": b["video_id"], "idx": b["idx"], "caption": [g[0] for g in got], "failed": [g[1] for g in got], "calls": [g[2] for g in got]})

    rows = segments.select("video_id", "idx", "rep_frame", "caption")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("video_id", "idx"))
    return rows.mapInPandas(run, f"{kinds}, caption string, failed boolean, calls int")


def from_cache(wanted: DataFrame, cache: DataFrame, beam: int = 5) -> DataFrame:
    """wanted(video_id, model, lang, mtime, size, beam) with ``hit``: the cached entry is equal in all; old entries have the default beam."""
    key = ["model", "lang", "mtime", "size", "beam"]
    old = cache.withColumn("beam", F.coalesce("beam", F.lit(beam))).select("video_id", *key).distinct().withColumn("hit", F.lit(True))
    return wanted.join(old, ["video_id", *key], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def chunks(segments: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(video_id, chunk, idx): overlapped chunks; the last one ends with the video."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - overlap
    top = segments.groupBy("video_id").agg(F.max("idx").alias("top"))
    last = F.greatest(F.lit(0), F.ceil((F.col("top") - size + 1) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step))
    until = F.least(F.floor(F.col("idx") / step), last)
    return segments.join(top, "video_id").where(first <= until).select("video_id", F.explode(F.sequence(first, until)).alias("chunk"), "idx")


def parse_report(raw: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row for each non-blank line of an answer: its place, the line without leading dashes, its citations."""
    lines = raw.select(*keep, F.posexplode(F.split(text, r"\r?\n")).alias("line", "t")).select(*keep, "line", F.trim(F.regexp_replace("t", r"^[\s\-–—•]+", "")).alias("sentence"))
    return lines.where("sentence <> ''").select(*keep, "line", "sentence", X.citations(F.col("sentence")).alias("cites"))


def map_report(segments: DataFrame, answers: DataFrame, retries: DataFrame | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(video_id, chunk, line, sentence, cites, coverage): the answers(video_id, chunk, text) of the chunks, cited inside them only.

    Of a chunk that cites less than half of its segments the retry is taken if it cites more.
    """
    inside = chunks(segments, size, overlap).groupBy("video_id", "chunk").agg(F.collect_set("idx").alias("own"))
    tries = answers.withColumn("try", F.lit(0))
    if retries is not None:
        tries = tries.unionByName(retries.withColumn("try", F.lit(1)))
    parsed = parse_report(tries, ["video_id", "chunk", "try"]).join(inside, ["video_id", "chunk"]).withColumn("cites", F.array_intersect("cites", "own"))
    cover = parsed.groupBy("video_id", "chunk", "try").agg((F.size(F.array_distinct(F.flatten(F.collect_list("cites")))) / F.max(F.size("own"))).alias("coverage"))
    best = Window.partitionBy("video_id", "chunk").orderBy(F.when((F.col("try") == 0) & (F.col("coverage") >= COVERED), 2.0).otherwise(F.col("coverage")).desc(), "try")
    chosen = cover.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return parsed.join(chosen, ["video_id", "chunk", "try"]).select("video_id", "chunk", "line", "sentence", "cites", F.round("coverage", 6).alias("coverage"))


def reduce_report(mapped: DataFrame, answers: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, sent_id, sentence, cites, dropped): the reduced answers(video_id, text), citations the map never made taken out.

    ``dropped`` says why a sentence doesn't stay: ``dump`` (it cites more than half of the video), ``tail`` (the last line, without citations).
    """
    known = mapped.groupBy("video_id").agg(F.collect_set("cites").alias("c")).select("video_id", F.flatten("c").alias("known"))
    n = segments.groupBy("video_id").agg(F.countDistinct("idx").alias("n"))
    s = parse_report(answers, ["video_id"]).join(known, "video_id", "left").join(n, "video_id").withColumn("cites", F.array_intersect("cites", F.coalesce("known", F.array().cast("array<int>"))))
    order = Window.partitionBy("video_id").orderBy("line")
    back = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("line")))
    dropped = F.when(F.size("cites") > DUMP * F.col("n"), "dump").when((back == 1) & (F.size("cites") == 0), "tail")
    return s.select("video_id", (F.row_number().over(order) - 1).alias("sent_id"), "sentence", "cites", dropped.alias("dropped"))


def needs_retry(reduced: DataFrame) -> DataFrame:
    """(video_id, why): ``loop`` where fewer than three in ten narrations differ, ``dump`` where a sentence cited half the video."""
    g = reduced.groupBy("video_id").agg((F.countDistinct(X.narration(F.col("sentence"))) / F.count("*")).alias("ratio"), F.max((F.col("dropped") == "dump").cast("int")).alias("dump"))
    return g.select("video_id", F.when(F.col("ratio") < DISTINCT, "loop").when(F.col("dump") == 1, "dump").alias("why")).where("why IS NOT NULL")
