"""Readers with contracts: segment documents, queries, registries, event sheets, captions by arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<idx:int,start:int,end:double,rep_frame:string,is_static:boolean,motion_score:double,subtitle:string,caption:string>"
DOCUMENT = f"video_id string, duration_sec double, fps double, n_segments int, segments array<{SEGMENT}>"
QUERY = "query_id string, video_id string, text string, type string, gt_start double, gt_end double, gt_seg_idx array<int>, split string"


def segment_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment with ``pos``, its place in the document."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return docs.select("video_id", "duration_sec", "n_segments", F.size("segments").alias("n_read"), F.posexplode_outer("segments").alias("pos", "s")).select(
        "video_id", "duration_sec", "n_segments", "n_read", "pos", "s.*")


def segment_violations(rows: DataFrame, require: list[str], seg_len: int = 5) -> DataFrame:
    """(video_id, rule, n, first): the rules a document breaks, with the first three places; empty when all hold."""
    rules = {"count": F.col("n_segments") != F.col("n_read"), "contiguous": F.col("idx") != F.col("pos"), "grid": F.col("start") != F.col("idx") * seg_len,
             **{f"missing {c}": F.col(c).isNull() for c in require}}
    broken = rows.select("video_id", "pos", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    return broken.groupBy("video_id", "rule").agg(F.count("*").alias("n"), F.expr("slice(array_sort(collect_list(pos)), 1, 3)").alias("first"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY).json(path)


def external_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries of the external set only; a row of any other split is an error."""
    rows = queries(spark, path)
    other = rows.where(F.coalesce(F.col("split") != "external", F.lit(True))).select("query_id", "split").take(3)
    if other:
        raise ValueError(f"not external: {[tuple(r) for r in other]}")
    return rows


def paired_files(spark: SparkSession, folder: str, left: str = "wav", right: str = "json") -> DataFrame:
    """(stem, left, right): files of two kinds with one stem; what stands alone is left out."""
    def listed(ending: str, name: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", True).load(folder)
        return found.select(F.regexp_replace(F.substring_index("path", "/", -1), rf"\.{ending}$", "").alias("stem"), F.col("path").alias(name))

    return listed(left, "left").join(listed(right, "right"), "stem")


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples): 16-bit PCM of one channel as floats in [-1, 1); other formats give null samples."""
    import io
    import wave
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rate, samples = [], []
            for data in b["content"]:
                try:
                    with wave.open(io.BytesIO(bytes(data))) as w:
                        ok = w.getsampwidth() == 2 and w.getnchannels() == 1
                        rate.append(w.getframerate())
                        samples.append((np.frombuffer(w.readframes(w.getnframes()), "<i2") / np.float32(32768)).astype(np.float32) if ok else None)
                except (wave.Error, EOFError):
                    rate.append(None)
                    samples.append(None)
            yield pd.DataFrame({"path": b["path"], "rate": pd.Series(rate, dtype="Int32"), "samples": samples})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")


def zipped_paragraphs(spark: SparkSession, path: str, part: str = r".*section\d+\.xml") -> DataFrame:
    """(path, n, text): the paragraphs (``p`` elements, their ``t`` texts joined) of the XML parts of a zip file; blank ones dropped."""
    import io
    import re
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data in b["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    out.append("\n".join(z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if re.fullmatch(part, n)))
            yield pd.DataFrame({"path": b["path"], "xml": out})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, xml string")
    paragraphs = raw.select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?p\b[^>]*>(.*?)</(?:\w+:)?p>"), F.lit(1))).alias("n", "p"))
    text = F.regexp_replace(F.array_join(F.regexp_extract_all("p", F.lit(r"(?s)<(?:\w+:)?t\b[^>]*>(.*?)</(?:\w+:)?t>"), F.lit(1)), ""), "<[^>]+>", "")
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return paragraphs.select("path", "n", F.trim(text).alias("text")).where("text <> ''")


SHEET_COLUMNS = 32


def event_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, event, start_sec, end_sec, unclear, extra) of CSV bytes in UTF-8 (with or without mark), else CP949.

    Columns go by the header's names (event, start, end, unclear); others are kept in the map ``extra``; quoted commas are text;
    blank lines are dropped. A sheet has at most ``SHEET_COLUMNS`` columns and no line ends inside quotes.
    """
    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.decode("content", "UTF-8")
    text = F.when(F.try_validate_utf8(F.col("content").cast("string")).isNotNull(), utf8).otherwise(_cp949("content"))
    lines = F.split(F.regexp_replace(text, "^\ufeff", ""), r"\r?\n")
    kind = ", ".join(f"c{i} string" for i in range(SHEET_COLUMNS))

    def cells(line):
        row = F.from_csv(line, kind)
        return F.array(*[F.trim(row[f"c{i}"]) for i in range(SHEET_COLUMNS)])

    rows = raw.select("path", F.get(lines, F.lit(0)).alias("head"), F.posexplode(lines).alias("line_no", "line")) \
        .where("line_no > 0 AND trim(replace(line, ',', '')) <> ''")
    zipped = rows.select("path", "line_no", F.filter(F.arrays_zip(cells(F.col("head")).alias("k"), cells(F.col("line")).alias("v")), lambda c: c["k"] != "").alias("c"))
    m = zipped.select("path", "line_no", F.map_from_entries("c").alias("m"))
    at = lambda n: F.try_element_at("m", F.lit(n))
    return m.select("path", "line_no", at("event").alias("event"), at("start").try_cast("double").alias("start_sec"), at("end").try_cast("double").alias("end_sec"),
                    F.coalesce(F.lower(at("unclear")).isin("1", "true", "y"), F.lit(False)).alias("unclear"),
                    F.map_filter("m", lambda k, v: ~k.isin("event", "start", "end", "unclear")).alias("extra"))


def _cp949(column: str):
    import pandas as pd

    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else bytes(x).decode("cp949", "replace"))

    run.__annotations__ = {"b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(F.col(column))


def arm_captions(spark: SparkSession, path: str, arm: str) -> DataFrame:
    """A map of arrays (video -> captions) as (arm, video_id, idx, caption)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("video_id", "caps")).select(F.lit(arm).alias("arm"), "video_id", F.posexplode("caps").alias("idx", "caption"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, source_url, source_id, file_sha256); a missing file gives an empty table."""
    kind = "video_id string, source_url string, source_id string, file_sha256 string"
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)
    m = F.from_json("value", "struct<videos:map<string,struct<source_url:string,source_id:string,file_sha256:string>>>")
    return raw.select(F.explode(m["videos"]).alias("video_id", "v")).select("video_id", "v.*")
