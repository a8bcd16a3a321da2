"""Texts cut off by field limits, found from word trigrams inside texts against word trigrams at ends.

Pure SQL. Texts are split into sentences and words (one character each in scripts without blanks,
digits folded to 0, commas and brackets kept as words; ¶ stands for a sentence's bounds). Over all
distinct texts, every trigram (a, b, c) is counted with how it goes on; a and b travel as 64-bit
hashes, c as the word:

* inside: another word follows in the sentence, or c is only the beginning of a longer word there
  (every proper beginning of c counts as an inside occurrence of that beginning),
* end: the sentence ends behind c; open: the whole text does, without a terminator.

A text that doesn't end in a terminator is joined on its last trigram. The share of ends among all
occurrences, without the text itself, is smoothed from word to bigram to trigram
(``(ends + k * lower) / (all + k)``, below the word the place behind b alone); a share of at most
``max_share`` means that this place is frequent inside and almost never terminal, so the text lost
its end. Ellipses and stray symbols behind the last word are left out first.

Only open trigrams are judged, so only beginnings that are some open trigram's word are counted, and
the words are spelled out in the vocabulary, not in the trigrams.

Defined results: null, blank and wordless texts are never truncated; a text seen nowhere else stays
at the neutral share of one half and is not flagged; copies of a text under many keys count once in
the statistics and all get its verdict; repeated rows of a key give one row; very long words are
read in pieces of 32 characters (one of many equal pieces may
look cut); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

MAX_SHARE = 0.2
SMOOTHING = 4.0

_CJK = "\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = rf"[0-9A-Za-z가-힣[\p{{L}}\p{{M}}\p{{N}}&&[^{_CJK}]]]{{1,32}}|[{_CJK}，、,;:；：\[\]¶]"
_STRAY = r"(?:\.{2,}|[^\p{L}\p{M}\p{N}.!?。！？，、,;:；：\[\]])+$"
_BREAK = r"[.!?]+(?=\s|$)|[。！？\r\n]+"
#: Everything behind the last break: a terminator, a line's end, a closing bracket, or before an opening one.
_TAIL = r"(?s)^(?:.*(?:[.!?](?=\s|$)|[。！？\r\n\]¶]|(?=\[)))?(.*)$"


def records(segments: DataFrame, report: DataFrame) -> DataFrame:
    """(rec_table, rec_key, source, text) of the two text fields."""
    return segments.select(
        F.lit("segments").alias("rec_table"),
        F.concat_ws("#", "video_id", F.col("idx").cast("string")).alias("rec_key"),
        F.col("caption_arm").alias("source"), F.col("caption").alias("text"),
    ).unionByName(report.select(
        F.lit("report").alias("rec_table"),
        F.concat_ws("#", F.col("report_id").cast("string"), F.col("sent_id").cast("string")).alias("rec_key"),
        F.col("model").alias("source"), F.col("text"),
    ))


def _bare(text: str = "text"):
    """The text without stray symbols at its end, digits folded."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), _STRAY, "")


def _words(text):
    return F.regexp_extract_all(F.concat(F.lit("¶¶"), text), F.lit(_WORD), F.lit(0))


def last_trigrams(rows: DataFrame) -> DataFrame:
    """Rows whose text doesn't end in a terminator, with the last trigram (ab, b, c) in place of the text."""
    keep = [c for c in rows.columns if c != "text"]
    end = F.right("text", F.lit(1))
    finished = end.isin("!", "?", "。", "！", "？", "]") | ((end == ".") & (F.right("text", F.lit(2)) != ".."))
    # Generators keep the filters behind them, so that nothing is evaluated twice.
    tails = (
        rows.where(F.col("text").isNotNull() & ~finished)
        .select(*keep, F.col("text").rlike(r"\p{L}").alias("worded"), F.explode(F.array(F.regexp_extract(_bare(), _TAIL, 1))).alias("tail"))
        .where("worded").where(F.col("tail").rlike(r"\p{L}|^\["))
    )
    return tails.select(*keep, F.explode(F.array(_words(F.col("tail")))).alias("w")).select(
        *keep, F.xxhash64(F.element_at("w", -3), F.element_at("w", -2)).alias("ab"),
        F.xxhash64(F.element_at("w", -2)).alias("b"), F.element_at("w", -1).alias("c"))


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(ab, b, c, inside, ends, open) over all sentences of (text)."""
    marked = F.regexp_replace(_bare(), _BREAK, "¶¶")
    marked = F.replace(F.replace(marked, F.lit("["), F.lit("¶¶[")), F.lit("]"), F.lit("]¶¶"))
    words = texts.where(F.col("text").rlike(r"\p{L}")).select(_words(marked).alias("a"))
    shifted = words.select("a", *[F.slice("a", i, F.size("a")).alias(n) for i, n in ((2, "b"), (3, "c"), (4, "d"))])
    # Zipped arrays are as long as the longest, so what follows the last word is null.
    grams = shifted.select(F.inline(F.arrays_zip("a", "b", "c", "d"))).where("c <> '¶'")
    return grams.groupBy(F.xxhash64("a", "b").alias("ab"), F.xxhash64("b").alias("b"), "c").agg(
        F.count_if(F.col("d") != "¶").alias("inside"), F.count_if(F.coalesce(F.col("d"), F.lit("¶")) == "¶").alias("ends"),
        F.count_if(F.col("d").isNull()).alias("open"))


def end_shares(grams: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """The open trigrams (ab, b, c) with ``share``, the smoothed share of ends."""
    wanted = grams.where("open > 0").select("ab", "b", "c")
    # A beginning of c is an inside occurrence of that beginning; c itself as it was counted.
    spelled = grams.select(F.col("c").alias("word")).distinct().select("word", F.explode(
        F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.left(F.col("word"), n))).alias("p"))
    spelled = spelled.join(wanted.select(F.col("c").alias("p")).distinct(), "p")
    whole = F.col("p") == F.col("c")
    counts = grams.join(spelled, grams.c == spelled.word).groupBy("ab", "b", F.col("p").alias("c")).agg(
        F.sum(F.when(whole, F.col("inside")).otherwise(F.col("inside") + F.col("ends"))).alias("n3"),
        F.sum(F.when(whole, F.col("ends")).otherwise(0)).alias("e3"))
    two = counts.groupBy("b", "c").agg(F.sum("n3").alias("n2"), F.sum("e3").alias("e2"))
    one = two.groupBy("c").agg(F.sum("n2").alias("n1"), F.sum("e2").alias("e1"))
    # For words seen nowhere else (cut names): how often a sentence ends with the word behind b.
    behind = grams.groupBy("b").agg(F.sum("inside").alias("n0"), F.sum("ends").alias("e0"))
    k = F.lit(float(smoothing))
    share = F.lit(0.5)
    for n in (0, 1, 2, 3):
        own = F.col(f"e{n}") - 1  # without the text that is judged
        share = (own + k * share) / (own + F.col(f"n{n}") + k)
    return (
        wanted.join(counts, ["ab", "b", "c"]).join(two, ["b", "c"]).join(one, "c").join(behind, "b")
        .select("ab", "b", "c", share.alias("share"))
    )


def truncated(rows: DataFrame, max_share: float = MAX_SHARE, smoothing: float = SMOOTHING) -> DataFrame:
    """The rows (rec_table, rec_key, source, text) whose text lost its end, without the text."""
    texts = rows.where(F.col("text").rlike(r"\p{L}")).select("text").distinct()
    grams = cut_lineage(trigram_counts(texts))  # used several times and far smaller than the texts
    cut = end_shares(grams, smoothing).where(F.col("share") <= max_share)
    return last_trigrams(rows).join(cut, ["ab", "b", "c"], "left_semi").select("rec_table", "rec_key", "source").distinct()


def source_shares(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per source its records, its truncated records and their share; a record counts once."""
    every = rows.groupBy("rec_table", "source").agg(F.countDistinct("rec_key").alias("records"))
    cut = found.groupBy("rec_table", "source").agg(F.countDistinct("rec_key").alias("truncated"))
    same = (every.rec_table == cut.rec_table) & every.source.eqNullSafe(cut.source)
    n = F.coalesce(cut.truncated, F.lit(0))
    return every.join(cut, same, "left").select(
        every.rec_table, every.source, "records", n.alias("truncated"),
        F.round(n / F.col("records"), 6).alias("share"))
