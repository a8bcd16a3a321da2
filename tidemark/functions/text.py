"""Text expressions on columns, all built in (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scripts that count as foreign in a caption, sentence ends, thresholds.
CJK = "一-鿿぀-ヿ"
SENTENCE_END = "。．.!?！？…"
MIN_CJK, CJK_SHARE, WORD_SHARE, MIN_WORDS = 3, 0.2, 0.4, 6


def cjk_count(c: Column, script: str = CJK) -> Column:
    return F.length(F.regexp_replace(c, f"[^{script}]", ""))


def strip_residual_cjk(c: Column, script: str = CJK) -> Column:
    """Without the script's runs, blanks squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"[{script}]+", ""), r"\s{2,}", " "))


def truncate_to_sentence(c: Column) -> Column:
    """Up to the last sentence end; unchanged where there is none."""
    head = F.regexp_extract(c, f"(?s)^(.*[{SENTENCE_END}])", 1)
    return F.when(c.isNotNull(), F.when(head == "", c).otherwise(F.regexp_replace(head, r"\s+$", "")))


def display_clean(c: Column) -> Column:
    """Three or more repeats of a token of at most 15 characters become one; the script is dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"(\S{1,15})(?:\s+\1){2,}", "$1"), f"[{CJK}]+", "")


def repeats_phrase(c: Column) -> Column:
    """A phrase of 3 to 20 characters three times in a row."""
    return c.rlike(r"(?s)(.{3,20}?)\1{2,}")


def repeats_word(c: Column) -> Column:
    """At least six words, of which one makes up more than 40 %."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    counts = F.transform(F.array_distinct(words), lambda d: F.size(F.filter(words, lambda w: w == d)))
    return (F.size(words) >= MIN_WORDS) & (F.coalesce(F.array_max(counts), F.lit(0)) > WORD_SHARE * F.size(words))


def is_corrupted_caption(c: Column, script: str = CJK) -> Column:
    """Foreign script by count or share, a repeated phrase, or a dominating word; false for null and empty texts."""
    n = cjk_count(c, script)
    rule = (n >= MIN_CJK) | (n > CJK_SHARE * F.length(c)) | repeats_phrase(c) | repeats_word(c)
    return F.coalesce((c != "") & rule, F.lit(False))


def citations(c: Column) -> Column:
    """Distinct cited segment numbers in ascending order; empty for a null text."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)seg\s*#\s*(\d{1,9})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def narration(c: Column) -> Column:
    """The sentence without citation groups and without dashes, dots and commas around it."""
    bare = F.regexp_replace(c, r"\s*\[\s*seg\s*#[^\]]*\]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^[\s\-–—·,.]+", ""), r"[\s\-–—·,.]+$", "")


def last_verdict(c: Column) -> Column:
    """The last ``"match": true/false`` of an answer, false where there is none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r'(?i)"match"\s*:\s*(true|false)'), F.lit(1))
    return F.coalesce(F.lower(F.try_element_at(found, F.lit(-1))) == "true", F.lit(False))


def parse_events(c: Column) -> Column:
    """The JSON array between the first [ and the last ], as event records; empty where it isn't one."""
    kind = "array<struct<event:string,span:array<int>,evidence_segments:array<int>,description:string>>"
    body = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.when(body != "", body), kind), F.from_json(F.lit("[]"), kind))
