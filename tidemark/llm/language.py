"""Languages of captions and of every stretch of a mixed caption, with a confidence.

Hierarchical discrimination. A caption is cut into clauses at line breaks, slashes and the ends of
sentences; quoted strings (signs) are left out. The language family of a clause comes first, by a
one-versus-one linear support vector machine on the shares of the scripts (Hangul, Kana, Han, Latin)
of its words; then, within the family, one-versus-one linear support vector machines on
hashed words and character 3-grams separate the related languages: ``han`` into zh and ja, ``latin`` into en, de,
fr and es. The pairwise margins are summed; the confidence is the logistic of the smallest margin of
the winner against the others of its level, times that of the level above.

Training uses at most ``per_label`` labelled captions of each language (those of the smallest
hashes), a documented bound. Labels are noisy, so the fit is repeated once without the captions
whose own prediction disagrees with the label. The fitted weights have a fixed size (2^HASH_BITS
for each pair) and are sent to the executors with the job.

Defined results: null, blank and wordless captions have no language; a clause without letters
is left out; neighbouring clauses of one language form one stretch; repeated
rows give the same result once; text of other scripts gets the nearest trained family; without
any labelled caption to train on nothing gets a language.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("ko", "en", "zh", "ja", "es", "fr", "de")
FAMILIES = {"hangul": ("ko",), "han": ("zh", "ja"), "latin": ("en", "de", "fr", "es")}
PER_LABEL = 1000
HASH_BITS = 14
FAMILY = {lang: f for f, ls in FAMILIES.items() for lang in ls}
#: Clauses of fewer letters don't decide between the languages of their family.
STUMP = {"hangul": 1, "han": 6, "latin": 18}

# English names and three-letter codes of the languages.
NAMES = {
    "korean": "ko", "english": "en", "chinese": "zh", "japanese": "ja", "spanish": "es", "french": "fr", "german": "de",
    "kor": "ko", "eng": "en", "zho": "zh", "chi": "zh", "jpn": "ja", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de",
}
MISSING = ("", "und", "unknown")

_QUOTED = re.compile(r"\"[^\"\n]{0,40}\"|“[^”\n]{0,40}”|「[^」\n]{0,40}」")
_CUT = re.compile(r"(?<=[。！？])|(?<=[.!?…])\s+|[\r\n]+|\s+/\s+|\s+\|\s+")
_HANGUL = re.compile(r"[가-힣ᄀ-ᇿㄱ-ㆎ]")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-鿿]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_RUN = re.compile(r"[가-힣ᄀ-ᇿㄱ-ㆎ][^A-Za-zÀ-ɏ぀-ヿ㐀-鿿]*|[぀-ヿ㐀-鿿][^A-Za-zÀ-ɏ가-힣ᄀ-ᇿㄱ-ㆎ]*|[A-Za-zÀ-ɏ][^가-힣ᄀ-ᇿㄱ-ㆎ぀-ヿ㐀-鿿]*")
_OTHER = re.compile(r"[^\W\d_가-힣ᄀ-ᇿㄱ-ㆎ]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")


def label_language(label: Column) -> Column:
    """The two-letter language of a label as written, or null for a missing one; other labels stay as they are."""
    plain = F.regexp_extract(F.lower(F.trim(label)), "^[a-z]+", 0)
    pairs = [F.lit(x) for kv in NAMES.items() for x in kv]
    return F.when(~plain.isin(*MISSING), F.coalesce(F.try_element_at(F.create_map(*pairs), plain), plain))


def _runs(clause: str) -> list[str]:
    """A clause that changes script in its middle, split there; short runs (names) stay with their neighbour."""
    runs = [m.group() for m in _RUN.finditer(clause)]
    out: list[str] = []
    open_run = False  # the last of out is still waiting for a run of its own
    for r in runs:
        c = r[0]
        own = len(_HANGUL.findall(r)) >= 4 if _HANGUL.match(c) else len(_CJK.findall(r)) >= 6 if _CJK.match(c) else len(_WORD.findall(r)) >= 4
        if out and (open_run or not own):
            out[-1] += r
            open_run = open_run and not own
        else:
            out.append(r)
            open_run = not own
    return out or [clause]


def clauses(text: str | None) -> list[str]:
    """The clauses of a caption that have letters outside quoted strings."""
    if not text:
        return []
    out = []
    for c in _CUT.split(_QUOTED.sub(" ", text)):
        if c and _LETTER.search(c):
            mixed = bool(_HANGUL.search(c)) + bool(_CJK.search(c)) + bool(_LATIN.search(c)) > 1
            out += _runs(c) if mixed else [c]
    return out


def script_shares(clause: str) -> np.ndarray:
    """Shares of the letters in Hangul, Kana, Han and Latin, with a constant."""
    h, k, c = (len(p.findall(clause)) for p in (_HANGUL, _KANA, _HAN))
    n = max(1, len(_LETTER.findall(clause)))
    return np.array([h / n, k / n, c / n, max(0, n - h - k - c) / n, 1.0])


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << HASH_BITS) - 1)


class Features:
    """Hashed words and character trigrams of a clause; words are remembered, up to a bound."""

    def __init__(self, bound: int = 200_000) -> None:
        self.seen: dict[str, list[int]] = {}
        self.bound = bound

    def of_word(self, w: str) -> list[int]:
        found = self.seen.get(w)
        if found is None:
            p = f"<{w}>"
            found = [_bucket(p)] + [_bucket(p[i:i + 3]) for i in range(max(1, len(p) - 2))]
            if len(self.seen) >= self.bound:
                self.seen.clear()
            self.seen[w] = found
        return found

    def __call__(self, clause: str) -> np.ndarray:
        ids: list[int] = []
        for w in _WORD.findall(clause.lower()):
            ids += self.of_word(w)
        return np.asarray(ids, dtype=np.int32)


def fit_pair(rows: list[np.ndarray], y: np.ndarray, width: int, sparse: bool, epochs: int = 5, c: float = 1.0) -> np.ndarray:
    """Linear SVM (hinge loss) by dual coordinate descent; rows are dense vectors or hashed ids (mean of ones)."""
    w = np.zeros(width)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    if sparse:
        counted = [np.unique(r, return_counts=True) for r in rows]
        vals = [(i, n / np.sqrt(max(1, n.sum()))) for i, n in counted]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if sparse:
                ids, v = vals[i]
                if not len(ids):
                    continue
                g, q = y[i] * (w[ids] @ v) - 1, v @ v
            else:
                g, q = y[i] * (w @ rows[i]) - 1, rows[i] @ rows[i]
            new = min(max(alpha[i] - g / q, 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                if sparse:
                    w[ids] += step * v
                else:
                    w += step * rows[i]
                alpha[i] = new
    return w


class Model:
    """Two levels of one-versus-one linear SVMs."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        rows = [(c, lang) for t, lang in zip(texts, langs) for c in clauses(t)[:1]]
        self.families = [f for f in FAMILIES if any(FAMILY[lang] == f for _, lang in rows)]
        x = [script_shares(c) for c, _ in rows]
        fam = np.array([FAMILY[lang] for _, lang in rows])
        self.families_seen: dict[bytes, tuple[str, float]] = {}
        self.top = {}
        for i, a in enumerate(self.families):
            for b in self.families[i + 1:]:
                k = np.flatnonzero((fam == a) | (fam == b))
                self.top[a, b] = fit_pair([x[j] for j in k], np.where(fam[k] == a, 1.0, -1.0), 5, False)
        self.features = Features()
        self.low = {}
        for f in self.families:
            # A noisy label of another family can't teach this family's languages.
            own = [(c, lang) for (c, lang), s in zip(rows, x) if FAMILY[lang] == f and self.family(s)[0] == f]
            present = [lang for lang in FAMILIES[f] if any(m == lang for _, m in own)]
            ids = [self.features(c) for c, _ in own]
            y = np.array([lang for _, lang in own])
            pairs, weights = [], []
            for i, a in enumerate(present):
                for b in present[i + 1:]:
                    k = np.flatnonzero((y == a) | (y == b))
                    pairs.append((a, b))
                    weights.append(fit_pair([ids[j] for j in k], np.where(y[k] == a, 1.0, -1.0), 1 << HASH_BITS, True))
            self.low[f] = present, pairs, np.array(weights, dtype=np.float32).reshape(len(pairs), 1 << HASH_BITS)

    @staticmethod
    def _vote(names: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        total = dict.fromkeys(names, 0.0)
        least = dict.fromkeys(names, 1e9)
        for (a, b), m in margins.items():
            total[a] += m
            total[b] -= m
            least[a] = min(least[a], m)
            least[b] = min(least[b], -m)
        best = max(names, key=lambda n: (least[n], total[n]))
        return best, 1 / (1 + math.exp(-4 * max(-50.0, least[best])))

    def family(self, shares: np.ndarray) -> tuple[str, float]:
        key = shares.tobytes()
        found = self.families_seen.get(key)
        if found is None:
            found = self._vote(self.families, {k: float(w @ shares) for k, w in self.top.items()})
            if len(self.families_seen) < 100_000:
                self.families_seen[key] = found
        return found

    def clause(self, clause: str) -> tuple[str, float]:
        """Language and confidence of one clause."""
        f, p = self.family(script_shares(clause))
        names, pairs, weights = self.low[f]
        if len(names) <= 1:
            return (names[0] if names else FAMILIES[f][0]), p
        ids = self.features(clause)
        margins = weights[:, ids].sum(axis=1) / np.sqrt(max(1, len(ids)))
        best, q = self._vote(names, dict(zip(pairs, margins.tolist())))
        return best, p * q

    def stretches(self, text: str | None) -> list[tuple[int, str, float, str]]:
        """(number, language, confidence, text) of the stretches of a caption; none where no language was trained."""
        if not self.families:
            return []
        if text and not _OTHER.search(bare := _QUOTED.sub(" ", text)):  # one script: every clause has the same shares
            n = len(_HANGUL.findall(bare))
            return [(0, "ko", self.clause("가")[1], text)] if n else []
        parts = [(c, len(_LETTER.findall(c)), *self.clause(c)) for c in clauses(text)]
        # A stump of a clause (cut texts) takes the language of the longest clause of its family.
        longest: dict[str, tuple[int, str]] = {}
        for _, n, lang, _ in parts:
            longest[FAMILY[lang]] = max(longest.get(FAMILY[lang], (0, "")), (n, lang))
        out: list[list] = []
        for c, n, lang, p in parts:
            if n < STUMP[FAMILY[lang]]:
                lang = longest[FAMILY[lang]][1]
            if out and out[-1][0] == lang:
                out[-1][1] += p * n
                out[-1][2] += n
                out[-1][3].append(c)
            else:
                out.append([lang, p * n, n, [c]])
        return [(i, lang, p / n, " ".join(cs)) for i, (lang, p, n, cs) in enumerate(out)]


def fit(segments: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The model from at most ``per_label`` labelled captions of each language (of the smallest hashes)."""
    rows = segments.select(
        label_language(F.col("caption_lang")).alias("lang"), F.xxhash64("caption").alias("h"), F.col("caption").alias("text")
    ).where(F.col("lang").isin(*LANGUAGES) & F.col("text").rlike(r"\p{L}{2}"))
    # Hashes first: copies count once, and the rank limit is applied before the shuffle.
    w = Window.partitionBy("lang").orderBy("h")
    picked = rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_label)
    texts = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = sorted((r.lang, r.text) for r in texts.collect())  # at most per_label * 7 rows
    texts, langs = [t for _, t in sample], [lang for lang, _ in sample]
    first = Model(texts, langs)
    agree = [i for i, t in enumerate(texts) if {s[1] for s in first.stretches(t)} == {langs[i]}]
    return Model([texts[i] for i in agree], [langs[i] for i in agree])


def stretches(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with (part, lang, confidence, stretch): one row for each stretch of ``caption``."""
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("part", T.IntegerType()), T.StructField("lang", T.StringType()),
                           T.StructField("confidence", T.DoubleType()), T.StructField("stretch", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [model.stretches(t) for t in b["caption"]]
            at = np.repeat(np.arange(len(b)), [len(o) for o in out])
            flat = [s for o in out for s in o]
            frame = b[keep].iloc[at].reset_index(drop=True)
            for i, (name, kind) in enumerate((("part", "int32"), ("lang", object), ("confidence", "float64"), ("stretch", object))):
                frame[name] = pd.Series([s[i] for s in flat], dtype=kind)
            yield frame

    return rows.select(*keep, "caption").mapInPandas(run, schema)


def corrections(parts: DataFrame) -> DataFrame:
    """(video_id, idx, lang) of stretches whose caption is unlabelled, wrongly labelled or mixed.

    ``parts`` are the stretches with video_id, idx and label (null where missing).
    """
    per = parts.groupBy("video_id", "idx").agg(
        F.collect_set("lang").alias("langs"), F.max(F.coalesce(F.col("label"), F.lit("?"))).alias("label"))
    wrong = (F.size("langs") > 1) | (F.col("label") != F.col("langs")[0])
    return per.where(wrong).select("video_id", "idx", F.explode("langs").alias("lang"))
