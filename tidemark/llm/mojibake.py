"""Texts decoded with a wrong character encoding, found and restored by character n-gram likelihood.

A smoothed character bigram model (interpolated with unigrams) is counted over all clean records:
those without replacement characters, control characters of the C1 range, private-use characters or
byte sequences that re-decode as UTF-8. The counts are hashed into tables of a fixed size, so what
is sent to the executors doesn't grow with the corpus.

A stretch of a text is tried if the model finds one of its transitions less likely than 2^-``USUAL``
(a stretch of usual transitions only has no sign of a wrong decoding) or if it mixes letters as single-byte
confusions do. It is then put through each candidate chain: encode by the encoding it may have
been decoded with (``WRONG``), decode strictly by the one it may have been written in (``RIGHT``),
up to twice. The likeliest result is accepted if its likelihood exceeds the stretch's own by
``margin`` bits. ``fit`` counts all texts, by ``FOLDS`` folds of their hashes, judges every text by the counts of the other
folds and takes the least of ``MARGINS`` that would change no more than ``MOST_CHANGED`` of those without a structural sign
(true cases hide among them). What is sent to the executors for that are the counts of each fold.
A record is also reported, though not restorable there, where characters were lost (U+FFFD) or
where C1 or private-use characters remain.

Defined results: null, empty and ASCII texts are never garbled; a restored text keeps everything
outside the accepted stretches; equal texts get equal results; repeated rows of a key give one row;
very long texts are processed whole, stretch by stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

MARGIN = 7.0
MARGINS = (7.0, 10.0, 14.0, 20.0)
FOLDS, MOST_CHANGED = 4, 0.03
USUAL = 12.0
UNI_BITS, BI_BITS = 17, 20

# Python codec names.
WRONG_SINGLE = ("cp1252", "mac_roman", "cp1251", "cp850")
WRONG_MULTI = ("cp949", "gbk", "cp932", "big5")
RIGHT_MULTI = ("cp949", "gbk", "cp932", "big5", "euc_jp")
SINGLE_PAIRS = (("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp850", "cp1252"))

_LOST = re.compile("[�\x80-\x84\x86-\x9f-]")
_PIECE = re.compile(r"(?<=[.!?。！？])\s+|[\r\n]+|\"|\s+/\s+")
_UTF8 = re.compile(r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: A symbol, a Cyrillic letter or a capital with a mark right behind a Latin letter.
_MIXED = re.compile("[A-Za-z][\x80-\xb6\xb8-\xba\xbc-\xbf\xd7\xf7\u0400-\u04ff\u2020-\u2025\u2027-\u2bff]|[a-z][\xc0-\xd6\xd8-\xde]")


def _byte_map(codec: str) -> dict[int, str]:
    """Code point -> Latin-1 character of its byte; undefined bytes stand for themselves, as lenient decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_MAPS = {c: _byte_map(c) for c in WRONG_SINGLE}
_MAPS["latin_1"] = {b: chr(b) for b in range(128, 256)}
_SINGLE = {(a, b): {p: bytes([ord(x)]).decode(b, "replace") for p, x in _MAPS[a].items() if not 0x80 <= p < 0xa0} for a, b in SINGLE_PAIRS}
_SPANS = {c: re.compile("[\x00-\x7f" + "".join(re.escape(chr(p)) for p in sorted(m)) + "]+") for c, m in _MAPS.items()}
_HIGH = re.compile("[^\x00-\x7f]")


def _class(low: int, high: int) -> str:
    return "[" + "".join(re.escape(chr(p)) for p in sorted({p for m in _MAPS.values() for p, x in m.items() if low <= ord(x) <= high})) + "]"


#: A byte that may begin a UTF-8 character, then one that may go on with it, in any of the single-byte encodings.
_BEGUN = re.compile(_class(0xc2, 0xf4) + _class(0x80, 0xbf))
_ANY_SINGLE = re.compile("[" + "".join(re.escape(chr(p)) for p in sorted({p for m in _MAPS.values() for p in m})) + "]")


def _utf8_inside(text: str, codec: str) -> str:
    """Every byte sequence of ``codec`` that is a UTF-8 character, decoded; the rest as it is."""
    table = _MAPS[codec]
    out, last = [], 0
    for m in _SPANS[codec].finditer(text):
        raw = m.group()
        if not _HIGH.search(raw):
            continue
        mapped = raw.translate(table)
        at, changed = 0, []
        for u in _UTF8.finditer(mapped):
            try:
                c = u.group().encode("latin_1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            changed += [raw[at:u.start()], c]
            at = u.end()
        if changed:
            out += [text[last:m.start()], *changed, raw[at:]]
            last = m.end()
    return "".join(out) + text[last:] if out else text


def _multi_inside(text: str, codec: str, rights: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """(right, text) for each multi-byte ``right``: every span that ``codec`` can write, decoded strictly by it."""
    table = _MAPS[codec]
    spans = []
    for m in _SPANS[codec].finditer(text):
        raw = m.group()
        if len(_HIGH.findall(raw)) < 2:
            continue
        try:
            spans.append((m.start(), m.end(), raw.translate(table).encode("latin_1")))
        except UnicodeError:
            continue
    for right in rights if spans else ():
        out, last = [], 0
        for lo, hi, raw in spans:
            try:
                new = raw.decode(right)
            except UnicodeError:
                continue
            out += [text[last:lo], new]
            last = hi
        yield right, "".join(out) + text[last:] if out else text


def candidates(text: str) -> list[tuple[str, str]]:
    """(chain, result) of every chain that changes the text."""
    out: dict[str, str] = {}
    if not _HIGH.search(text):
        return []
    lost = "�" in text
    if _ANY_SINGLE.search(text):
        for codec in (*WRONG_SINGLE, "latin_1") if _BEGUN.search(text) else ():
            one = _utf8_inside(text, codec)
            if one != text:
                out.setdefault(one, f"{codec}>utf_8")
                two = _utf8_inside(one, codec)
                if two != one:
                    out.setdefault(two, f"{codec}>utf_8 twice")
                    three = _utf8_inside(two, codec)
                    if three != two:
                        out.setdefault(three, f"{codec}>utf_8 three times")
        if not lost:
            for codec in ("cp1252", "latin_1", "mac_roman"):
                for right, new in _multi_inside(text, codec, RIGHT_MULTI):
                    if new != text:
                        out.setdefault(new, f"{codec}>{right}")
            for codec, right in SINGLE_PAIRS:
                new = text.translate(_SINGLE[codec, right])
                if new != text:
                    out.setdefault(new, f"{codec}>{right}")
    if lost:
        return [(chain, new) for new, chain in out.items()]
    for codec in WRONG_MULTI:
        try:
            raw = text.encode(codec)
        except UnicodeEncodeError:
            continue
        for right in ("utf_8", "cp1252", *RIGHT_MULTI):
            if right != codec:
                try:
                    new = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if new != text:
                    out.setdefault(new, f"{codec}>{right}")
    return [(chain, new) for new, chain in out.items()]


def is_clean(text: str) -> bool:
    """No structural sign of a wrong decoding."""
    return not _LOST.search(text) and (
        text.isascii() or not _BEGUN.search(text) or all(_utf8_inside(text, c) == text for c in (*WRONG_SINGLE, "latin_1")))


def _codes(text: str) -> np.ndarray:
    """Code points, all digits as 0."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where((c >= 48) & (c <= 57), np.uint32(48), c)


def _uni(c: np.ndarray) -> np.ndarray:
    return (c * np.uint32(2654435761)) >> np.uint32(32 - UNI_BITS)


def _bi(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * np.uint32(0x9E3779B1) ^ (c * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BI_BITS)


@dataclass
class Model:
    uni: np.ndarray  # log2 probabilities, float32
    bi: np.ndarray  # counts, float32
    context: np.ndarray  # counts of contexts, float32
    strength: float = 4.0

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log2 likelihood of each text, that of its least likely transition)."""
        if not texts:
            return np.zeros(0), np.zeros(0)
        c = _codes("\n" + "\n".join(texts))
        n = np.array([len(t) for t in texts])
        begin = np.cumsum(n + 1) - n
        with np.errstate(over="ignore"):
            u = _uni(c)
            low = self.uni[u]
            pair = self.bi[_bi(c[:-1], c[1:])]
        p = np.zeros(len(c))
        p[1:] = np.log2((pair + self.strength * np.exp2(low[1:])) / (self.context[u[:-1]] + self.strength))
        p[begin - 1] = 0.0
        return np.add.reduceat(p, begin - 1), np.minimum.reduceat(p, begin - 1)


def _model(uni: np.ndarray, bi: np.ndarray) -> Model:
    low = np.log2((uni + 0.02) / (uni.sum(dtype=np.float64) + 0.02 * len(uni)))
    return Model(low.astype(np.float32), bi.astype(np.float32, copy=False), uni.astype(np.float32))


def _fold(text: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(text)), F.lit(folds)).cast("int")


def _counts(texts: DataFrame, text: str, folds: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(unigrams, bigrams) of the clean records of each fold, and their number."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uni, bi, clean = np.zeros((folds, 1 << UNI_BITS), np.int64), np.zeros((folds, 1 << BI_BITS), np.int64), 0
        for b in batches:
            for f, own in b.groupby("fold")[text]:
                kept = [t for t in own if t and is_clean(t)]
                clean += len(kept)
                if kept:
                    c = _codes("\n" + "\n".join(kept) + "\n")  # the same counts whatever texts come together
                    with np.errstate(over="ignore"):
                        uni[f] += np.bincount(_uni(c[1:]), minlength=1 << UNI_BITS)
                        bi[f] += np.bincount(_bi(c[:-1], c[1:]), minlength=1 << BI_BITS)
        for kind, table in enumerate((uni, bi, np.array([[clean]]))):
            f, k = np.nonzero(table)
            yield pd.DataFrame({"kind": np.full(len(k), kind, np.int32), "fold": f.astype(np.int32), "cell": k.astype(np.int32), "n": table[f, k]})

    got = texts.where(F.col(text).isNotNull()).select(text, _fold(text, folds).alias("fold")) \
        .mapInPandas(count, "kind int, fold int, cell int, n bigint").groupBy("kind", "fold", "cell").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((folds, 1 << UNI_BITS), np.int64), np.zeros((folds, 1 << BI_BITS), np.int64), np.zeros((1, 1), np.int64)
    for kind, table in enumerate(tables):
        own = got[got.kind == kind]
        table[own.fold.to_numpy(), own.cell.to_numpy()] = own.n.to_numpy()
    return tables[0], tables[1], int(tables[2][0, 0])


def train(texts: DataFrame, text: str = "text") -> Model:
    """Counts of all clean records; the tables have 2^UNI_BITS and 2^BI_BITS cells whatever the corpus."""
    uni, bi, _ = _counts(texts, text, 1)
    return _model(uni[0], bi[0])


def _judged(df: DataFrame, key: str, text: str, folds: int) -> tuple[Model, float, DataFrame]:
    """(model, margin, records and texts that the least margin reports, as it restores them): every text is tried once by the model and by the counts of the other folds."""
    uni, bi, clean = _counts(df, text, folds)
    whole = _model(uni.sum(axis=0), bi.sum(axis=0))
    counts = [(uni.sum(axis=0) - u, (bi.sum(axis=0) - b).astype(np.float32)) for u, b in zip(uni, bi)]
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        others = [_model(u, b) for u, b in counts]
        changed = np.zeros(len(MARGINS), np.int64)
        for b in batches:
            kept = []
            for f, own in b.groupby("fold"):
                # A few at a time: the candidates of a text are many times its size.
                for lo in range(0, len(own), 256):
                    part, known = own.iloc[lo:lo + 256], {}
                    whole_texts = part["text"].tolist()
                    got = restore(whole_texts, whole, MARGINS[0], known)
                    hit = [i for i, g in enumerate(got) if g[1] or g[2]]
                    if hit:
                        kept.append(part[["record", "text"]].iloc[hit].assign(restored=[got[i][0] for i in hit], chains=[got[i][1] for i in hit], lost=[got[i][2] for i in hit]))
                    for t, n, g in zip(whole_texts, part["n"].tolist(), restore(whole_texts, others[f], MARGINS[0], known)):
                        if g[1] and is_clean(t):
                            changed += n * (g[3] > np.array(MARGINS))
            if kept:
                yield pd.concat(kept).assign(margin=np.nan, n=0)
        yield pd.DataFrame({"record": None, "text": None, "restored": None, "chains": None, "lost": None, "margin": MARGINS, "n": changed})

    # The work is larger than the text: spread it evenly, whatever the files are like; repeated rows are one.
    rows = df.select(F.col(key).alias("record"), F.col(text).alias("text")).where("text rlike '[^\\\\x00-\\\\x7f]'") \
        .withColumn("fold", _fold("text", folds)).groupBy("record", "text", "fold").agg(F.count("*").alias("n"))
    tried = cut_lineage(rows.mapInPandas(judge, f"record {kind}, text string, restored string, chains array<string>, lost boolean, margin double, n bigint"))
    changed = {r.margin: r.n for r in tried.where("text IS NULL").groupBy("margin").agg(F.sum("n").alias("n")).collect()}
    margin = next((m for m in MARGINS if changed.get(m, 0) <= MOST_CHANGED * clean), MARGINS[-1])
    return whole, margin, tried.where("text IS NOT NULL")


def fit(texts: DataFrame, text: str = "text", folds: int = FOLDS) -> tuple[Model, float]:
    """(model, margin) of all texts; for the margin each is judged by the counts of the other folds."""
    return _judged(texts, text, text, folds)[:2]


def fitted_repairs(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """``repaired`` by the model and the margin of ``fit`` on the same records."""
    model, margin, reported = _judged(df, key, text, folds)
    if margin == MARGINS[0]:
        return reported.select(F.col("record").alias(key), "restored", "chains", "lost")
    return repaired(reported.select(F.col("record").alias(key), F.col("text").alias(text)), model, key, text, margin)


def restore(texts: list[str | None], model: Model, margin: float = MARGIN, known: dict[str, list] | None = None) -> list[tuple[str | None, list[str], bool, float]]:
    """(restored text, chains, anything lost, largest gain in bits) for each text; ``known``: candidates of stretches met before."""
    known = {} if known is None else known
    pieces: list[tuple[int, int, int]] = []  # text, begin, end
    for i, t in enumerate(texts):
        if not t or t.isascii():
            continue
        at = 0
        for m in _PIECE.finditer(t):
            pieces.append((i, at, m.start()))
            at = m.end()
        pieces.append((i, at, len(t)))
    pieces = [(i, lo, hi) for i, lo, hi in pieces if not texts[i][lo:hi].isascii()]
    own, least = model.score([texts[i][lo:hi] for i, lo, hi in pieces])
    jobs: list[tuple[int, str, int]] = []  # piece, chain, place of its result
    scored: list[str] = []
    for k, (i, lo, hi) in enumerate(pieces):
        piece = texts[i][lo:hi]
        if least[k] < -USUAL or _MIXED.search(piece):
            if piece not in known:
                known[piece] = candidates(piece)
            for chain, new in known[piece]:
                jobs.append((k, chain, len(scored)))
                scored.append(new)
    bits, _ = model.score(scored)
    best: dict[tuple[int, int, int], tuple[float, str, str]] = {}
    top = [float("-inf")] * len(texts)
    for k, chain, other in jobs:
        i, lo, hi = pieces[k]
        gain = float(bits[other] - own[k])
        top[i] = max(top[i], gain)
        if gain > margin and gain > best.get((i, lo, hi), (margin,))[0]:
            best[i, lo, hi] = gain, chain, scored[other]
    out: list[tuple[str | None, list[str], bool, float]] = []
    by: dict[int, list] = {}
    for (i, lo, hi), (_, chain, new) in best.items():
        by.setdefault(i, []).append((lo, hi, chain, new))
    for i, t in enumerate(texts):
        new, chains = t, []
        for lo, hi, chain, piece in sorted(by.get(i, ()), reverse=True):
            new = new[:lo] + piece + new[hi:]
            chains.append(chain)
        lost = bool(t and _LOST.search(new))
        out.append((new, sorted(set(chains)), lost, top[i]))
    return out


def repaired(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(key, restored, chains, lost): the records with garbled text; ``lost`` where something stays unrestorable."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = b[text].tolist()
            # A few at a time: the candidates of a text are many times its size.
            got = [g for lo in range(0, len(whole), 256) for g in restore(whole[lo:lo + 256], model, margin)]
            hit = [i for i, g in enumerate(got) if g[1] or g[2]]
            if hit:
                yield pd.DataFrame({key: b[key].iloc[hit].to_numpy(), "restored": [got[i][0] for i in hit],
                                    "chains": [got[i][1] for i in hit], "lost": [got[i][2] for i in hit]})

    # The work is larger than the text: spread it evenly, whatever the files are like; repeated rows are one.
    rows = df.select(key, text).where(F.col(text).rlike("[^\\x00-\\x7f]")).distinct()
    return rows.mapInPandas(run, f"`{key}` {kind}, restored string, chains array<string>, lost boolean")


def validate(texts: list[str], model: Model, margin: float = MARGIN) -> float:
    """Share of held-out clean texts that the margin would change."""
    clean = [t for t in texts if t and is_clean(t)]
    return sum(bool(g[1]) for g in restore(clean, model, margin)) / max(1, len(clean))
