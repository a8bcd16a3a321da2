"""One relational text for two engines: Spark SQL for the queries, ANSI-like SQL for their check.

A builder gets a dialect and returns SQL; the few constructs that differ are methods here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import table


class Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark
        self.tables: set[str] = set()

    def t(self, name: str) -> str:
        self.tables.add(name)
        return f"tm_{name}" if self.spark else name

    def at(self, a: str, i: int | str) -> str:
        return f"get({a}, {i})" if self.spark else f"{a}[({i}) + 1]"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def seq(self, lo: str, hi: str) -> str:
        """Integers from lo to hi, empty if hi < lo."""
        return (f"(CASE WHEN ({hi}) >= ({lo}) THEN sequence(CAST({lo} AS INT), CAST({hi} AS INT)) ELSE CAST(array() AS ARRAY<INT>) END)"
                if self.spark else f"range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1)")

    def each(self, source: str, array: str, col: str) -> str:
        """A FROM item with one row for each element."""
        return f"{source} LATERAL VIEW explode({array}) x_{col} AS {col}" if self.spark else f"{source}, unnest({array}) AS x_{col}({col})"

    def text(self, a: str, sep: str = "") -> str:
        return f"array_join({a}, '{sep}')" if self.spark else f"array_to_string({a}, '{sep}')"

    def first(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})" if self.spark else f"{a}[1:{n}]"

    def cat(self, *arrays: str) -> str:
        if self.spark:
            return f"concat({', '.join(arrays)})"
        return arrays[0] if len(arrays) == 1 else f"list_concat({arrays[0]}, {self.cat(*arrays[1:])})"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})" if self.spark else f"list_contains({a}, {x})"

    def pct(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"

    def draw(self, mod: str, *parts: str) -> str:
        """A hash of the parts below ``mod``: the same pseudo-random integer in both engines."""
        text = "concat_ws('|', " + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ")"
        return (f"(CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT) % {mod})" if self.spark
                else f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {mod})")

    def poisson(self, h: str) -> str:
        """How often a row is drawn in a bootstrap replicate: a Poisson number of mean 1, from a hash below 2^32."""
        # The distribution function of the Poisson law of mean 1, times 2^32.
        steps = (1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778, 4294923276)
        return "(" + " + ".join(f"CASE WHEN {h} >= {x} THEN 1 ELSE 0 END" for x in steps) + ")"

    def rx(self, c: str, p: str) -> str:
        return f"({c} RLIKE r'{p}')" if self.spark else f"regexp_matches({c}, '{p}')"

    def rep(self, c: str, p: str, r: str = "") -> str:
        return f"regexp_replace({c}, r'{p}', '{r}')" if self.spark else f"regexp_replace({c}, '{p}', '{r}', 'g')"

    def find(self, c: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({c}, r'{p}', {group})" if self.spark else f"regexp_extract_all({c}, '{p}', {group})"

    def join(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({x}, '{sep}' ORDER BY {order})"

    def dot(self, a: str, b: str) -> str:
        return (f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)" if self.spark
                else f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))")

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def collect(self, x: str) -> str:
        return f"array_sort(collect_list({x}))" if self.spark else f"list_sort(list({x}))"

    def words(self, c: str) -> str:
        return f"filter(split({c}, '[ \\\\t\\\\r\\\\n]+'), w -> w <> '')" if self.spark else f"""list_filter(regexp_split_to_array({c}, '[ \\t\\r\\n]+'),
        lambda w: w <> '')"""

    def uniq(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))" if self.spark else f"list_sort(list_distinct({a}))"

    def meet(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def sha(self, c: str) -> str:
        return f"sha2({c}, 256)" if self.spark else f"sha256({c})"

    def map_(self, a: str, f: str) -> str:
        name, _, body = f.partition(" -> ")
        return f"transform({a}, {f})" if self.spark else f"list_transform({a}, lambda {name}: {body})"

    def keep(self, a: str, f: str) -> str:
        name, _, body = f.partition(" -> ")
        return f"filter({a}, {f})" if self.spark else f"list_filter({a}, lambda {name}: {body})"

    def split(self, c: str, p: str) -> str:
        return f"split({c}, r'{p}')" if self.spark else f"regexp_split_to_array({c}, '{p}')"

    def low(self, a: str) -> str:
        return f"array_min({a})" if self.spark else f"list_min({a})"

    def high(self, a: str) -> str:
        return f"array_max({a})" if self.spark else f"list_max({a})"


Builder = Callable[[Dialect], str]


def spark_query(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        dialect = Dialect(True)
        sql = build(dialect)
        for name in dialect.tables:
            table(spark, d, name).createOrReplaceTempView(f"tm_{name}")
        return spark.sql(sql)

    return run


def register(builders: dict[str, Builder]) -> tuple[dict, dict[str, str]]:
    """(queries, SQL) of a module's builders."""
    return {n: spark_query(b) for n, b in builders.items()}, {n: b(Dialect(False)) for n, b in builders.items()}


# The scripts that count as foreign in a caption.
FOREIGN = "一-鿿぀-ヿ"


def corrupted(D: Dialect, c: str) -> str:
    """Three foreign letters, more than a fifth of them, a phrase of 3 to 20 characters three times in a row, or a word that is
    more than 40 % of at least six."""
    n = f"length({D.rep(c, f'[^{FOREIGN}]')})"
    if D.spark:
        phrase = f"{c} RLIKE r'(?s)(.{{3,20}}?)\\1{{2,}}'"
    else:
        # The check engine's patterns can't refer back: every place is compared with what follows it.
        phrase = (f"len(list_filter(range(1, length({c}) + 1), lambda p: len(list_filter(range(3, 21), lambda k: p + 3 * k - 1 <= length({c}) AND "
                  f"substring({c}, p, k) = substring({c}, p + k, k) AND substring({c}, p, k) = substring({c}, p + 2 * k, k) "
                  f"AND NOT contains(substring({c}, p, k), chr(10)))) > 0)) > 0")
    words = D.words(c)
    if D.spark:
        most = f"coalesce(array_max(transform(array_distinct({words}), d -> size(filter({words}, w -> w = d)))), 0)"
    else:
        most = f"coalesce(list_max(list_transform(list_distinct({words}), lambda d: len(list_filter({words}, lambda w: w = d)))), 0)"
    return f"coalesce({c} <> '' AND ({n} >= 3 OR {n} > 0.2e0 * length({c}) OR {phrase} OR ({D.size(words)} >= 6 AND {most} > 0.4e0 * {D.size(words)})), false)"


# Phrases that are a subtitle's credit as a whole, and instructions inside a text.
CREDITS = (r"한글\s*자막\s*(by|바이|제공|제작)\s*[:：]?\s*.{0,20}", r"자막\s*(제공|제작|by)\s*[:：]?\s*.{0,20}", r".{0,30}amara\.org.{0,40}")
INSTRUCTIONS = (r"이전\s*지시", r"위\s*지시", r"다음\s*지시를?\s*따라", r"지시를\s*따라", "무시하고", "무시해", r"위\s*규칙을?\s*무시", r"시스템\s*프롬프트",
                r"system\s*prompt", r"ignore\s*(previous|above|all)\s*instructions?", r"너는\s*이제", r"당신은\s*이제")
QUALITY_NOTE, INSTRUCTION_NOTE = "(캡션 품질 문제로 제외됨)", "(지시문 의심으로 제외됨)"
# Spellings of a missing value, after trimming and lower-casing.
MISSING = ("unknown", "n/a", "na", "none", "null", "nil", "nan", "pending", "tbd", "todo", "missing", "undefined", "unspecified", "미상", "없음")


# What marks speech in a query, and speech together with something seen; the kinds of queries.
SPEECH = "라고|라는 (자막|말|제안|설명)|자막|말하|이야기|소개하|부탁하|당부|설명하|묻는|대답|외치"
SEEN_WITH = "함께.*(보이|뜨|나오)|보이는.*자막|자막.*(함께|위에)|함께"
KINDS = ("자막형", "장면형", "복합형")


def kind_of(D: Dialect, c: str) -> str:
    """Without a mark of speech a scene, with speech and something seen both, else speech."""
    return f"CASE WHEN NOT {D.rx(c, SPEECH)} THEN '{KINDS[1]}' WHEN {D.rx(c, SEEN_WITH)} THEN '{KINDS[2]}' ELSE '{KINDS[0]}' END"


def body(D: Dialect, c: str) -> str:
    """A sentence without its bracketed citations."""
    return "trim(" + D.rep(c, r"\s*\[seg#[^\]]*\]\s*") + ")"


def credit(D: Dialect, c: str) -> str:
    whole = "|".join(f"(?:{x})" for x in CREDITS)
    return "coalesce(" + D.rx(f"trim({c})", rf"(?i)^(?:{whole})$") + ", false)"


def suspicious(D: Dialect, c: str) -> str:
    return "coalesce(" + D.rx(c, "(?i)" + "|".join(f"(?:{x})" for x in INSTRUCTIONS)) + ", false)"


def strip_foreign(D: Dialect, c: str) -> str:
    return f"trim({D.rep(D.rep(c, f'[{FOREIGN}]+'), '[ ][ ]+', ' ')})"


def to_sentence(D: Dialect, c: str) -> str:
    """Up to the last sentence end, without blanks behind; unchanged where there is none."""
    ends = "。．.!?！？…"
    return f"CASE WHEN {D.rx(c, f'[{ends}]')} THEN {D.rep(c, f'[^{ends}]*$')} ELSE {c} END"


def clean_for_report(D: Dialect, caption: str) -> str:
    """A caption as a report may read it: a note instead of a corrupted or instructing one, else without foreign letters."""
    return (f"CASE WHEN {corrupted(D, caption)} THEN '{QUALITY_NOTE}' WHEN {suspicious(D, strip_foreign(D, caption))} THEN '{INSTRUCTION_NOTE}' "
            f"ELSE {strip_foreign(D, f'coalesce({caption}, {chr(39) * 2})')} END")


def narration(D: Dialect, c: str) -> str:
    """A sentence without its citations and without dashes, dots and commas around it."""
    bare = D.rep(c, r"(?i)\[?\s*seg\s*#\s*\d+\s*(?:,\s*seg\s*#\s*\d+\s*)*\]?")
    return D.rep(D.rep(bare, r"^[ \-–—·,.\t]+"), r"[ \-–—·,.\t]+$")


def present(D: Dialect, c: str) -> str:
    """Whether a registry value is more than a spelling of "missing"."""
    return f"coalesce({D.rx(c, '[0-9A-Za-z가-힣]')} AND lower(trim({c})) NOT IN ({', '.join(repr(m) for m in MISSING)}), false)"


def hashed(D: Dialect, source: str, group: str, seed: str, *keys: str) -> str:
    """hk: the rows of ``source`` with rn, their rank by hash in their group, and n, its size.

    Ranks are counted within ranges of the hash and moved by the sizes of the ranges before, so no task sorts a whole group.
    """
    return (f"hb AS (SELECT x.*, coalesce(CAST({group} AS STRING), '?') AS grp, {D.draw('4294967296', seed, *keys)} AS h FROM (SELECT * FROM {source}) x), "
            f"hc AS (SELECT grp, {D.idiv('h', '1048576')} AS part, count(*) AS c FROM hb GROUP BY grp, {D.idiv('h', '1048576')}), "
            "hs AS (SELECT grp, part, coalesce(sum(c) OVER (PARTITION BY grp ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, "
            "sum(c) OVER (PARTITION BY grp) AS n FROM hc), "
            f"hk AS (SELECT hb.*, hs.n, hs.base + row_number() OVER (PARTITION BY hb.grp, hs.part ORDER BY hb.h, {', '.join('hb.' + k for k in keys)}) AS rn "
            f"FROM hb JOIN hs ON hs.grp = hb.grp AND hs.part = {D.idiv('hb.h', '1048576')})")


# Shared sources; repeated rows of a key are one row.

def seg(D: Dialect) -> str:
    return (f"seg AS (SELECT video_id, idx, max(start_sec) AS s, max(end_sec) AS e, max(subtitle) AS sub, max(caption) AS cap, max(caption_arm) AS arm, "
            f"max(motion_score) AS motion, bool_or(is_static) AS still FROM {D.t('segments')} GROUP BY video_id, idx)")


def qry(D: Dialect) -> str:
    return (f"qry AS (SELECT DISTINCT query_id, video_id, text, query_type, gt_start, gt_end, gt_seg_idx AS gt, lower(trim(split)) AS split "
            f"FROM {D.t('queries_dev_only')})")


def rep(D: Dialect) -> str:
    return f"rep AS (SELECT DISTINCT report_id, sent_id, video_id, model, text, cites FROM {D.t('report')})"


def inv(D: Dialect) -> str:
    return (f"inv AS (SELECT DISTINCT video_id, event_no, event, start_sec AS s, end_sec AS e, span, seg_idx FROM {D.t('frozen_kheritage_grave_excavation')})")


def index(D: Dialect, queried: bool = False) -> str:
    """vi, vn: the usable vectors, one row of a vec_id, without and with norms; ``queried``: only of videos that have queries."""
    only = "AND video_id IN (SELECT video_id FROM qry)" if queried else ""
    return f"""vi AS (SELECT vec_id, max(video_id) AS video_id, max(idx) AS idx, any_value(emb_sub) AS es, any_value(emb_cap) AS ec,
       coalesce(bool_or(static_mask), false) AS mask FROM {D.t('videoindex')}
       WHERE {D.size('emb_cap')} = 64 AND (emb_sub IS NULL OR {D.size('emb_sub')} = 64) {only} GROUP BY vec_id),
vn AS (SELECT *, sqrt({D.dot('ec', 'ec')}) AS nc, sqrt({D.dot('es', 'es')}) AS ns FROM vi)"""


def scores(D: Dialect) -> str:
    """sc: both channels' cosine of every query against the segments of its own video.

    The stand-in for a query's vector is the caption vector of its first true segment that is indexed; a query without one
    takes that of the video's first indexed segment and has no right answer there (rank 0).
    """
    return f"""{qry(D)}, {index(D, True)},
q1 AS (SELECT query_id, video_id, query_type, split, gt FROM qry WHERE query_id IS NOT NULL AND {D.size('gt')} > 0),
tr AS (SELECT g.query_id, min(g.i) AS i FROM (SELECT query_id, video_id, i FROM {D.each('q1', 'gt', 'i')}) g
       JOIN (SELECT video_id, idx FROM vi) k ON k.video_id = g.video_id AND k.idx = g.i GROUP BY g.query_id),
lo AS (SELECT video_id, min(idx) AS i FROM vi GROUP BY video_id),
qp AS (SELECT q1.*, coalesce(tr.i, lo.i) AS place FROM q1 JOIN lo ON lo.video_id = q1.video_id LEFT JOIN tr ON tr.query_id = q1.query_id),
qv AS (SELECT q.query_id, q.video_id, q.query_type, q.split, q.gt, v.ec AS qe, v.nc AS qn FROM qp q JOIN vn v ON v.video_id = q.video_id AND v.idx = q.place),
sc AS (SELECT q.query_id, q.video_id, q.query_type, q.split, v.idx, v.mask, {D.has('q.gt', 'v.idx')} AS good,
       round(coalesce({D.dot('v.es', 'q.qe')} / nullif(v.ns * q.qn, 0e0), 0e0), 9) AS ss,
       round(coalesce({D.dot('v.ec', 'q.qe')} / nullif(v.nc * q.qn, 0e0), 0e0), 9) AS sp
       FROM qv q JOIN vn v ON v.video_id = q.video_id)"""


def zscore(x: str, by: str = "query_id") -> str:
    """Population z-score over a query's rows, 0 where they don't vary."""
    w = f"OVER (PARTITION BY {by})"
    return f"CASE WHEN stddev_pop({x}) {w} < 1e-9 THEN 0e0 ELSE ({x} - avg({x}) {w}) / stddev_pop({x}) {w} END"


def minmax(x: str, by: str = "query_id") -> str:
    w = f"OVER (PARTITION BY {by})"
    return f"CASE WHEN max({x}) {w} - min({x}) {w} < 1e-9 THEN 0e0 ELSE ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END"


def ranked(D: Dialect, alpha: str = "0.5e0") -> str:
    """rk: fused and ranked; the caption channel of static segments is replaced after the normalisation."""
    return f"""{scores(D)},
zz AS (SELECT *, {zscore('ss')} AS zs, {zscore('sp')} AS zp FROM sc),
fu AS (SELECT *, round({alpha} * zs + (1e0 - {alpha}) * CASE WHEN mask THEN zs ELSE zp END, 8) AS score FROM zz),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM fu)"""


#: rr: rank and reciprocal rank per query for the baseline (subtitle only) and the fused order.
def paired(D: Dialect) -> str:
    return f"""{scores(D)},
zz AS (SELECT *, {zscore('ss')} AS zs, {zscore('sp')} AS zp FROM sc),
f2 AS (SELECT query_id, video_id, query_type, idx, good, row_number() OVER (PARTITION BY query_id ORDER BY round(zs, 8) DESC, idx) AS r0,
       row_number() OVER (PARTITION BY query_id ORDER BY round(0.5e0 * zs + 0.5e0 * CASE WHEN mask THEN zs ELSE zp END, 8) DESC, idx) AS r1 FROM zz),
rr AS (SELECT query_id, max(video_id) AS video_id, max(query_type) AS query_type, count(*) AS n,
       coalesce(min(CASE WHEN good THEN r0 END), 0) AS k0, coalesce(min(CASE WHEN good THEN r1 END), 0) AS k1,
       coalesce(1e0 / min(CASE WHEN good THEN r0 END), 0e0) AS m0, coalesce(1e0 / min(CASE WHEN good THEN r1 END), 0e0) AS m1
       FROM f2 GROUP BY query_id)"""
