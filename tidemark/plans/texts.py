"""Text predicates, cleaning, n-gram scoring, citations, hashes and provenance checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans import dialect as T
from tidemark.plans.dialect import Dialect, register, rep, seg
from tidemark.sources.tables import table

CJK = "぀-ヿ㐀-鿿"

# What a scan for secrets looks for.
SECRETS = {"ssh_private_key": "-----BEGIN (?:OPENSSH|RSA|EC|DSA) PRIVATE KEY-----", "openai_key": r"\bsk-[A-Za-z0-9_-]{20,}", "hf_token": r"\bhf_[A-Za-z0-9]{20,}",
           "github_pat": r"\bgh[pousr]_[A-Za-z0-9]{20,}", "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
           "private_ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b:?\s*(?:22|2222)\b", "err_code": "err_code=0x[0-9a-f]+", "email": "[A-Za-z0-9.]+@[A-Za-z0-9]+[.][a-z]+"}
# Syllables and words that are numbers.
NUMBER = "(?:[영공일이삼사오육칠팔구십백천만억조쩜점]|하나|둘|셋|넷|다섯|여섯|일곱|여덟|아홉|열|스물|서른|마흔|쉰|예순|일흔|여든|아흔)+"
POLITE, PLAIN = r"(니다|세요|어요|아요)[.]?$", "다[.]?$"


def docs(D: Dialect) -> str:
    return f"doc AS (SELECT DISTINCT doc_id, text, lang, source, kind, video_id FROM {D.t('documents')})"


def caps(D: Dialect) -> str:
    return f"{seg(D)}, cap AS (SELECT video_id, idx, arm, cap, {D.rep('cap', f'[^{CJK}]')} AS cjk FROM seg WHERE cap IS NOT NULL)"


def cites(D: Dialect) -> str:
    """ct: citations as parsed from the sentence, distinct and ascending."""
    nums = D.map_(D.find("text", "seg#([0-9]+)", 1), "x -> CAST(x AS INT)")
    return f"{rep(D)}, ct AS (SELECT report_id, sent_id, video_id, model, text, {D.uniq(nums)} AS c, cites FROM rep WHERE text IS NOT NULL)"


def grams(D: Dialect, c: str, n: int) -> str:
    return D.map_(D.seq("1", f"length({c}) - {n - 1}"), f"p -> substring({c}, p, {n})" if D.spark else f"p -> substring({c}, CAST(p AS INT), {n})")


#: White space as the reference's tokens leave it out.
BLANK = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def bm25(D: Dialect) -> str:
    """All 2-grams and 3-grams as terms; every segment of the video is a document, one without terms too.

    Lengths follow from the texts; only terms of the video's own queries are counted.
    """
    terms = lambda source, keys: f"SELECT {keys}, g FROM {D.each(source, D.cat(grams(D, 'body', 2), grams(D, 'body', 3)), 'g')}"
    return f"""WITH q0 AS (SELECT DISTINCT query_id, {D.rep('text', BLANK)} AS body, video_id FROM {D.t('queries_dev_only')} WHERE text IS
        NOT NULL AND video_id IS NOT NULL),
        qt AS (SELECT query_id, video_id, g, count(*) AS m FROM ({terms('q0', 'query_id, video_id')}) x GROUP BY query_id, video_id, g), vg
        AS (SELECT DISTINCT video_id, g FROM qt),
        d AS (SELECT video_id, idx, {D.rep("coalesce(max(subtitle), '')", BLANK)} AS body FROM {D.t('segments')} WHERE video_id IN (SELECT
        video_id FROM q0) GROUP BY video_id, idx),
        ln AS (SELECT video_id, idx, greatest(0, length(body) - 1) + greatest(0, length(body) - 2) AS len FROM d), st AS (SELECT video_id,
        count(*) AS nd, avg(len * 1e0) AS avl FROM ln GROUP BY video_id),
        tf AS (SELECT t.video_id, t.idx, t.g, count(*) AS n FROM ({terms('d', 'video_id, idx')}) t JOIN vg ON vg.video_id = t.video_id AND
        vg.g = t.g GROUP BY t.video_id, t.idx, t.g),
        df AS (SELECT video_id, g, count(*) AS df FROM tf GROUP BY video_id, g),
        w AS (SELECT tf.video_id, tf.idx, tf.g, ln(1 + (st.nd - df.df + 0.5e0) / (df.df + 0.5e0)) * tf.n * 2.5e0 / (tf.n + 1.5e0 * (0.25e0 +
        0.75e0 * l.len / st.avl)) AS s
        FROM tf JOIN df ON df.video_id = tf.video_id AND df.g = tf.g JOIN ln l ON l.video_id = tf.video_id AND l.idx = tf.idx JOIN st ON
        st.video_id = tf.video_id),
        b AS (SELECT qt.query_id, w.idx, sum(qt.m * w.s) AS s FROM qt JOIN w ON w.video_id = qt.video_id AND w.g = qt.g GROUP BY
        qt.query_id, w.idx),
        r AS (SELECT query_id, idx, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, idx) AS rank FROM b) SELECT
        query_id, idx, round(s, 5) AS score, rank FROM r WHERE rank <= 10"""


#: Segments of a video that one task meets with its queries.
BLOCK = 1024


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment, term of it and query with that term; a block's queries stand before its segments."""
    key, wanted, out = None, {}, []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(MATCHED), MATCHED.values())], list(MATCHED))
        out.clear()
        return made

    for b in batches:
        for video, block, doc, query, nd, avl, idx, body in zip(*(c.to_pylist() for c in b.columns)):
            if (video, block) != key:
                key, wanted = (video, block), {}
            if doc and not wanted:
                continue
            terms = [body[i:i + n] for n in (2, 3) for i in range(len(body) - n + 1)]
            if not doc:
                for g, m in Counter(terms).items():
                    wanted.setdefault(g, []).append((query, m, nd, avl))
                continue
            for g, n in Counter(g for g in terms if g in wanted).items():
                out += [(video, g, idx, query, m, n, len(terms), nd, avl, int(k == 0)) for k, (query, m, nd, avl) in enumerate(wanted[g])]
            if len(out) >= 50_000:
                yield batch()
    yield batch()


MATCHED = {"video_id": pa.string(), "g": pa.string(), "idx": pa.int32(), "query_id": pa.string(), "m": pa.int64(), "n": pa.int64(), "len": pa.int64(), "nd": pa.int64(), "avl": pa.float64(), "first": pa.int64()}


def v21_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``bm25``; only whole texts and the terms that both sides share are shuffled, and no side is broadcast."""
    body = lambda c: F.regexp_replace(c, BLANK, "")
    q = table(spark, d, "queries_dev_only").where("text IS NOT NULL AND video_id IS NOT NULL").select("query_id", body("text").alias("body"), "video_id").distinct()
    docs = table(spark, d, "segments").where("video_id IS NOT NULL").groupBy("video_id", "idx").agg(F.max("subtitle").alias("body")) \
        .select("video_id", F.expr(f"coalesce(idx div {BLOCK}, -1)").alias("block"), "idx", body(F.coalesce("body", F.lit(""))).alias("body"))
    size = F.greatest(F.lit(0), F.length("body") - 1) + F.greatest(F.lit(0), F.length("body") - 2)
    own = Window.partitionBy("video_id")
    blocks = docs.groupBy("video_id", "block").agg(F.count("*").alias("nd"), F.sum(size).alias("len")) \
        .select("video_id", "block", F.sum("nd").over(own).alias("nd"), (F.sum("len").over(own) / F.sum("nd").over(own)).alias("avl"))
    rows = q.join(blocks.hint("merge"), "video_id").select("video_id", "block", F.lit(False).alias("doc"), "query_id", "nd", "avl", F.lit(None).cast("int").alias("idx"), "body") \
        .unionByName(docs.withColumn("doc", F.lit(True)), allowMissingColumns=True)
    found = rows.repartition("video_id", "block").sortWithinPartitions("video_id", "block", "doc") \
        .mapInArrow(_matched, "video_id string, g string, idx int, query_id string, m bigint, n bigint, len bigint, nd bigint, avl double, first bigint")
    df = F.sum("first").over(Window.partitionBy("video_id", "g"))
    w = F.log(1 + (F.col("nd") - df + 0.5) / (df + 0.5)) * F.col("n") * 2.5 / (F.col("n") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avl")))
    b = found.withColumn("w", w).where("idx IS NOT NULL").groupBy("query_id", "idx").agg(F.sum(F.col("m") * F.col("w")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("s", 8).desc(), "idx"))
    return b.withColumn("rank", rank).where("rank <= 10").select("query_id", "idx", F.round("s", 5).alias("score"), "rank")


def summariness(D: Dialect) -> str:
    body, most = T.body(D, "text"), "max(n) * 1e0 / sum(n)"
    share = lambda x: f"""(SELECT report_id, {most} AS share FROM (SELECT report_id, {x} AS k, count(*) AS n FROM s GROUP BY report_id, {x}) y
        GROUP BY report_id)"""  # noqa: E731
    return f"""WITH {rep(D)}, n AS (SELECT video_id, count(DISTINCT idx) AS n FROM {D.t('segments')} GROUP BY video_id), s AS (SELECT *,
        coalesce({D.size('cites')}, 0) > 0 AS cited, {body} AS body FROM rep WHERE text IS NOT NULL),
        f AS (SELECT report_id, {D.low('cites')} AS lo, lag({D.low('cites')}) OVER (PARTITION BY report_id ORDER BY sent_id) AS before FROM
        s WHERE cited), mo AS (SELECT report_id, avg(CASE WHEN lo >= before THEN 1e0 WHEN before IS NOT NULL THEN 0e0 END) AS mono FROM f
        GROUP BY report_id),
        cv AS (SELECT report_id, count(DISTINCT x) AS covered FROM {D.each('s', 'cites', 'x')} GROUP BY report_id), en AS
        {share("right(body, 6)")}, he AS {share(D.at(D.words("coalesce(text, '')"), 0))},
        g AS (SELECT report_id, max(video_id) AS video_id, count(*) AS sentences, avg(CASE WHEN cited THEN length(body) * 1e0 /
        {D.size('cites')} END) AS chars, avg(CASE WHEN cited THEN {D.high('cites')} - {D.low('cites')} + 1e0 END) AS span,
        sum(CASE WHEN {D.size('cites')} >= 10 AND length(body) < 5 * {D.size('cites')} THEN 1 ELSE 0 END) AS dumps, sum(CASE WHEN
        {D.rx('body', POLITE)} THEN 1 ELSE 0 END) AS polite, sum(CASE WHEN {D.rx('body', PLAIN)} AND NOT {D.rx('body', POLITE)} THEN 1 ELSE
        0 END) AS plain FROM s GROUP BY report_id)
        SELECT g.report_id, sentences, coalesce(cv.covered, 0) AS covered, round(cv.covered * 1e0 / n.n, 4) AS coverage, round(sentences *
        1e0 / cv.covered, 4) AS per_covered, round(chars, 2) AS chars_per_cite, round(span, 3) AS span_mean, round(mono, 4) AS monotonic,
        dumps, polite, plain, round(en.share, 4) AS top_ending, round(he.share, 4) AS top_head FROM g LEFT JOIN cv ON cv.report_id =
        g.report_id LEFT JOIN n ON n.video_id = g.video_id LEFT JOIN mo ON mo.report_id = g.report_id LEFT JOIN en ON en.report_id =
        g.report_id LEFT JOIN he ON he.report_id = g.report_id"""


def clock(D: Dialect, t: str) -> str:
    t = f"CAST(floor({t}) AS BIGINT)"
    return f"""lpad(CAST({D.idiv(t, '60')} AS STRING), CAST(greatest(2, length(CAST({D.idiv(t, '60')} AS STRING))) AS INT), '0'), ':',
        lpad(CAST({t} % 60 AS STRING), 2, '0')"""


def hashes(D: Dialect, row: str, name: str) -> str:
    return (f"WITH {seg(D)}, r AS (SELECT video_id, idx, {D.idiv('idx', '512')} AS block, {D.sha(row)} AS h FROM seg), "
            f"b AS (SELECT video_id, block, {D.sha(D.join('h', '', 'idx'))} AS h FROM r GROUP BY video_id, block) "
            f"SELECT video_id, {D.sha(D.join('h', '', 'block'))} AS {name} FROM b GROUP BY video_id")


def chrf(D: Dialect) -> str:
    """Character n-grams of 1 to 6 as multisets, mean precision and recall over the lengths both have, F2; against the caption before."""
    side = lambda c: D.each("q", D.cat(*[grams(D, c, n) for n in range(1, 7)]), "g")
    return f"""WITH {seg(D)}, t AS (SELECT video_id, idx, {D.rep('cap', BLANK)} AS cap FROM seg), p AS (SELECT video_id, idx, cap, lag(cap)
        OVER (PARTITION BY video_id ORDER BY idx) AS ref FROM t),
        q AS (SELECT * FROM p WHERE cap <> '' AND ref <> ''),
        u AS (SELECT video_id, idx, g, 1 AS a, 0 AS b FROM {side('cap')} UNION ALL SELECT video_id, idx, g, 0, 1 FROM {side('ref')}),
        c AS (SELECT video_id, idx, g, sum(a) AS a, sum(b) AS b FROM u GROUP BY video_id, idx, g),
        m AS (SELECT video_id, idx, length(g) AS n, sum(least(a, b)) AS hit, sum(a) AS na, sum(b) AS nb FROM c GROUP BY video_id, idx,
        length(g)),
        f AS (SELECT video_id, idx, avg(hit * 1e0 / na) AS pr, avg(hit * 1e0 / nb) AS rc FROM m WHERE na > 0 AND nb > 0 GROUP BY video_id,
        idx)
        SELECT video_id, idx, round(CASE WHEN pr + rc = 0 THEN 0e0 ELSE 5e0 * pr * rc / (4e0 * pr + rc) END, 6) AS f2 FROM f"""


B = {
    "x1_strip_residual_cjk": lambda D: f"WITH {caps(D)} SELECT video_id, idx, trim({D.rep(D.rep('cap', f'[{CJK}]+'), '[ ][ ]+', ' ')}) AS clean FROM cap",
    "x4_parse_citations": lambda D: f"WITH {cites(D)} SELECT report_id, sent_id, c FROM ct",
    "x10_edit_distance": lambda D: f"""WITH {seg(D)}, p AS (SELECT video_id, idx, cap, lag(cap) OVER (PARTITION BY video_id ORDER BY idx) AS
        prev FROM seg) SELECT video_id, idx, levenshtein(cap, prev) AS d FROM p WHERE cap IS NOT NULL AND prev IS NOT NULL""",
    "x12_norm_basic": lambda D: f"WITH {seg(D)} SELECT video_id, idx, lower({D.rep('sub', '[^0-9A-Za-z가-힣]')}) AS norm FROM seg WHERE sub IS NOT NULL",
    "x15_longest_cjk_run": lambda D: f"""WITH {caps(D)} SELECT video_id, idx, coalesce({D.high(D.map_(D.find('cap', f'[{CJK}]+'), 'r -> length(r)'))},
        0) AS run FROM cap""",
    "x24_json_scalar": lambda D: f"""SELECT event_id, CAST({'get_json_object(props, ' + chr(39) + '$.k' + chr(39) + ')' if D.spark else 'json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ')'}
        AS BIGINT) AS k FROM {D.t('events')}""",
    "f4_static": lambda D: f"WITH {seg(D)} SELECT video_id, idx, motion < 0.06e0 AS still_now, still FROM seg",
    "f9_degenerate_sentences": lambda D: f"""WITH {rep(D)}, s AS (SELECT video_id, max(idx) + 1 AS n FROM {D.t('segments')} GROUP BY video_id)
        SELECT r.report_id, r.sent_id, {D.size('r.cites')} > 0.5e0 * s.n AS degenerate FROM rep r JOIN s ON r.video_id = s.video_id WHERE
        r.cites IS NOT NULL""",
    "f10_cite_subset": lambda D: f"""WITH {cites(D)} SELECT report_id, sent_id, {D.size(D.meet('c', 'cites'))} AS kept, {D.size('c')} AS
        parsed FROM ct WHERE cites IS NOT NULL""",
    "f26_between_markers": lambda D: f"""WITH {rep(D)}, m AS (SELECT report_id, sent_id, text, max(CASE WHEN {D.rx('text', '\"')} THEN 1 ELSE
        0 END) OVER (PARTITION BY report_id ORDER BY sent_id ROWS UNBOUNDED PRECEDING) AS inside FROM rep WHERE text IS NOT NULL) SELECT
        report_id, sent_id FROM m WHERE inside = 1 AND length(text) >= 8 AND {D.rx('text', '다[.]?$')}""",
    "proj_p6_brief": lambda D: f"WITH {seg(D)} SELECT video_id, idx, substring(sub, 1, 60) AS sub, substring(cap, 1, 70) AS cap FROM seg",
    "proj_p12_half_of": lambda D: f"""SELECT video_id, CASE WHEN (position(substring({D.sha('video_id')}, 2, 1) IN '0123456789abcdef') - 1) %
        2 = 0 THEN 'A' ELSE 'B' END AS half FROM (SELECT DISTINCT video_id FROM {D.t('videos')}) v""",
    "proj_p13_sanitize_id": lambda D: f"SELECT DISTINCT title, {D.rep('title', '[^a-zA-Z0-9_-]', '_')} AS safe FROM {D.t('videos')}",
    "proj_p16_global_ids": lambda D: f"WITH {seg(D)} SELECT concat(video_id, '#', CAST(idx AS STRING)) AS gid FROM seg",
    "proj_p17_publisher": lambda D: f"""SELECT {'substring_index(video_id, ' + chr(39) + '_' + chr(39) + ', 1)' if D.spark else 'split_part(video_id, ' + chr(39) + '_' + chr(39) + ', 1)'}
        AS family, count(DISTINCT video_id) AS videos FROM {D.t('videos')} GROUP BY 1""",
    "proj_p18_expected_segments": lambda D: f"SELECT DISTINCT video_id, CAST(ceil(duration_sec / 5e0) AS BIGINT) AS expected, n_segments FROM {D.t('videos')}",
    "a16_groundedness": lambda D: f"""WITH {cites(D)} SELECT model, count(*) AS n, round(sum(CASE WHEN {D.size('c')} > 0 THEN 1e0 ELSE 0e0
        END) / nullif(count(*), 0), 6) AS grounded FROM ct GROUP BY model""",
    "a22_char_error_rate": lambda D: f"""WITH {seg(D)}, p AS (SELECT arm, cap, lag(cap) OVER (PARTITION BY video_id ORDER BY idx) AS ref FROM
        seg) SELECT arm, round(sum(levenshtein(cap, ref)) * 1e0 / nullif(sum(length(ref)), 0), 6) AS cer FROM p WHERE cap IS NOT NULL AND
        ref IS NOT NULL GROUP BY arm""",
    "a36_caption_census": lambda D: f"""WITH {caps(D)} SELECT arm, count(*) AS n, sum(CASE WHEN trim(cap) = '' THEN 1 ELSE 0 END) AS blank,
        sum(CASE WHEN length(cjk) > 0 THEN 1 ELSE 0 END) AS cjk, round(avg(length(cap)), 6) AS mean_len FROM cap GROUP BY arm""",
    "v21_bm25": bm25,
    "s10_allow_list": lambda D: f"SELECT DISTINCT video_id, idx, start_sec, end_sec, rep_frame FROM {D.t('segments')}",
    "k11_mirror": lambda D: f"SELECT DISTINCT video_id, idx, start_sec, end_sec, subtitle FROM {D.t('segments')}",
    "n6_strata_of_text": lambda D: f"""WITH {caps(D)} SELECT CASE WHEN length(cjk) = 0 THEN '0' WHEN length(cjk) < 3 THEN '1-2' WHEN
        length(cjk) < 10 THEN '3-9' ELSE '10+' END AS cell, arm, count(*) AS n FROM cap GROUP BY 1, 2""",
    "n15_corrupt_texts": lambda D: f"""WITH {seg(D)}, k AS (SELECT video_id, idx, cap, {D.draw('100', 'video_id', 'idx', '7')} AS h, lead(cap)
        OVER (PARTITION BY video_id ORDER BY {D.draw('1000003', 'video_id', 'idx', '8')}, idx) AS other FROM seg) SELECT video_id, idx, CASE
        WHEN h < 20 THEN coalesce(other, cap) ELSE cap END AS cap FROM k""",
    "x2_truncate_to_sentence": lambda D: f"WITH {caps(D)} SELECT video_id, idx, {T.to_sentence(D, 'cap')} AS cut FROM cap",
    "x3_narration": lambda D: f"WITH {rep(D)} SELECT report_id, sent_id, {T.narration(D, 'text')} AS narration FROM rep WHERE text IS NOT NULL",
    "x7_placeholders": lambda D: f"""WITH {seg(D)} SELECT video_id, idx, {T.clean_for_report(D, 'cap')} AS caption,
        CASE WHEN {T.suspicious(D, 'sub')} THEN '{T.INSTRUCTION_NOTE}' ELSE coalesce(sub, '') END AS subtitle FROM seg""",
    "x8_char_ngrams": lambda D: f"""WITH {seg(D)}, t AS (SELECT {D.rep('sub', BLANK)} AS body FROM seg WHERE sub IS NOT NULL)
        SELECT gram, count(*) AS n FROM (""" + " UNION ALL ".join(f"SELECT gram FROM {D.each('t', grams(D, 'body', n), 'gram')}" for n in (2, 3)) + ") g GROUP BY gram",
    "f1_corrupted_caption": lambda D: f"WITH {seg(D)} SELECT video_id, idx, {T.corrupted(D, 'cap')} AS corrupted FROM seg",
    "f2_subtitle_credit": lambda D: f"WITH {seg(D)} SELECT video_id, idx, {T.credit(D, 'sub')} AS credit FROM seg",
    "f3_suspicious_instruction": lambda D: f"WITH {docs(D)} SELECT doc_id, {T.suspicious(D, 'text')} AS suspicious FROM doc",
    "f8_drop_truncated_tail": lambda D: f"""WITH {rep(D)}, r AS (SELECT report_id, text, coalesce({D.size('cites')}, 0) AS n, row_number()
        OVER (PARTITION BY report_id ORDER BY sent_id DESC) AS back FROM rep)
        SELECT report_id, count(*) - sum(CASE WHEN back = 1 AND n <= 0 THEN 1 ELSE 0 END) AS kept, max(CASE WHEN back = 1 AND n <= 0 THEN
        text END) AS tail FROM r GROUP BY report_id""",
    "proj_p3_postprocess_caption": lambda D: f"""WITH {caps(D)}, s AS (SELECT video_id, idx, cap, {T.strip_foreign(D, 'cap')} AS bare FROM
        cap), c AS (SELECT video_id, idx, cap, {T.to_sentence(D, 'bare')} AS clean FROM s)
        SELECT video_id, idx, clean AS caption, CASE WHEN clean <> cap THEN cap END AS raw FROM c""",
    "proj_p4_format_segment": lambda D: f"""WITH {seg(D)}, c AS (SELECT video_id, idx, s, e, {T.clean_for_report(D, 'cap')} AS cap, CASE
        WHEN {T.suspicious(D, 'sub')} THEN '{T.INSTRUCTION_NOTE}' ELSE coalesce(sub, '') END AS sub FROM seg)
        SELECT video_id, idx, concat('[seg#', CAST(idx AS STRING), '] ', {clock(D, 's')}, '-', {clock(D, 'e')}, ' subtitle: "', sub, '" caption: "',
        cap, '"') AS line FROM c""",
    "proj_p8_sentences_of_events": lambda D: f"""SELECT video_id, event_no, concat(event, ' [', {D.text(D.map_('seg_idx', "x -> concat('seg#', CAST(x AS STRING))"), ', ')},
        ']') AS text, seg_idx AS cites,
        row_number() OVER (PARTITION BY video_id ORDER BY event_no) - 1 AS sent_id FROM (SELECT DISTINCT video_id, event_no, event, seg_idx
        FROM {D.t('frozen_kheritage_grave_excavation')}) a WHERE event IS NOT NULL AND seg_idx IS NOT NULL""",
    "a14_chunk_coverage": lambda D: f"""WITH {rep(D)}, {seg(D)}, ch AS (SELECT video_id, idx, k FROM {D.each('seg', D.seq('greatest(0, ceil((idx - 59) / 55e0))', 'floor(idx / 55e0)'), 'k')}),
        rv AS (SELECT DISTINCT report_id, video_id FROM rep WHERE video_id IS NOT NULL), c AS (SELECT DISTINCT report_id, x FROM
        {D.each('rep', 'cites', 'x')}),
        j AS (SELECT rv.report_id, ch.k, ch.idx, c.x FROM rv JOIN ch ON ch.video_id = rv.video_id LEFT JOIN c ON c.report_id = rv.report_id
        AND c.x = ch.idx)
        SELECT report_id, k AS chunk, round(count(x) * 1e0 / count(*), 6) AS coverage, count(x) < 0.5e0 * count(*) AS retry FROM j GROUP BY
        report_id, k""",
    "a15_distinct_ratio": lambda D: f"""WITH {rep(D)} SELECT report_id, round(coalesce(count(DISTINCT {T.narration(D, 'text')}) * 1e0 /
        nullif(count(text), 0), 1e0), 6) AS ratio FROM rep GROUP BY report_id""",
    # Rows are hashed, then blocks of 512 rows, then a video's blocks: no text of a whole video is put together.
    "x21_index_text_hash": lambda D: hashes(D, "concat(coalesce(sub, ''), chr(31), coalesce(cap, ''), chr(30))", "text_hash"),
    "x22_field_hash": lambda D: hashes(D, "coalesce(cap, chr(0))", "cap_hash"),
    "x13_norm_numfree": lambda D: f"""WITH {seg(D)}, t AS (SELECT video_id, idx, {D.rep(D.rep('sub', '[^가-힣0-9a-zA-Z ]', ' '), '[0-9]+', ' ')}
        AS body FROM seg WHERE sub IS NOT NULL)
        SELECT video_id, idx, lower({D.text(D.keep(D.words('body'), 'w -> NOT ' + D.rx('w', f'^{NUMBER}$')), ' ')}) AS numfree FROM t""",
    "x16_first_clause": lambda D: f"""WITH {seg(D)}, c AS (SELECT video_id, idx, cap, sub, {D.at(D.keep(D.map_(D.split(D.rep('trim(cap)', '(습니다|이다)', ('$1' if D.spark else chr(92) + '1') + '¦'), '[.。¦]'), 'x -> trim(x)'), 'x -> length(x) >= 15'), 0)}
        AS clause FROM seg WHERE cap IS NOT NULL)
        SELECT video_id, idx, coalesce(clause, substring(cap, 1, 60)) AS clause, {D.size(D.meet(D.uniq(D.find('cap', '[가-힣]{3,}')), D.uniq(D.find("coalesce(sub, '')", '[가-힣]{3,}'))))}
        AS shared FROM c""",
    "x17_sentence_class": lambda D: f"""WITH {rep(D)}, b AS (SELECT {T.body(D, 'text')} AS body FROM rep WHERE text IS NOT NULL)
        SELECT CASE WHEN {D.rx('body', POLITE)} THEN 'polite' WHEN {D.rx('body', PLAIN)} THEN 'plain' ELSE 'other' END AS class, count(*) AS
        n FROM b GROUP BY 1""",
    "x18_merge_repeated_lines": lambda D: f"""WITH {rep(D)}, l AS (SELECT report_id, sent_id, cites, {T.narration(D, 'text')} AS narr FROM
        rep WHERE text IS NOT NULL), m AS (SELECT *, lag(narr) OVER (PARTITION BY report_id ORDER BY sent_id) AS before FROM l),
        i AS (SELECT *, sum(CASE WHEN narr = before THEN 0 ELSE 1 END) OVER (PARTITION BY report_id ORDER BY sent_id ROWS UNBOUNDED
        PRECEDING) AS island FROM m), c AS (SELECT report_id, island, {D.collect('x')} AS cites FROM (SELECT DISTINCT report_id, island, x
        FROM {D.each('i', 'cites', 'x')}) y GROUP BY report_id, island),
        h AS (SELECT report_id, island, min(sent_id) AS sent_id, max(narr) AS narr, count(*) AS lines FROM i GROUP BY report_id, island)
        SELECT h.report_id, h.sent_id, h.narr, h.lines, c.cites FROM h LEFT JOIN c ON c.report_id = h.report_id AND c.island = h.island""",
    # A line without a speaker's label belongs to the speaker before it in its document.
    "x20_forward_fill_speaker": lambda D: f"""WITH {docs(D)}, s AS (SELECT doc_id, {D.split('text', '[\\r\\n]+')} AS lines FROM doc WHERE
        text IS NOT NULL), l AS (SELECT doc_id, i, {D.at('lines', 'i')} AS line FROM {D.each('s', D.seq('0', D.size('lines') + ' - 1'), 'i')}),
        t AS (SELECT doc_id, i, CASE WHEN {D.rx('line', '^[A-Z]{2}: ')} THEN substring(line, 1, 2) END AS label FROM l) """
        + ("SELECT doc_id, i AS line_no, last_value(label, true) OVER w AS owner FROM t" if D.spark else "SELECT doc_id, i AS line_no, last_value(label IGNORE NULLS) OVER w AS owner FROM t")
        + " WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "f27_secret_scan": lambda D: "WITH " + docs(D) + ", h AS (SELECT doc_id, " + ", ".join(f"{D.rx('text', p)} AS {n}" for n, p in SECRETS.items()) + " FROM doc WHERE text IS NOT NULL) SELECT doc_id, "
                                 + D.keep(D.arr(*[f"CASE WHEN {n} THEN '{n}' END" for n in SECRETS]), "x -> x IS NOT NULL") + " AS hits FROM h WHERE " + " OR ".join(SECRETS),
    "v26_rule_router": lambda D: f"""WITH q AS (SELECT DISTINCT query_id, query_type, text FROM {D.t('queries_dev_only')} WHERE text IS NOT
        NULL) SELECT query_type, {T.kind_of(D, 'text')} AS route, count(*) AS n FROM q GROUP BY 1, 2""",
    "n17_query_variants": lambda D: f"""WITH q AS (SELECT DISTINCT query_id, text, {D.rx('text', '장면$')} AS fits FROM
        {D.t('queries_dev_only')} WHERE text IS NOT NULL)
        SELECT query_id, CASE WHEN fits THEN trim({D.rep('text', '장면$')}) ELSE text END AS t1, {D.rep('text', '장면$', '부분')} AS t2,
        {D.rep('text', '장면$', '순간')} AS t3, CASE WHEN fits THEN concat(text, ' 찾아줘') ELSE text END AS t4 FROM q""",
    "n18_cuts": lambda D: f"""WITH {seg(D)}, c AS (SELECT n, substring(cap, 1, n) AS cut FROM {D.each('seg', D.map_(D.seq('1', '4'), 'x -> x * 20'), 'n')}
        WHERE cap IS NOT NULL)
        SELECT n, round(avg(length(cut)), 6) AS prefix_len, round(avg(length({T.to_sentence(D, 'cut')})), 6) AS sentence_len, count(DISTINCT
        cut) AS distinct_cuts FROM c GROUP BY n""",
    "a45_summariness": summariness,
    "a46_truncation": lambda D: f"""WITH {cites(D)}, m AS (SELECT report_id, max({D.high('cites')}) AS map_max, max({D.high('c')}) AS
        reduce_max, min({D.low('c')}) AS reduce_min FROM ct GROUP BY report_id)
        SELECT report_id, map_max, reduce_min, reduce_max, round(1 - (reduce_max + 1e0) / (map_max + 1e0), 4) AS lost, coalesce(1 -
        (reduce_max + 1e0) / (map_max + 1e0) > 0.1e0, false) AS in_reduce FROM m""",
    "a47_cjk_exposure": lambda D: f"""WITH {seg(D)} SELECT video_id, count(*) AS n, sum(CASE WHEN {D.rx("coalesce(cap, '')", f'[{T.FOREIGN}]')}
        AND NOT {T.corrupted(D, 'cap')} THEN 1 ELSE 0 END) AS passing FROM seg GROUP BY video_id""",
}
QUERIES, SQL = register(B)
QUERIES["v21_bm25"] = v21_bm25
# The check engine's edit distance counts bytes, not characters; these are tested on fixtures instead.
for _name in ("x10_edit_distance", "a22_char_error_rate"):
    del SQL[_name]
