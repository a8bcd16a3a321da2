"""Report flow, prompts, audits, intake checks and provenance over the project's tables."""

from __future__ import annotations

from tidemark.plans import dialect as T
from tidemark.plans.dialect import KINDS, Dialect, inv, present, qry, register, rep, seg
from tidemark.plans.texts import clock
from tidemark.plans.timeline import overlaps, vids

# Range of eligible lengths in seconds for the audit, share of a second group, target size.
LENGTHS, SECOND_SHARE, TARGET = (60, 200), 0.3, 40


def family(D: Dialect, c: str = "video_id") -> str:
    return f"substring_index({c}, '_', 1)" if D.spark else f"split_part({c}, '_', 1)"


def chunks(D: Dialect) -> str:
    """ch: segments in overlapped chunks of 60 that start every 55; the last chunk ends with the video."""
    return f"""{seg(D)}, ce AS (SELECT video_id, max(idx) AS top FROM seg GROUP BY video_id),
        ch AS (SELECT s.video_id, s.idx, s.s, s.e, s.sub, s.cap, k FROM {D.each('(SELECT seg.*, ce.top FROM seg JOIN ce ON ce.video_id = seg.video_id) s', D.seq('greatest(0, ceil((s.idx - 59) / 55e0))', 'least(floor(s.idx / 55e0), greatest(0, ceil((s.top - 59) / 55e0)))'), 'k')})"""


def valid_events(D: Dialect) -> str:
    """ok: events that pass validation up to their text's length."""
    return f"""{inv(D)}, {vids(D)}, ok AS (SELECT i.video_id, i.event_no, i.event, {D.at('i.span', 0)} AS a, {D.at('i.span', 1)} AS b,
        {D.uniq('i.seg_idx')} AS seg_idx FROM inv i LEFT JOIN vid v ON v.video_id = i.video_id
        WHERE trim(i.event) <> '' AND {D.size('i.seg_idx')} BETWEEN 1 AND 4 AND {D.size('i.span')} = 2 AND {D.at('i.span', 0)} BETWEEN 0 AND
        {D.at('i.span', 1)} AND coalesce({D.at('i.span', 1)} < v.n_seg, true)
        AND {D.size(D.uniq('i.seg_idx'))} = {D.size('i.seg_idx')} AND {D.low('i.seg_idx')} >= {D.at('i.span', 0)} AND {D.high('i.seg_idx')}
        <= {D.at('i.span', 1)} AND NOT {T.corrupted(D, 'i.event')})"""


def e3(D: Dialect) -> str:
    """Validated events, merged where equal names touch, as sentences that cite their evidence."""
    return f"""WITH {valid_events(D)}, m AS (SELECT *, max(b) OVER (PARTITION BY video_id, event ORDER BY a, b, event_no ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
        p AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, event ORDER BY a, b,
        event_no ROWS UNBOUNDED PRECEDING) AS part FROM m),
        h AS (SELECT video_id, event, part, min(a) AS a, max(b) AS b FROM p GROUP BY video_id, event, part),
        x AS (SELECT video_id, event, part, {D.first(D.collect('i'), 4)} AS cites FROM (SELECT DISTINCT video_id, event, part, i FROM
        {D.each('p', 'seg_idx', 'i')}) y GROUP BY video_id, event, part)
        SELECT h.video_id, row_number() OVER (PARTITION BY h.video_id ORDER BY h.a, h.event, h.b) - 1 AS sent_id,
        concat(h.event, ' [', {D.text(D.map_('x.cites', "c -> concat('seg#', CAST(c AS STRING))"), ', ')}, ']') AS text, x.cites FROM h JOIN
        x ON x.video_id = h.video_id AND x.event = h.event AND x.part = h.part"""


def e2(D: Dialect) -> str:
    """Per report: one call or chunks, and what the clean-up takes away: citations outside the map, dumps, a lost tail, a loop."""
    return f"""WITH {rep(D)}, {seg(D)}, n AS (SELECT video_id, count(*) AS n FROM seg GROUP BY video_id),
        r AS (SELECT rep.*, n.n, row_number() OVER (PARTITION BY report_id ORDER BY sent_id DESC) AS back FROM rep JOIN n ON n.video_id =
        rep.video_id),
        c AS (SELECT report_id, sum(CASE WHEN s.idx IS NULL THEN 1 ELSE 0 END) AS strange FROM (SELECT DISTINCT report_id, video_id, x FROM
        {D.each('rep', 'cites', 'x')}) y LEFT JOIN seg s ON s.video_id = y.video_id AND s.idx = y.x GROUP BY report_id)
        SELECT r.report_id, CASE WHEN max(n) <= 60 THEN 'single' ELSE 'chunks' END AS path, max(coalesce(c.strange, 0)) AS outside, sum(CASE
        WHEN {D.size('cites')} > 0.5e0 * n THEN 1 ELSE 0 END) AS dumps,
        max(CASE WHEN back = 1 AND coalesce({D.size('cites')}, 0) <= 0 THEN 1 ELSE 0 END) AS tail, coalesce(count(DISTINCT {T.narration(D, 'text')})
        * 1e0 / nullif(count(text), 0), 1e0) < 0.3e0 AS loop
        FROM r LEFT JOIN c ON c.report_id = r.report_id GROUP BY r.report_id"""


def p15(D: Dialect) -> str:
    """One prompt for each chunk: the budget line, then at most 60 lines of segments."""
    line = f"concat('[seg#', CAST(idx AS STRING), '] ', {clock(D, 's')}, '-', {clock(D, 'e')}, ' ', coalesce(sub, ''), ' | ', {T.clean_for_report(D, 'cap')})"
    return f"""WITH {chunks(D)}, l AS (SELECT video_id, k, idx, {line} AS line FROM ch)
        SELECT video_id, k AS chunk, concat('at most ', CAST(greatest(1, {D.idiv('count(*)', '5')}) AS STRING), ' sentences', chr(10),
        {D.join('line', '|', 'idx')}) AS prompt FROM l GROUP BY video_id, k"""


def f20(D: Dialect) -> str:
    rules = {"duplicate": "copies > 1", "unknown_video": "v.video_id IS NULL", "bad_type": f"query_type IS NULL OR query_type NOT IN ({', '.join(repr(k) for k in KINDS)})", "not_numeric": "gt_start IS NULL OR gt_end IS NULL",
             "order": "gt_end <= gt_start", "beyond": "gt_end > v.dur", "no_segments": f"gt IS NULL OR {D.size('gt')} = 0"}
    return f"""WITH {qry(D)}, {vids(D)}, c AS (SELECT qry.*, count(*) OVER (PARTITION BY query_id) AS copies FROM qry), e AS (SELECT
        query_id, {D.arr(*[f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, c in rules.items()])} AS errors
        FROM c LEFT JOIN vid v ON v.video_id = c.video_id) SELECT error, count(*) AS n FROM {D.each('e', 'errors', 'error')} WHERE error IS
        NOT NULL GROUP BY error"""


B = {
    "proj_p10_reference_events": lambda D: f"""WITH {overlaps(D)}, o AS (SELECT video_id, event_no, min(w) AS a, max(w) AS b FROM ov WHERE
        trim(event) <> '' GROUP BY video_id, event_no)
        SELECT o.video_id, o.event_no, o.a, o.b, coalesce({D.at('i.span', 0)} = o.a AND {D.at('i.span', 1)} = o.b, false) AS as_frozen FROM
        o JOIN inv i ON i.video_id = o.video_id AND i.event_no = o.event_no""",
    "proj_p11_arm_key": lambda D: f"""WITH {seg(D)}, a AS (SELECT arm, max(length(cap)) AS longest FROM seg WHERE arm IS NOT NULL GROUP BY arm)
        SELECT arm, CASE WHEN longest <> 64 THEN concat(arm, '@', CAST(longest AS STRING)) ELSE arm END AS arm_key FROM a""",
    "proj_p15_prompts": p15,
    "proj_p22_sheet_rows": lambda D: f"""WITH {seg(D)} SELECT {D.sha('concat(video_id, chr(35), CAST(idx AS STRING))')} AS sample_id, s AS
        start, e AS stop FROM seg""",
    "f12_frames_exist": lambda D: f"""WITH s AS (SELECT DISTINCT video_id, idx, caption, rep_frame FROM {D.t('segments')}) SELECT video_id,
        count(*) AS uncaptioned, sum(CASE WHEN rep_frame IS NULL THEN 1 ELSE 0 END) AS without_frame FROM s WHERE coalesce(caption, '') = ''
        GROUP BY video_id""",
    "f14_resume_targets": lambda D: f"WITH {seg(D)} SELECT video_id, idx FROM seg WHERE coalesce(cap, '') = ''",
    "f15_all_failed": lambda D: f"""WITH {seg(D)} SELECT video_id, bool_and(cap IS NULL) AS all_failed, bool_and(coalesce(trim(cap), '') = '')
        AS all_blank FROM seg GROUP BY video_id""",
    "f17_speech_status": lambda D: f"""WITH s AS (SELECT video_id, max(CASE WHEN {D.rx('subtitle', '[가-힣]')} THEN 1 ELSE 0 END) AS track,
        max(CASE WHEN lower(caption_lang) LIKE 'ko%' THEN 1 ELSE 0 END) AS ko,
        max(CASE WHEN lower(caption_lang) NOT LIKE 'ko%' AND lower(caption_lang) NOT IN ('', 'und', 'unknown') THEN 1 ELSE 0 END) AS other,
        max(CASE WHEN subtitle <> '' THEN 1 ELSE 0 END) AS spoken FROM {D.t('segments')} GROUP BY video_id)
        SELECT video_id, CASE WHEN track = 1 THEN 'track' WHEN ko = 1 THEN 'platform' WHEN other = 1 AND spoken = 1 THEN 'refuted' ELSE
        'unresolved' END AS status, NOT (track = 0 AND ko = 0 AND other = 1 AND spoken = 1) AS kept FROM s""",
    "f18_in_scope": lambda D: f"""WITH {vids(D)} SELECT video_id FROM vid WHERE dur BETWEEN {LENGTHS[0]} AND {LENGTHS[1]} AND {family(D)} NOT
        IN ('news', 'match')""",
    "f20_intake_errors": f20,
    "f25_reference_status": lambda D: f"""WITH v AS (SELECT DISTINCT video_id FROM {D.t('videos')}), f AS (SELECT video_id,
        count(csv_sha256) AS hashed, count(DISTINCT csv_sha256) AS versions FROM {D.t('frozen_kheritage_grave_excavation')} GROUP BY
        video_id)
        SELECT coalesce(v.video_id, f.video_id) AS video_id, CASE WHEN v.video_id IS NULL THEN 'unregistered' WHEN f.video_id IS NULL THEN
        'not_frozen' WHEN hashed = 0 THEN 'no_hash' WHEN versions > 1 THEN 'drifted' ELSE 'eligible' END AS status
        FROM v FULL OUTER JOIN f ON f.video_id = v.video_id""",
    "f28_catastrophic": lambda D: f"""WITH {rep(D)} SELECT report_id, bool_or({T.corrupted(D, 'text')}) AS foreign_language,
        bool_and(coalesce({D.size('cites')}, 0) <= 0) AS no_events,
        coalesce(count(DISTINCT {T.narration(D, 'text')}) * 1e0 / nullif(count(text), 0), 1e0) < 0.3e0 AS repeat_loop FROM rep GROUP BY
        report_id""",
    "f30_report_gates": lambda D: f"""WITH {rep(D)}, n AS (SELECT video_id, count(DISTINCT idx) AS n FROM {D.t('segments')} GROUP BY
        video_id), c AS (SELECT report_id, count(DISTINCT x) AS cited FROM {D.each('rep', 'cites', 'x')} GROUP BY report_id)
        SELECT r.report_id, max(coalesce(c.cited, 0)) >= 0.5e0 * max(n.n) AS covered, max({D.size('r.cites')}) <= 0.5e0 * max(n.n) AS
        no_dump, coalesce(max_by(coalesce({D.size('r.cites')}, 0), r.sent_id) > 0, false) AS whole
        FROM rep r JOIN n ON n.video_id = r.video_id LEFT JOIN c ON c.report_id = r.report_id GROUP BY r.report_id""",
    "f32_pull_contract": lambda D: f"""WITH v AS (SELECT DISTINCT vec_id, video_id, embed_model, {D.size('emb_sub')} AS ds,
        {D.size('emb_cap')} AS dc FROM {D.t('videoindex')})
        SELECT video_id, count(*) = count(DISTINCT vec_id) AS unique_ids, count(DISTINCT embed_model) = 1 AS one_model, bool_and(coalesce(ds
        = 64, true) AND coalesce(dc = 64, false)) AS even_lengths FROM v GROUP BY video_id""",
    "j10_true_label": lambda D: f"""WITH s AS (SELECT DISTINCT video_id, idx, caption, lower(trim(caption_lang)) AS l FROM
        {D.t('segments')}), c AS (SELECT video_id, idx, l, length({D.rep('caption', f'[^{T.FOREIGN}]')}) AS foreign_n,
        length({D.rep('caption', '[^가-힣]')}) AS ko_n FROM s WHERE caption IS NOT NULL)
        SELECT CASE WHEN foreign_n = 0 THEN 'none' WHEN ko_n = 0 AND foreign_n < 3 THEN 'unclear' WHEN l LIKE 'ko%' THEN 'drift' WHEN l IS
        NULL OR l IN ('', 'und', 'unknown') THEN 'unlabelled' ELSE 'declared' END AS label, count(*) AS n FROM c GROUP BY 1""",
    "j13_pick_top": lambda D: f"""WITH {seg(D)}, a AS (SELECT arm, {family(D, 'arm')} AS model, round(avg(CASE WHEN {T.corrupted(D, 'cap')}
        OR coalesce(trim(cap), '') = '' THEN 0e0 ELSE 1e0 END), 9) AS good FROM seg WHERE arm IS NOT NULL GROUP BY arm),
        b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY good DESC, arm) AS r FROM a), c AS (SELECT *, row_number() OVER
        (ORDER BY good DESC, model) AS place FROM b WHERE r = 1) SELECT place, model, arm, round(good, 6) AS good FROM c WHERE place <=
        3""",
    "j15_hash_status": lambda D: f"""WITH v AS (SELECT DISTINCT video_id, CASE WHEN {present(D, 'file_sha256')} THEN
        lower(trim(file_sha256)) END AS sha FROM {D.t('videos')}), k AS (SELECT video_id, min(sha) AS sha, count(DISTINCT sha) AS shas FROM
        v GROUP BY video_id),
        o AS (SELECT sha, count(*) AS holders FROM k WHERE sha IS NOT NULL GROUP BY sha) SELECT k.video_id, CASE WHEN k.shas = 0 THEN
        'missing_hash' WHEN k.shas > 1 THEN 'conflict' WHEN o.holders > 1 THEN 'same_file_elsewhere' ELSE 'unique' END AS status FROM k LEFT
        JOIN o ON o.sha = k.sha""",
    "j16_key_compare": lambda D: f"""WITH a AS (SELECT DISTINCT video_id, idx FROM {D.t('segments')}), b AS (SELECT DISTINCT video_id, idx
        FROM {D.t('videoindex')}), j AS (SELECT coalesce(a.video_id, b.video_id) AS video_id, a.idx AS ia, b.idx AS ib FROM a FULL OUTER
        JOIN b ON a.video_id = b.video_id AND a.idx = b.idx)
        SELECT video_id, sum(CASE WHEN ia = ib THEN 1 ELSE 0 END) AS both_sides, sum(CASE WHEN ib IS NULL THEN 1 ELSE 0 END) AS
        only_segments, sum(CASE WHEN ia IS NULL THEN 1 ELSE 0 END) AS only_index FROM j GROUP BY video_id""",
    "a17_coverage_by_type": lambda D: f"""WITH {qry(D)}, {rep(D)}, c AS (SELECT DISTINCT video_id, x FROM {D.each('rep', 'cites', 'x')}), t
        AS (SELECT query_type, video_id, i FROM {D.each('qry', 'gt', 'i')}), r AS (SELECT DISTINCT video_id FROM rep)
        SELECT t.query_type, count(*) AS n, round(avg(CASE WHEN c.x IS NULL THEN 0e0 ELSE 1e0 END), 6) AS covered FROM t JOIN r ON
        r.video_id = t.video_id LEFT JOIN c ON c.video_id = t.video_id AND c.x = t.i GROUP BY t.query_type""",
    "a18_judge_coverage": lambda D: f"""WITH {rep(D)}, s AS (SELECT *, {D.idiv('(row_number() OVER (PARTITION BY report_id ORDER BY sent_id) - 1)', '8')}
        AS chunk FROM rep),
        c AS (SELECT report_id, chunk, bool_or({D.size('cites')} > 0) AS covered, bool_and(text IS NOT NULL) AS parsed FROM s GROUP BY
        report_id, chunk), f AS (SELECT report_id, min(CASE WHEN coalesce(covered, false) THEN chunk END) AS stop FROM c GROUP BY report_id)
        SELECT c.report_id, max(f.stop) IS NOT NULL AS covered, bool_and(parsed) AS parse_ok, count(*) AS calls FROM c JOIN f ON f.report_id
        = c.report_id WHERE f.stop IS NULL OR c.chunk <= f.stop GROUP BY c.report_id""",
    "a44_run_stats": lambda D: f"""WITH {rep(D)}, p AS (SELECT model, report_id, text IS NULL OR NOT {D.rx('text', '(?i)seg ?# ?[0-9]')} AS
        failed, sent_id FROM rep), q AS (SELECT *, lead(failed) OVER (PARTITION BY report_id ORDER BY sent_id) AS again FROM p)
        SELECT model, round(avg(CASE WHEN failed THEN 1e0 ELSE 0e0 END), 6) AS failure_rate, round(avg(CASE WHEN failed AND again IS NOT
        NULL THEN CASE WHEN again THEN 0e0 ELSE 1e0 END END), 6) AS recovered FROM q GROUP BY model""",
    "a49_achieved_size": lambda D: f"""WITH {vids(D)}, f AS (SELECT {family(D)} AS family, sum(CASE WHEN dur BETWEEN {LENGTHS[0]} AND
        {LENGTHS[1]} THEN 1 ELSE 0 END) AS main, sum(CASE WHEN dur > {LENGTHS[1]} THEN 1 ELSE 0 END) AS spare FROM vid GROUP BY 1)
        SELECT family, main, spare, CAST(least({TARGET}, main + least(floor({SECOND_SHARE}e0 / {1 - SECOND_SHARE}e0 * main + 1e-9), spare))
        AS BIGINT) AS achieved FROM f""",
    "a71_environment_match": lambda D: f"""WITH s AS (SELECT DISTINCT video_id, idx, caption, caption_raw FROM {D.t('segments')}) SELECT
        video_id, count(*) AS n, round(avg(CASE WHEN coalesce(caption, '') = coalesce(caption_raw, '') THEN 1e0 ELSE 0e0 END), 6) AS same,
        sum(CASE WHEN (caption IS NULL) <> (caption_raw IS NULL) THEN 1 ELSE 0 END) AS one_sided FROM s GROUP BY video_id""",
    "a73_reindex_audit": lambda D: f"""WITH s AS (SELECT video_id, idx, max(subtitle) AS sub, max(caption) AS cap FROM {D.t('segments')}
        GROUP BY video_id, idx), v AS (SELECT video_id, idx, max({D.size('emb_sub')}) AS ds, max({D.size('emb_cap')}) AS dc FROM
        {D.t('videoindex')} GROUP BY video_id, idx)
        SELECT s.video_id, count(v.idx) AS indexed, sum(CASE WHEN v.idx IS NOT NULL AND coalesce(trim(sub), '') = '' AND ds IS NOT NULL THEN
        1 ELSE 0 END) AS vector_without_text, sum(CASE WHEN v.idx IS NOT NULL AND trim(sub) <> '' AND ds IS NULL THEN 1 ELSE 0 END) AS
        text_without_vector,
        sum(CASE WHEN dc <> 64 OR ds <> 64 THEN 1 ELSE 0 END) AS bad_length, sum(CASE WHEN {T.corrupted(D, 'cap')} THEN 1 ELSE 0 END) AS
        corrupted FROM s LEFT JOIN v ON v.video_id = s.video_id AND v.idx = s.idx GROUP BY s.video_id""",
    "e2_report_flow": e2,
    "e3_structured_report": e3,
    "g2_requested_frames": lambda D: f"""WITH {vids(D)}, {seg(D)}, rq AS (SELECT video_id, idx, t FROM {D.each('seg', D.seq('idx * 5', 'idx * 5 + 4'), 't')})
        SELECT rq.video_id, rq.idx, count(*) AS requested, sum(CASE WHEN floor(t * v.fps + 0.5e0) < floor(v.dur * v.fps) THEN 1 ELSE 0 END)
        AS met FROM rq JOIN vid v ON v.video_id = rq.video_id WHERE v.fps IS NOT NULL GROUP BY rq.video_id, rq.idx""",
    "s16_video_info": lambda D: f"""WITH {vids(D)} SELECT video_id, CAST(floor(dur * fps + 0.5e0) AS BIGINT) AS frames, round(floor(dur * fps
        + 0.5e0) / fps, 4) AS duration, CAST(ceil(dur / 5e0) AS BIGINT) AS segments FROM vid WHERE fps > 0""",
    "s17_probe_rows": lambda D: f"""SELECT DISTINCT video_id, duration_sec, title, CASE WHEN duration_sec IS NULL THEN 'no duration' WHEN
        coalesce(trim(title), '') = '' THEN 'no title' END AS error FROM {D.t('videos')}""",
    "n22_frozen_targets": lambda D: f"""WITH {inv(D)}, {seg(D)}, t AS (SELECT DISTINCT i.video_id, i.event_no, {D.at(D.words('i.event'), 0)}
        AS target, x FROM {D.each('inv i', 'i.seg_idx', 'x')} WHERE i.event IS NOT NULL)
        SELECT t.video_id, t.event_no, t.target, bool_or(coalesce(contains(s.sub, t.target), false)) AS spoken, {D.sha('t.target')} AS
        target_hash FROM t LEFT JOIN seg s ON s.video_id = t.video_id AND s.idx = t.x WHERE t.target IS NOT NULL GROUP BY t.video_id,
        t.event_no, t.target""",
    "u4_tightest_policy": lambda D: f"""WITH v AS (SELECT DISTINCT video_id, loaded_at, NOT {present(D, 'source_id')} AS a, NOT {present(D, 'file_sha256')}
        AS b, n_segments IS NULL AS c FROM {D.t('videos')}) SELECT video_id, bool_or(a) AS hold_source, bool_or(b) AS hold_file, bool_or(c)
        AS hold_count FROM v GROUP BY video_id""",
    "u7_union_of_rounds": lambda D: f"""WITH {qry(D)} SELECT video_id FROM qry WHERE split = 'dev' AND video_id IS NOT NULL UNION SELECT
        video_id FROM qry WHERE split = 'train' AND video_id IS NOT NULL""",
    "x14_transcript_sides": lambda D: f"""WITH {seg(D)} SELECT video_id, idx, trim({D.rep(D.rep(D.rep(D.rep('sub', r'[(]([^()]*)[)]/[(]([^()]*)[)]', '$1' if D.spark else chr(92) + '1'), '(^| )[a-z]/', ' '), '[*+/]+'), ' +', ' ')})
        AS plain FROM seg WHERE sub IS NOT NULL""",
    "x19_answer_prefix": lambda D: f"WITH {rep(D)} SELECT report_id, sent_id, coalesce({D.rx('lower(trim(text))', '^(yes|예|네|그렇)')}, false) AS yes FROM rep",
    "x23_model_class": lambda D: f"""SELECT arm, CASE WHEN arm LIKE 'qv%' THEN 'vision_language' WHEN arm LIKE 'mc%' OR arm LIKE 'iv%' THEN
        'chat' WHEN arm LIKE 'human%' THEN 'human' ELSE 'unknown' END AS class FROM (SELECT DISTINCT caption_arm AS arm FROM
        {D.t('segments')} WHERE caption_arm IS NOT NULL) a""",
    "c7_touches_protected": lambda D: f"""WITH {qry(D)} SELECT query_type, count(*) AS n, sum(CASE WHEN coalesce(split LIKE '%test%', false)
        THEN 1 ELSE 0 END) AS protected FROM qry GROUP BY query_type""",
    "c9_usability": lambda D: f"""WITH {vids(D)}, k AS (SELECT video_id, max(CASE WHEN {present(D, 'file_sha256')} THEN 1 ELSE 0 END) AS
        hashed FROM {D.t('videos')} GROUP BY video_id), s AS (SELECT video_id, count(DISTINCT idx) AS n FROM {D.t('segments')} GROUP BY
        video_id)
        SELECT vid.video_id, k.hashed = 1 AS acquired, coalesce(vid.n_seg = ceil(vid.dur / 5e0), false) AS consistent, coalesce(s.n =
        vid.n_seg, false) AS segmented, k.hashed = 1 AND coalesce(vid.n_seg = ceil(vid.dur / 5e0), false) AND coalesce(s.n = vid.n_seg,
        false) AS usable
        FROM vid JOIN k ON k.video_id = vid.video_id LEFT JOIN s ON s.video_id = vid.video_id""",
    "c10_allow_list": lambda D: f"""WITH d AS (SELECT DISTINCT doc_id, source, kind FROM {D.t('documents')} WHERE {D.rx('text', 'err_code=0x[0-9a-f]+')}
        OR {D.rx('text', '[A-Za-z0-9.]+@[A-Za-z0-9]+[.][a-z]+')}), a AS (SELECT DISTINCT source FROM {D.t('documents')} WHERE source LIKE
        '%review%')
        SELECT d.doc_id FROM d LEFT JOIN a ON a.source = d.source WHERE a.source IS NULL""",
    "c11_first_policy": lambda D: f"""WITH p AS (SELECT 1 AS priority, 'maru' AS prefix, 'stream' AS policy UNION ALL SELECT 2, 'cook',
        'craft' UNION ALL SELECT 3, 'repair', 'craft' UNION ALL SELECT 4, '', 'default'), v AS (SELECT DISTINCT video_id FROM
        {D.t('videos')} WHERE video_id IS NOT NULL)
        SELECT v.video_id, min_by(p.policy, p.priority) AS policy FROM v JOIN p ON p.prefix IN ({family(D, 'v.video_id')}, '') GROUP BY
        v.video_id""",
}
QUERIES, SQL = register(B)
