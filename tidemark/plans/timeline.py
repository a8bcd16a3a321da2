"""Grids, interval joins, event algebra, report chunks and metrics on spans."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect, corrupted, credit, inv, qry, register, rep, seg


def spans(D: Dialect) -> str:
    return f"{inv(D)}, sp AS (SELECT video_id, event_no, event, s, e, {D.at('span', 0)} AS a, {D.at('span', 1)} AS b, seg_idx FROM inv WHERE span IS NOT NULL)"


def vids(D: Dialect) -> str:
    return f"""vid AS (SELECT video_id, max(duration_sec) AS dur, max(fps) AS fps, max(n_segments) AS n_seg FROM {D.t('videos')} WHERE
        duration_sec IS NOT NULL GROUP BY video_id)"""


def grid(D: Dialect) -> str:
    return f"{vids(D)}, grd AS (SELECT video_id, i AS idx, i * 5e0 AS s, least(i * 5e0 + 5e0, dur) AS e FROM {D.each('vid', D.seq('0', 'ceil(dur / 5e0) - 1'), 'i')})"


#: Every event against the five-second windows it overlaps, by equality on the window number.
def overlaps(D: Dialect) -> str:
    return (f"""{inv(D)}, ev AS (SELECT *, CAST(floor(s / 5e0) AS INT) AS w0, CAST(floor(e / 5e0) AS INT) AS w1 FROM inv WHERE s IS NOT NULL
        AND e > s AND s >= 0), """
            f"ov0 AS (SELECT video_id, event_no, event, s, e, w FROM {D.each('ev', D.seq('w0', 'w1'), 'w')}), "
            "ov AS (SELECT *, least(e, w * 5e0 + 5e0) - greatest(s, w * 5e0) AS len FROM ov0 WHERE least(e, w * 5e0 + 5e0) > greatest(s, w * 5e0))")


#: islands: events of one name whose inclusive spans touch or overlap.
def islands(D: Dialect) -> str:
    return (f"""{spans(D)}, m AS (SELECT *, max(b) OVER (PARTITION BY video_id, event ORDER BY a, b, event_no ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING) AS before FROM sp WHERE event IS NOT NULL), """
            "isl AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, event ORDER BY a, b, event_no ROWS UNBOUNDED PRECEDING) AS part FROM m)")


def motion_peak(D: Dialect) -> str:
    """Per video the place behind the largest smoothed change of motion, and the mean change; 0 and 0 for fewer than two rows.

    A Gaussian of sigma 1 over four places on each side; beyond the ends the series is mirrored.
    """
    weight = "exp(-k * k / 2e0)"
    return f"""WITH {seg(D)}, m AS (SELECT video_id, motion, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS i FROM seg WHERE motion IS NOT NULL),
        d0 AS (SELECT video_id, i - 1 AS i, abs(motion - lag(motion) OVER (PARTITION BY video_id ORDER BY i)) AS d FROM m),
        d AS (SELECT video_id, i, d, count(*) OVER (PARTITION BY video_id) AS n FROM d0 WHERE i >= 0),
        k AS (SELECT video_id, i, n, k, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS j FROM {D.each('d', D.seq('-4', '4'), 'k')}),
        s AS (SELECT k.video_id, k.i, sum(o.d * {weight}) / sum({weight}) AS v FROM k JOIN d o ON o.video_id = k.video_id AND o.i = CASE WHEN k.j >= k.n THEN 2 * k.n - 1 - k.j ELSE k.j END GROUP BY k.video_id, k.i),
        r AS (SELECT video_id, i, row_number() OVER (PARTITION BY video_id ORDER BY round(v, 8) DESC, i) AS r FROM s),
        a AS (SELECT video_id, avg(d) AS mean FROM d GROUP BY video_id), vs AS (SELECT DISTINCT video_id FROM seg)
        SELECT vs.video_id, CAST(coalesce(r.i + 1, 0) AS BIGINT) AS rep, round(coalesce(a.mean, 0e0), 6) AS motion FROM vs
        LEFT JOIN a ON a.video_id = vs.video_id LEFT JOIN r ON r.video_id = vs.video_id AND r.r = 1"""


def anchors(D: Dialect) -> str:
    """Event names of at least six letters that stand exactly once in the spoken text of their video, with the place in that text.

    The text is the subtitles one after another; the place of a segment is the length of all before it, and the middle of
    the name is found in the segment whose range holds it.
    """
    sums = "sum(length(sub)) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {inv(D)}, {seg(D)}, t AS (SELECT video_id, event, min(event_no) AS event_no FROM inv WHERE length(event) >= 6 GROUP BY video_id, event HAVING count(*) = 1),
        u AS (SELECT video_id, idx, sub, coalesce({sums}, 0) AS start FROM seg WHERE sub <> ''),
        h AS (SELECT t.video_id, t.event_no, t.event, u.idx, u.start, u.start + position(t.event IN u.sub) - 1 + length(t.event) / 2e0 AS mid, u.start + length(u.sub) AS stop,
        (length(u.sub) - length(replace(u.sub, t.event, ''))) / length(t.event) AS times FROM t JOIN u ON u.video_id = t.video_id WHERE contains(u.sub, t.event)),
        c AS (SELECT *, sum(times) OVER (PARTITION BY video_id, event_no) AS total FROM h)
        SELECT video_id, event_no, idx, mid FROM c WHERE total = 1 AND mid >= start AND mid < stop"""


B = {
    "proj_p1_make_segments": lambda D: f"WITH {grid(D)} SELECT video_id, idx, s, round(e, 6) AS e FROM grd",
    "proj_p2_request_grid": lambda D: f"""WITH {vids(D)} SELECT video_id, i AS second, CAST(floor(i * fps + 0.5e0) AS BIGINT) AS frame FROM
        {D.each('vid', D.seq('0', 'floor(dur) - 1'), 'i')} WHERE fps IS NOT NULL""",
    "proj_p9_reference_spans": lambda D: f"""WITH {overlaps(D)} SELECT video_id, event_no, min(w) AS a, max(w) AS b, count(*) AS n FROM ov
        GROUP BY video_id, event_no""",
    "proj_p19_clock": lambda D: f"""WITH {seg(D)}, c AS (SELECT video_id, idx, s, concat(lpad(CAST({D.idiv('s', '60')} AS STRING), 3, '0'),
        ':', lpad(CAST(s % 60 AS STRING), 2, '0')) AS c FROM seg) SELECT video_id, idx, c AS clock, CAST(substring(c, 1, 3) AS INT) * 60 +
        CAST(substring(c, 5, 2) AS INT) AS seconds FROM c""",
    "j3_best_overlap": lambda D: f"""WITH {overlaps(D)}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, w ORDER BY round(len, 6)
        DESC, event_no) AS r FROM ov) SELECT video_id, w AS idx, event_no, round(len, 4) AS overlap FROM r WHERE r = 1""",
    "j4_rebucket": lambda D: f"""WITH {inv(D)}, ev AS (SELECT *, CAST(floor(s / 30e0) AS INT) AS c0, CAST(floor(e / 30e0) AS INT) AS c1 FROM
        inv WHERE s >= 0 AND e > s) SELECT video_id, c, count(*) AS n FROM {D.each('ev', D.seq('c0', 'c1'), 'c')} WHERE least(e, c * 30e0 +
        30e0) > greatest(s, c * 30e0) GROUP BY video_id, c""",
    "j8_citation_lookup": lambda D: f"""WITH {rep(D)}, {seg(D)}, c AS (SELECT report_id, sent_id, video_id, x FROM {D.each('rep', 'cites', 'x')})
        SELECT DISTINCT c.report_id, c.sent_id, c.x AS idx, s.s AS start_sec FROM c JOIN seg s ON s.video_id = c.video_id AND s.idx = c.x""",
    "j11_uncited_segments": lambda D: f"""WITH {rep(D)}, {seg(D)}, c AS (SELECT DISTINCT video_id, x FROM {D.each('rep', 'cites', 'x')})
        SELECT s.video_id, s.idx FROM seg s LEFT JOIN c ON c.video_id = s.video_id AND c.x = s.idx WHERE c.x IS NULL""",
    "j12_point_in_interval": lambda D: f"""WITH {overlaps(D)}, {qry(D)}, p AS (SELECT DISTINCT query_id, video_id, (gt_start + gt_end) / 2e0
        AS mid FROM qry WHERE gt_end > gt_start), b AS (SELECT query_id, video_id, mid, CAST(floor(mid / 5e0) AS INT) AS w FROM p WHERE mid
        >= 0) """
                                       "SELECT DISTINCT b.query_id, o.event_no FROM b JOIN ov o ON o.video_id = b.video_id AND o.w = b.w WHERE o.s <= b.mid AND b.mid < o.e",
    "j18_type_fanout": lambda D: f"""WITH {qry(D)}, x AS (SELECT query_id, video_id, query_type, i FROM {D.each('qry', 'gt', 'i')}) SELECT
        query_type, count(*) AS n, count(DISTINCT video_id || '#' || CAST(i AS STRING)) AS segments FROM x GROUP BY query_type""",
    "j19_unambiguous_segments": lambda D: f"""WITH {qry(D)}, x AS (SELECT query_id, video_id, i FROM {D.each('qry', 'gt', 'i')}) SELECT
        video_id, i AS idx, min(query_id) AS query_id FROM x GROUP BY video_id, i HAVING count(DISTINCT query_id) = 1""",
    "f11_validate_truth": lambda D: f"""WITH {qry(D)}, d AS (SELECT query_id, i FROM {D.each('(SELECT DISTINCT query_id, gt_start, gt_end FROM qry WHERE gt_end > gt_start AND gt_start >= 0) q', D.seq('floor(gt_start / 5e0)', 'floor(gt_end / 5e0)'), 'i')}
        WHERE least(gt_end, i * 5e0 + 5e0) - greatest(gt_start, i * 5e0) >= 1e0), """
                                    "j AS (SELECT d.query_id, d.i, q.gt FROM d JOIN qry q ON q.query_id = d.query_id WHERE q.gt IS NOT NULL) SELECT query_id, count(*) AS missing FROM j WHERE NOT " + D.has("gt", "i") + " GROUP BY query_id",
    "f16_eligible": lambda D: f"""WITH {vids(D)} SELECT video_id, CASE WHEN n_seg IS NULL THEN NULL ELSE n_seg BETWEEN 10 AND 40 END AS
        eligible, dur BETWEEN 60e0 AND 200e0 AS in_range FROM vid""",
    "f19_event_violations": lambda D: f"""WITH {inv(D)}, {vids(D)} SELECT i.video_id, i.event_no, coalesce(i.s >= i.e, true) AS v1,
        coalesce(i.e > v.dur, true) AS v2, i.event IS NULL OR trim(i.event) = '' AS v3 FROM inv i LEFT JOIN vid v ON v.video_id =
        i.video_id""",
    "f21_unclear_rate": lambda D: f"""WITH {inv(D)} SELECT video_id, round(avg(CASE WHEN event IS NULL THEN 1e0 ELSE 0e0 END), 6) AS unclear
        FROM inv GROUP BY video_id""",
    "a3_continuous_iou": lambda D: f"""WITH {overlaps(D)} SELECT video_id, event_no, w, round(len / greatest(e - w * 5e0, 5e0) , 6) AS share,
        round(len / (greatest(e, w * 5e0 + 5e0) - least(s, w * 5e0)), 6) AS iou FROM ov""",
    "a9_inclusive_iou": lambda D: f"""WITH {spans(D)}, n AS (SELECT video_id, event_no, a, b, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM sp
        WINDOW w AS (PARTITION BY video_id ORDER BY event_no)) SELECT video_id, event_no, round(greatest(0, least(b, pb) - greatest(a, pa) +
        1) * 1e0 / ((b - a + 1) + (pb - pa + 1) - greatest(0, least(b, pb) - greatest(a, pa) + 1)), 6) AS iou FROM n WHERE pa IS NOT NULL""",
    "a12_span_coverage": lambda D: f"""WITH {spans(D)}, {vids(D)}, x AS (SELECT DISTINCT video_id, i FROM {D.each('sp', D.seq('a', 'b'), 'i')})
        SELECT x.video_id, count(*) AS covered, round(count(*) * 1e0 / max(v.n_seg), 6) AS coverage FROM x JOIN vid v ON v.video_id =
        x.video_id WHERE v.n_seg IS NOT NULL GROUP BY x.video_id""",
    "a13_structural_summary": lambda D: f"""WITH {spans(D)} SELECT video_id, count(*) AS n, round(avg(b - a + 1), 6) AS mean_span, max(b - a +
        1) AS longest, sum({D.size('seg_idx')}) AS evidence, round(avg(length(event)), 6) AS chars FROM sp GROUP BY video_id""",
    "a50_inventory_summary": lambda D: f"""WITH {inv(D)}, w AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e, event_no ROWS
        BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM inv WHERE e > s) SELECT video_id, count(*) AS events, sum(CASE WHEN
        event IS NULL THEN 1 ELSE 0 END) AS unclear, sum(CASE WHEN s < before THEN 1 ELSE 0 END) AS overlapping, round(sum(e - s), 4) AS
        seconds FROM w GROUP BY video_id""",
    "e1_overlapped_chunks": lambda D: f"""WITH {seg(D)}, c AS (SELECT video_id, idx, k FROM {D.each('seg', D.seq('greatest(0, ceil((idx - 59) / 55e0))', 'floor(idx / 55e0)'), 'k')})
        SELECT video_id, k AS chunk, min(idx) AS first, max(idx) AS last, count(*) AS n FROM c GROUP BY video_id, k""",
    "g3_static_fallback": lambda D: f"""WITH {seg(D)} SELECT video_id, round(avg(CASE WHEN still THEN 1e0 ELSE 0e0 END), 6) AS ratio, avg(CASE
        WHEN still THEN 1e0 ELSE 0e0 END) > 0.5e0 AS warn FROM seg GROUP BY video_id""",
    "g5_chunk_plan": lambda D: f"""WITH {vids(D)} SELECT video_id, k, k * 23e0 AS s, round(least(k * 23e0 + 25e0, dur), 6) AS e FROM
        {D.each('vid', D.seq('0', 'greatest(0, ceil((dur - 25e0) / 23e0))'), 'k')}""",
    "t1_tumbling_windows": lambda D: f"""SELECT CAST(floor({'unix_micros(CAST(ts AS TIMESTAMP)) / 1000000e0' if D.spark else 'epoch(ts)'} /
        3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {D.t('events')} GROUP BY 1, 2""",
    "t2_hopping_windows": lambda D: f"""WITH e AS (SELECT CAST(floor({'unix_micros(CAST(ts AS TIMESTAMP)) / 1000000e0' if D.spark else 'epoch(ts)'}
        / 1800) AS BIGINT) AS h, value FROM {D.t('events')}), x AS (SELECT h - k AS start, value FROM {D.each('e', D.seq('0', '1'), 'k')})
        SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY start""",
    "t5_latest_state": lambda D: f"SELECT user_id, max_by(event_type, ts) AS state, max(event_id) AS last_event FROM {D.t('events')} GROUP BY user_id",
    "a57_progress": lambda D: f"""WITH {seg(D)} SELECT video_id, count(*) AS total, sum(CASE WHEN trim(coalesce(cap, '')) <> '' THEN 1 ELSE 0
        END) AS done FROM seg GROUP BY video_id""",
    "j1_overlap_join": lambda D: f"""WITH {overlaps(D)}, {seg(D)}, t AS (SELECT o.video_id, o.w, {D.join('o.event', ' ', 'o.event_no')} AS
        events FROM ov o WHERE o.event IS NOT NULL AND NOT {credit(D, 'o.event')} GROUP BY o.video_id, o.w)
        SELECT s.video_id, s.idx, coalesce(t.events, '') AS events FROM seg s LEFT JOIN t ON t.video_id = s.video_id AND t.w = s.idx""",
    # Places beyond the video's segments are no answer; where nothing overlaps, segment 0 is.
    "j2_derive_truth": lambda D: f"""WITH {qry(D)}, {vids(D)}, q AS (SELECT DISTINCT q.query_id, gt_start, gt_end, greatest(0e0,
        floor(gt_start / 5e0)) AS lo, least(floor(gt_end / 5e0), coalesce(n_seg - 1e0, floor(gt_end / 5e0))) AS hi
        FROM qry q LEFT JOIN vid v ON v.video_id = q.video_id WHERE gt_start IS NOT NULL AND gt_end IS NOT NULL AND q.query_id IS NOT NULL),
        g AS (SELECT query_id, i, least(gt_end, i * 5e0 + 5e0) - greatest(gt_start, i * 5e0) AS ov FROM {D.each('q', D.seq('lo', 'hi'), 'i')}),
        m AS (SELECT query_id, i, ov, max(ov) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY ov
        DESC, i) AS r FROM g WHERE ov > 0),
        k AS (SELECT query_id, i FROM m WHERE ov >= 1e0 OR (best < 1e0 AND r = 1)) SELECT q.query_id, CAST(coalesce(k.i, 0) AS BIGINT) AS
        idx FROM q LEFT JOIN k ON k.query_id = q.query_id""",
    "f7_validate_events": lambda D: f"""WITH {inv(D)}, {vids(D)} SELECT i.video_id, i.event_no, CASE WHEN i.event IS NULL OR trim(i.event) =
        '' THEN 'empty_event' WHEN i.seg_idx IS NULL OR {D.size('i.seg_idx')} = 0 THEN 'no_segments'
        WHEN i.span IS NULL OR {D.size('i.span')} <> 2 OR {D.at('i.span', 0)} > {D.at('i.span', 1)} OR {D.at('i.span', 0)} < 0 OR
        {D.at('i.span', 1)} >= v.n_seg THEN 'bad_span' WHEN {D.high('i.seg_idx')} >= v.n_seg THEN 'seg_out_of_range'
        WHEN {D.size('i.seg_idx')} > 4 THEN 'too_many_evidence' WHEN {D.size(D.uniq('i.seg_idx'))} < {D.size('i.seg_idx')} THEN
        'duplicate_evidence' WHEN {D.low('i.seg_idx')} < {D.at('i.span', 0)} OR {D.high('i.seg_idx')} > {D.at('i.span', 1)} THEN
        'evidence_outside_span'
        WHEN {corrupted(D, 'i.event')} THEN 'foreign_language' WHEN length(i.event) < 15 * {D.size('i.seg_idx')} THEN 'thin_description'
        ELSE 'keep' END AS outcome FROM inv i LEFT JOIN vid v ON v.video_id = i.video_id""",
    # The four smallest of a merged event's evidence; an unmerged event keeps its own.
    "e4_merge_events": lambda D: f"""WITH {islands(D)}, h AS (SELECT video_id, event, part, min(a) AS a, max(b) AS b, count(*) AS merged
        FROM isl GROUP BY video_id, event, part),
        x AS (SELECT DISTINCT video_id, event, part, i FROM {D.each('isl', 'seg_idx', 'i')}), ev AS (SELECT video_id, event, part,
        {D.collect('i')} AS evidence FROM x GROUP BY video_id, event, part)
        SELECT h.video_id, h.event, h.a, h.b, h.merged, CASE WHEN h.merged > 1 THEN {D.first('ev.evidence', 4)} ELSE ev.evidence END AS
        evidence,
        row_number() OVER (PARTITION BY h.video_id ORDER BY h.a, h.event, h.b) AS place FROM h LEFT JOIN ev ON ev.video_id = h.video_id AND
        ev.event = h.event AND ev.part = h.part""",
    "g1_motion_peak": motion_peak,
    "j12_build_anchors": anchors,
}
QUERIES, SQL = register(B)
