"""Detector grids, routers, label joins and slices of the evaluation."""

from __future__ import annotations

from tidemark.plans import dialect as T
from tidemark.plans.dialect import KINDS, Dialect, hashed, paired, qry, ranked, register, rep, scores, seg
from tidemark.plans.flow import family
from tidemark.plans.inference import ALPHAS, bounds, curves, deltas, drawn, means

# Grids of the longest run and of the share of foreign letters, and the least precision of a choice.
RUNS, SHARES, FLOOR = (1, 2, 3, 4, 5), (0.01, 0.05, 0.1, 0.2, 0.3), 0.5


def features(D: Dialect) -> str:
    """ft: per caption its longest foreign run, count and share, whether its label says it is foreign, and how many grid steps it reaches."""
    run = f"coalesce({D.high(D.map_(D.find('cap', f'[{T.FOREIGN}]+'), 'r -> length(r)'))}, 0)"
    reach = lambda x, steps: " + ".join(f"CASE WHEN {x} >= {s} THEN 1 ELSE 0 END" for s in steps)
    return f"""sg AS (SELECT video_id, idx, max(caption) AS cap, max(caption_arm) AS arm, max(lower(trim(caption_lang))) AS lang FROM
        {D.t('segments')} GROUP BY video_id, idx),
        f0 AS (SELECT video_id, idx, arm, cap, lang, {run} AS run, length({D.rep('cap', f'[^{T.FOREIGN}]')}) AS cnt FROM sg WHERE cap <>
        ''),
        ft AS (SELECT video_id, idx, arm, cap, run, cnt, cnt * 1e0 / length(cap) AS share, coalesce(lang LIKE 'ja%' OR lang LIKE 'zh%' OR
        lang IN ('chinese', 'japanese'), false) AS drift,
        {reach('run', RUNS)} AS rs, {reach('cnt * 1e0 / length(cap)', SHARES)} AS ts, CASE WHEN cnt = 0 THEN 'C0' WHEN cnt < 3 THEN 'C1'
        WHEN cnt < 10 THEN 'C2' ELSE 'C3' END AS cell FROM f0)"""


def grid(D: Dialect) -> str:
    """gd: 60 rules, 5 on the run, 5 on the share, 25 of either and 25 of both; r and t are steps of the grids, 0 where unused."""
    return f"""g5 AS (SELECT k FROM {D.each('(SELECT 1 AS one) z', D.seq('1', '5'), 'k')}),
        gd AS (SELECT 'R_only' AS rule, k AS r, 0 AS t FROM g5 UNION ALL SELECT 'T_only', 0, k FROM g5 UNION ALL SELECT 'R_or_T', a.k, b.k
        FROM g5 a CROSS JOIN g5 b UNION ALL SELECT 'R_and_T', a.k, b.k FROM g5 a CROSS JOIN g5 b)"""


FIRES = "CASE rule WHEN 'R_only' THEN rs >= r WHEN 'T_only' THEN ts >= t WHEN 'R_or_T' THEN rs >= r OR ts >= t ELSE rs >= r AND ts >= t END"


def cells(D: Dialect) -> str:
    """st: every rule's counts; captions are counted per reached step first, so the grid meets at most 36 x 4 rows."""
    return f"""{features(D)}, {grid(D)}, ct AS (SELECT cell, rs, ts, count(*) AS n, sum(CASE WHEN drift THEN 1 ELSE 0 END) AS pos FROM ft
        GROUP BY cell, rs, ts),
        st AS (SELECT rule, r, t, sum(CASE WHEN {FIRES} THEN n ELSE 0 END) AS fired, sum(CASE WHEN {FIRES} THEN pos ELSE 0 END) AS tp,
        sum(pos) AS pos, sum(CASE WHEN cell = 'C0' AND {FIRES} THEN n ELSE 0 END) AS in_c0
        FROM ct CROSS JOIN gd GROUP BY rule, r, t)"""


def routed(D: Dialect) -> str:
    """ro: per query its kind, the kind two patterns give it and its reciprocal rank at every alpha."""
    return f"""{curves(D)}, ro AS (SELECT cv.*, t.query_type AS gold, {T.kind_of(D, 't.text')} AS pred
        FROM cv JOIN (SELECT query_id, max(query_type) AS query_type, max(text) AS text FROM qry GROUP BY query_id) t ON t.query_id = cv.query_id)"""


def centroids(D: Dialect) -> str:
    """Leave-one-out nearest centroid: a query's own vector is taken out of its class before it is compared."""
    return f"""WITH {scores(D)}, u AS (SELECT query_id, query_type AS gold, {D.map_('qe', 'x -> x / qn')} AS e FROM qv WHERE qn > 0 AND
        query_type IS NOT NULL),
        x AS (SELECT query_id, gold, d, CAST({D.at('e', 'd')} AS DOUBLE) AS v FROM {D.each('u', D.seq('0', '63'), 'd')}), s AS (SELECT gold
        AS k, d, sum(v) AS s, count(*) AS n FROM x GROUP BY gold, d),
        c AS (SELECT x.query_id, x.gold, s.k, x.v, CASE WHEN s.k = x.gold THEN (s.s - x.v) / nullif(s.n - 1, 0) ELSE s.s / s.n END AS m FROM
        x JOIN s ON s.d = x.d),
        q AS (SELECT query_id, gold, k, round(sum(v * m) / nullif(sqrt(sum(m * m)), 0e0), 7) AS sim FROM c GROUP BY query_id, gold, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(sim, -2e0) DESC, k) AS r FROM q)
        SELECT gold, k AS pred, count(*) AS n FROM r WHERE r = 1 GROUP BY gold, k"""


def a65(D: Dialect) -> str:
    """The sign of the mean difference over four seeds' intervals, the types, and the metrics."""
    seeds = (1, 2, 3, 4)
    tables = ", ".join(f"""{drawn(D, 'dl', 'query_id', s, f'r{s}')}, m{s} AS (SELECT b, sum(w * d) / nullif(sum(w), 0) AS x FROM r{s} GROUP BY
        b)""" for s in seeds)
    parts = " UNION ALL ".join(f"SELECT 'seed {s}' AS slice, {bounds(D, 'x')} FROM m{s}" for s in seeds)
    return f"""WITH {deltas(D)}, {tables}, o AS (SELECT avg(d) AS d, avg(hit10) AS h FROM dl), s AS ({parts})
        SELECT slice, lo, hi, CASE WHEN (SELECT max(d) FROM o) >= 0 THEN hi >= 0 ELSE lo <= 0 END AS agrees FROM s UNION ALL
        SELECT concat('type ', query_type), round(min(d), 4), round(max(d), 4), round(avg(d), 9) * round((SELECT max(x.d) FROM o x), 9) >= 0
        FROM dl GROUP BY query_type UNION ALL
        SELECT 'metric hit10', round(h, 4), round(h, 4), round(h, 9) * round(d, 9) >= 0 FROM o"""


def b16(D: Dialect) -> str:
    """Whole videos are put in another order and cut again to the sizes of the videos before: labels keep their blocks.

    Places come from the sizes of the videos before, which are counted in ranges of the order first.
    """
    return f"""WITH {seg(D)}, lb AS (SELECT video_id, idx, still FROM seg WHERE still IS NOT NULL), vs AS (SELECT video_id, count(*) AS c
        FROM lb GROUP BY video_id),
        o AS (SELECT video_id, c, {D.draw('4294967296', '16', 'video_id')} AS h, {D.draw('4294967296', '61', 'video_id')} AS g FROM vs),
        ph AS (SELECT p, sum(c) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM (SELECT {D.idiv('h', '16777216')}
        AS p, sum(c) AS c FROM o GROUP BY 1) x),
        pg AS (SELECT p, sum(c) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM (SELECT {D.idiv('g', '16777216')}
        AS p, sum(c) AS c FROM o GROUP BY 1) x),
        fh AS (SELECT o.video_id, coalesce(ph.base, 0) + coalesce(sum(o.c) OVER (PARTITION BY ph.p ORDER BY o.h, o.video_id ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o JOIN ph ON ph.p = {D.idiv('o.h', '16777216')}),
        fg AS (SELECT o.video_id, coalesce(pg.base, 0) + coalesce(sum(o.c) OVER (PARTITION BY pg.p ORDER BY o.g, o.video_id ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o JOIN pg ON pg.p = {D.idiv('o.g', '16777216')}),
        n AS (SELECT video_id, still, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS i FROM lb),
        a AS (SELECT n.video_id, fh.start + n.i AS place FROM n JOIN fh ON fh.video_id = n.video_id), b AS (SELECT n.still, fg.start + n.i
        AS place FROM n JOIN fg ON fg.video_id = n.video_id)
        SELECT a.video_id, count(*) AS n, sum(CASE WHEN b.still THEN 1 ELSE 0 END) AS still FROM a JOIN b ON b.place = a.place GROUP BY
        a.video_id"""


B = {
    "f22_detector_rules": lambda D: f"""WITH {features(D)} SELECT video_id, idx, run >= 3 AS r_only, share >= 0.2e0 AS t_only, run >= 3 OR
        share >= 0.2e0 AS r_or_t, run >= 3 AND share >= 0.2e0 AS r_and_t FROM ft""",
    "f23_c0_invariant": lambda D: f"WITH {cells(D)} SELECT rule, r, t, in_c0 = 0 AS holds FROM st",
    "n19_detector_grid": lambda D: f"WITH {grid(D)} SELECT rule, r, t FROM gd",
    "a39_detector_metrics": lambda D: f"""WITH {cells(D)} SELECT rule, r, t, fired, tp, round(tp * 1e0 / nullif(fired, 0), 6) AS precision,
        round(tp * 1e0 / nullif(pos, 0), 6) AS recall FROM st""",
    "a39_false_alarms": lambda D: f"""WITH {features(D)} SELECT cell, count(*) AS n, sum(CASE WHEN drift THEN 1 ELSE 0 END) AS pos, sum(CASE
        WHEN rs >= 3 AND NOT drift THEN 1 ELSE 0 END) AS false_alarms FROM ft GROUP BY cell""",
    "r8_choose_detector": lambda D: f"""WITH {cells(D)}, o AS (SELECT *, round(tp * 1e0 / nullif(fired, 0), 9) AS pr, round(tp * 1e0 /
        nullif(pos, 0), 9) AS rc, CASE WHEN rule IN ('R_only', 'T_only') THEN 0 ELSE 1 END AS parts FROM st),
        p AS (SELECT *, row_number() OVER (ORDER BY rc DESC, parts, r, t DESC, rule) AS place FROM o WHERE pr >= {FLOOR}e0) SELECT place,
        rule, r, t, round(pr, 6) AS precision, round(rc, 6) AS recall FROM p WHERE place <= 2""",
    "a38_label_histogram": lambda D: f"""WITH {features(D)} SELECT arm, cell, count(*) AS n, sum(CASE WHEN drift THEN 1 ELSE 0 END) AS drift
        FROM ft GROUP BY GROUPING SETS ((arm), (cell))""",
    "a40_missed_zone": lambda D: f"""WITH {features(D)}, s AS (SELECT cell, sum(CASE WHEN drift AND rs >= 3 THEN 1 ELSE 0 END) AS det,
        sum(CASE WHEN drift AND rs < 3 THEN 1 ELSE 0 END) AS missed, count(*) AS n FROM ft GROUP BY cell)
        SELECT cell, det, missed, round(det * 1e0 / nullif(det + missed, 0), 6) AS recall, round(greatest(0e0, (missed * 1e0 / n + 1.9208e0
        / n - 1.96e0 * sqrt((missed * 1e0 / n) * (1 - missed * 1e0 / n) / n + 0.9604e0 / (n * n))) / (1 + 3.8416e0 / n)), 6) AS missed_lo,
        round(least(1e0, (missed * 1e0 / n + 1.9208e0 / n + 1.96e0 * sqrt((missed * 1e0 / n) * (1 - missed * 1e0 / n) / n + 0.9604e0 / (n *
        n))) / (1 + 3.8416e0 / n)), 6) AS missed_hi FROM s""",
    "a41_combined_recall": lambda D: f"""WITH {features(D)}, h AS (SELECT *, {D.draw('2', '41', 'video_id')} AS round_no FROM ft WHERE
        drift) SELECT CASE WHEN round_no = 0 THEN 'fresh' ELSE 'carried' END AS part, count(*) AS pos, round(avg(CASE WHEN rs >= 3 THEN 1e0
        ELSE 0e0 END), 6) AS recall
        FROM h GROUP BY GROUPING SETS ((CASE WHEN round_no = 0 THEN 'fresh' ELSE 'carried' END), ())""",
    "n7_population": lambda D: f"""WITH {features(D)} SELECT arm, video_id, idx, run, cnt, round(share, 6) AS share, {T.corrupted(D, 'cap')}
        AS corrupted, cell FROM ft""",
    "n21_second_look": lambda D: f"""WITH {features(D)} SELECT video_id, idx, cell, NOT {T.corrupted(D, 'cap')} AND cnt > 0 AS pending FROM ft
        WHERE drift OR cnt > 0""",
    "n11_halves": lambda D: f"""WITH {qry(D)}, x AS (SELECT video_id, i, min(query_id) AS query_id FROM {D.each('qry', 'gt', 'i')} WHERE
        video_id IS NOT NULL GROUP BY video_id, i HAVING count(DISTINCT query_id) = 1),
        s AS (SELECT video_id, i, query_id, {family(D)} AS domain FROM x), {hashed(D, 's', 'domain', '11', 'video_id', 'i')} SELECT
        video_id, i AS idx, CASE WHEN rn <= n / 2e0 THEN 'selection' ELSE 'evaluation' END AS half FROM hk""",
    "n2_type_quota": lambda D: f"""WITH {qry(D)}, s AS (SELECT query_type, count(DISTINCT query_id) AS supply FROM qry WHERE query_type IS
        NOT NULL GROUP BY query_type), q AS (SELECT *, 100e0 * supply / sum(supply) OVER () AS exact FROM s),
        r AS (SELECT *, 100 - sum(floor(exact)) OVER () AS rest, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, CASE
        query_type WHEN '{KINDS[0]}' THEN 0 WHEN '{KINDS[1]}' THEN 1 ELSE 2 END) AS pos FROM q)
        SELECT query_type, CAST(floor(exact) + CASE WHEN pos <= rest THEN 1 ELSE 0 END AS BIGINT) AS seats FROM r""",
    "j7_manifest_labels": lambda D: f"""WITH {features(D)}, m AS (SELECT video_id, idx, cell, row_number() OVER (PARTITION BY cell ORDER BY
        {D.draw('1000000007', '7', 'video_id', 'idx')}, video_id, idx) AS r FROM ft),
        p AS (SELECT cell, count(*) AS population FROM ft GROUP BY cell), l AS (SELECT video_id, idx, lang FROM sg WHERE lang IS NOT NULL
        AND lang <> '')
        SELECT m.cell, max(p.population) AS population, count(*) AS sampled, count(l.idx) AS labelled FROM m JOIN p ON p.cell = m.cell LEFT
        JOIN l ON l.video_id = m.video_id AND l.idx = m.idx WHERE m.r <= 50 GROUP BY m.cell""",
    "j17_score_answers": lambda D: f"""WITH {qry(D)}, g AS (SELECT query_id, max(query_type) AS gold, max(text) AS text FROM qry WHERE
        query_id IS NOT NULL GROUP BY query_id), k AS (SELECT query_id, {D.sha('query_id')} AS blind FROM g),
        f AS (SELECT {D.sha('query_id')} AS blind, {T.kind_of(D, 'text')} AS answer FROM g WHERE text IS NOT NULL)
        SELECT g.gold, count(*) AS n, sum(CASE WHEN f.answer IS NULL THEN 1 ELSE 0 END) AS missing, round(avg(CASE WHEN f.answer = g.gold
        THEN 1e0 WHEN f.answer IS NOT NULL THEN 0e0 END), 6) AS accuracy FROM g JOIN k ON k.query_id = g.query_id LEFT JOIN f ON f.blind =
        k.blind GROUP BY g.gold""",
    "v25_centroid_router": centroids,
    "r6_caption_order": lambda D: f"""WITH {scores(D)}, r AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY sp DESC,
        idx) AS rank FROM sc) SELECT query_id, idx, rank FROM r WHERE rank <= 10""",
    "a34_by_subtitle_rank": lambda D: f"""WITH {paired(D)} SELECT CASE WHEN k0 = 0 THEN 'none' WHEN k0 = 1 THEN 'rank1' WHEN k0 <= 5 THEN
        'rank2_5' ELSE 'rank6' END AS stratum, count(*) AS n, round(avg(m0), 6) AS base, round(avg(m1), 6) AS fused, round(avg(m1 - m0), 6)
        AS delta FROM rr GROUP BY 1""",
    "a35_plateau": lambda D: f"""WITH {curves(D)}, {means(D, 'cv')}, nr AS (SELECT mn.i, mn.mrr >= (SELECT max(x.mrr) FROM mn x) - 0.005e0
        AS near FROM mn),
        pt AS (SELECT nr.i, near, be.best, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (ORDER BY nr.i) AS island FROM nr CROSS JOIN be)
        SELECT max(best) / 10e0 AS best, min(i) / 10e0 AS lo, max(i) / 10e0 AS hi, count(*) AS width FROM pt WHERE near AND island = (SELECT
        max(y.island) FROM pt y WHERE y.i = y.best)""",
    "a53_contrast_rates": lambda D: f"""WITH {seg(D)}, c AS (SELECT arm, still, coalesce(trim(sub), '') <> '' AS spoken FROM seg WHERE still
        IS NOT NULL AND arm IS NOT NULL), g AS (SELECT arm, avg(CASE WHEN still THEN CASE WHEN spoken THEN 1e0 ELSE 0e0 END END) AS a,
        avg(CASE WHEN NOT still THEN CASE WHEN spoken THEN 1e0 ELSE 0e0 END END) AS b FROM c GROUP BY arm)
        SELECT arm, round(a, 6) AS when_still, round(b, 6) AS when_moving, CASE WHEN a IS NULL OR b IS NULL THEN 'undecided' WHEN a - b >
        0.1e0 THEN 'still' WHEN b - a > 0.1e0 THEN 'moving' ELSE 'alike' END AS verdict FROM g""",
    "a54_judge_gate": lambda D: f"""WITH {qry(D)}, q AS (SELECT query_id, max(split) AS split, max(query_type) AS gold, max(text) AS text
        FROM qry GROUP BY query_id), j AS (SELECT split, gold = '{KINDS[0]}' AS pos, {T.kind_of(D, 'text')} = '{KINDS[0]}' AS said FROM q
        WHERE text IS NOT NULL AND gold IS NOT NULL)
        SELECT split, round(avg(CASE WHEN pos THEN CASE WHEN said THEN 1e0 ELSE 0e0 END END), 6) AS pos_right, round(avg(CASE WHEN NOT pos
        THEN CASE WHEN said THEN 0e0 ELSE 1e0 END END), 6) AS neg_right,
        coalesce(avg(CASE WHEN pos THEN CASE WHEN said THEN 1e0 ELSE 0e0 END END) >= 0.75e0 AND avg(CASE WHEN NOT pos THEN CASE WHEN said
        THEN 0e0 ELSE 1e0 END END) >= 0.75e0, false) AS passes FROM j GROUP BY split""",
    "a58_routing": lambda D: f"""WITH {routed(D)} SELECT gold, pred, count(*) AS n, round(avg(CASE WHEN pred = '{KINDS[0]}' THEN a10 WHEN
        pred = '{KINDS[1]}' THEN a0 ELSE a5 END), 6) AS routed_mrr,
        round(avg(greatest({', '.join(f'a{i}' for i in ALPHAS)})), 6) AS oracle_mrr FROM ro GROUP BY gold, pred""",
    "a59_abstention_by_video": lambda D: f"""WITH {scores(D)}, m AS (SELECT query_id, max(video_id) AS video_id, greatest(max(ss), max(sp))
        < 0.55e0 AS banner, bool_or(good) AS rel FROM sc GROUP BY query_id)
        SELECT video_id, count(*) AS n, round(avg(CASE WHEN rel THEN CASE WHEN banner THEN 1e0 ELSE 0e0 END END), 6) AS false_banner,
        round(avg(CASE WHEN NOT rel THEN CASE WHEN banner THEN 1e0 ELSE 0e0 END END), 6) AS detected FROM m GROUP BY video_id""",
    "a65_stability": a65,
    "a66_length_matched": lambda D: f"""WITH {seg(D)}, c AS (SELECT arm, n, CASE WHEN mode = 0 THEN substring(cap, 1, n) ELSE
        {T.to_sentence(D, 'substring(cap, 1, n)')} END AS piece, mode FROM (SELECT arm, cap, k * 20 AS n FROM {D.each('seg', D.seq('1', '4'), 'k')}
        WHERE cap IS NOT NULL AND arm IS NOT NULL) x
        CROSS JOIN (SELECT 0 AS mode UNION ALL SELECT 1) y), g AS (SELECT n, mode, arm, avg(length(piece)) AS chars, avg(CASE WHEN
        {T.corrupted(D, 'piece')} THEN 1e0 ELSE 0e0 END) AS bad FROM c GROUP BY n, mode, arm), o AS (SELECT n, mode, bad AS ref FROM g WHERE
        arm = 'human_ref')
        SELECT g.n, g.mode, g.arm, round(chars, 4) AS chars, round(bad, 6) AS corrupted, round(bad - ref, 6) AS against_reference FROM g
        LEFT JOIN o ON o.n = g.n AND o.mode = g.mode""",
    "a67_corrupted_on_top": lambda D: f"""WITH {ranked(D)}, {seg(D)} SELECT r.rank, count(*) AS n, sum(CASE WHEN {T.corrupted(D, 's.cap')}
        THEN 1 ELSE 0 END) AS corrupted FROM rk r JOIN seg s ON s.video_id = r.video_id AND s.idx = r.idx WHERE r.rank <= 10 GROUP BY
        r.rank""",
    "a68_postprocessing_delta": lambda D: f"""WITH {seg(D)}, p AS (SELECT arm, cap, {T.to_sentence(D, 'bare')} AS clean FROM (SELECT arm,
        cap, {T.strip_foreign(D, 'cap')} AS bare FROM seg WHERE cap IS NOT NULL) x)
        SELECT arm, round(avg(CASE WHEN clean <> cap THEN 1e0 ELSE 0e0 END), 6) AS changed, sum(CASE WHEN {T.corrupted(D, 'cap')} THEN 1
        ELSE 0 END) AS before, sum(CASE WHEN {T.corrupted(D, 'clean')} THEN 1 ELSE 0 END) AS after FROM p GROUP BY arm""",
    "a69_strip_contrast": lambda D: f"""WITH {seg(D)} SELECT video_id, count(*) AS n, sum(CASE WHEN {T.strip_foreign(D, 'cap')} <> trim(cap)
        AND NOT {T.corrupted(D, 'cap')} THEN 1 ELSE 0 END) AS touched FROM seg WHERE cap IS NOT NULL GROUP BY video_id""",
    "a70_gated_majority": lambda D: f"""WITH {features(D)}, v AS (SELECT cell, drift, run >= 2 AS j1, share >= 0.1e0 AS j2, cnt >= 3 AS j3
        FROM ft), l AS (SELECT cell, drift, j, CASE j WHEN 1 THEN j1 WHEN 2 THEN j2 ELSE j3 END AS says, j1, j2, j3 FROM {D.each('v', D.seq('1', '3'), 'j')}),
        g AS (SELECT j, avg(CASE WHEN NOT drift THEN CASE WHEN says THEN 0e0 ELSE 1e0 END END) >= 0.75e0 AS ok FROM l GROUP BY j), a AS
        (SELECT max(CASE WHEN j = 1 AND ok THEN 1 ELSE 0 END) AS o1, max(CASE WHEN j = 2 AND ok THEN 1 ELSE 0 END) AS o2, max(CASE WHEN j =
        3 AND ok THEN 1 ELSE 0 END) AS o3 FROM g),
        s AS (SELECT cell, o1 + o2 + o3 AS judges, o1 * CASE WHEN j1 THEN 1 ELSE 0 END + o2 * CASE WHEN j2 THEN 1 ELSE 0 END + o3 * CASE
        WHEN j3 THEN 1 ELSE 0 END AS yes FROM v CROSS JOIN a)
        SELECT cell, count(*) AS n, max(judges) AS judges, round(avg(CASE WHEN judges >= 2 AND yes * 2 <> judges THEN CASE WHEN yes * 2 >
        judges THEN 1e0 ELSE 0e0 END END), 6) AS share FROM s GROUP BY cell""",
    "a72_judge_confusion": lambda D: f"""WITH {rep(D)}, j AS (SELECT model, {D.size('cites')} > 0 AS inside, CASE WHEN text IS NOT NULL THEN
        {D.rx('text', 'seg#[0-9]')} END AS said FROM rep)
        SELECT model, round(avg(CASE WHEN coalesce(inside, false) = said THEN 1e0 WHEN said IS NOT NULL THEN 0e0 END), 6) AS accuracy,
        round(avg(CASE WHEN inside THEN CASE WHEN said THEN 1e0 WHEN NOT said THEN 0e0 END END), 6) AS recall_in,
        round(avg(CASE WHEN NOT coalesce(inside, false) THEN CASE WHEN said THEN 0e0 WHEN NOT said THEN 1e0 END END), 6) AS specificity_out,
        sum(CASE WHEN said IS NULL THEN 1 ELSE 0 END) AS failures FROM j GROUP BY model""",
    "a74_channel_sweep": lambda D: f"""WITH {scores(D)}, m AS (SELECT query_id, greatest(max(ss), max(sp)) AS best, bool_or(good) AS rel
        FROM sc GROUP BY query_id), g AS (SELECT 50 + i AS tau, best, rel FROM {D.each('m', D.seq('0', '12'), 'i')})
        SELECT tau / 100e0 AS tau, sum(CASE WHEN rel AND best < tau / 100e0 THEN 1 ELSE 0 END) AS false_abstain, sum(CASE WHEN NOT rel AND
        best < tau / 100e0 THEN 1 ELSE 0 END) AS detected FROM g GROUP BY tau""",
    "a42_pick_threshold": lambda D: f"""WITH {scores(D)}, m AS (SELECT query_id, greatest(max(ss), max(sp)) AS best, bool_or(good) AS rel
        FROM sc GROUP BY query_id), g AS (SELECT 40 + i AS tau, best, rel FROM {D.each('m', D.seq('0', '40'), 'i')}),
        s AS (SELECT tau, sum(CASE WHEN rel AND best < tau / 100e0 THEN 1 ELSE 0 END) AS wrong, sum(CASE WHEN NOT rel AND best < tau / 100e0
        THEN 1 ELSE 0 END) AS detected FROM g GROUP BY tau)
        SELECT tau / 100e0 AS tau, wrong, detected, coalesce(tau = (SELECT max(x.tau) FROM s x WHERE x.wrong = 0), false) AS chosen FROM
        s""",
    "b16_permuted_blocks": b16,
}
QUERIES, SQL = register(B)
