"""Bootstraps, permutation tests, the search for alpha and false-discovery control.

A replicate weighs every unit by a Poisson number of mean 1 hashed from (seed, replicate, unit): one draw for all metrics and
arms, the same in both engines, and no unit is numbered, so nothing is sorted in one task. Clusters are summed before they are drawn.
"""

from __future__ import annotations

from tidemark.plans.dialect import Dialect, inv, paired, register, scores, seg, zscore

R = 2000
ALPHAS = tuple(range(11))
HITS = (1, 5, 10)
POOLS = (12, 24, 48, 96)


def drawn(D: Dialect, source: str, unit: str, seed: int, name: str = "rp") -> str:
    """name: the rows of ``source`` for every replicate b, with the weight w."""
    return (f"""{name}0 AS (SELECT x.*, b, {D.draw('4294967296', str(seed), 'b', unit)} AS h FROM {D.each(f'(SELECT * FROM {source}) x', D.seq('1', str(R)), 'b')}),
        """
            f"{name} AS (SELECT *, {D.poisson('h')} AS w FROM {name}0)")


def deltas(D: Dialect) -> str:
    """dl: per query the paired differences of the metrics."""
    hits = ", ".join(f"CASE WHEN k1 BETWEEN 1 AND {k} THEN 1e0 ELSE 0e0 END - CASE WHEN k0 BETWEEN 1 AND {k} THEN 1e0 ELSE 0e0 END AS hit{k}" for k in HITS)
    return f"{paired(D)}, dl AS (SELECT query_id, video_id, coalesce(query_type, '?') AS query_type, m0, m1, m1 - m0 AS d, {hits} FROM rr)"


def videos_of(D: Dialect) -> str:
    """vv: per video the sum and the number of the differences."""
    return f"{deltas(D)}, vv AS (SELECT video_id, sum(d) AS s, count(*) AS c FROM dl GROUP BY video_id)"


def bounds(D: Dialect, x: str, lo: str = "lo", hi: str = "hi") -> str:
    return f"round({D.pct(x, 0.025)}, 4) AS {lo}, round({D.pct(x, 0.975)}, 4) AS {hi}"


def b1(D: Dialect) -> str:
    metrics = ("d", *[f"hit{k}" for k in HITS])
    sums = ", ".join(f"sum(w * {m}) / nullif(sum(w), 0) AS {m}" for m in metrics)
    names = D.at(D.arr(*[f"'{'mrr' if m == 'd' else m}'" for m in metrics]), "i")
    return (f"WITH {deltas(D)}, {drawn(D, 'dl', 'query_id', 42)}, m AS (SELECT b, {sums} FROM rp GROUP BY b), "
            f"l AS (SELECT {names} AS metric, {D.at(D.arr(*metrics), 'i')} AS x FROM {D.each('m', D.seq('0', str(len(HITS))), 'i')}) "
            f"SELECT metric, {bounds(D, 'x')} FROM l GROUP BY metric")


def curves(D: Dialect) -> str:
    """cv: per query the reciprocal rank at every alpha, a0 to a10."""
    order = "round(alpha * zs + (1e0 - alpha) * CASE WHEN mask THEN zs ELSE zp END, 8) DESC, idx"
    each = ", ".join(f"max(CASE WHEN i = {i} THEN rr END) AS a{i}" for i in ALPHAS)
    return f"""{scores(D)}, zz AS (SELECT *, {zscore('ss')} AS zs, {zscore('sp')} AS zp FROM sc),
        g AS (SELECT i, i / 10e0 AS alpha, zz.* FROM {D.each('zz', D.seq('0', '10'), 'i')}),
        s AS (SELECT i, query_id, video_id, good, row_number() OVER (PARTITION BY i, query_id ORDER BY {order}) AS r FROM g),
        q AS (SELECT i, query_id, max(video_id) AS video_id, coalesce(1e0 / min(CASE WHEN good THEN r END), 0e0) AS rr FROM s GROUP BY i, query_id),
        cv AS (SELECT query_id, max(video_id) AS video_id, {each} FROM q GROUP BY query_id)"""


def at_alpha(D: Dialect, i: str) -> str:
    return D.at(D.arr(*[f"a{k}" for k in ALPHAS]), i)


def means(D: Dialect, source: str) -> str:
    """mn: the mean reciprocal rank of every alpha; be: the best alpha, ties to the larger."""
    rows = f"SELECT i, avg({at_alpha(D, 'i')}) AS mrr FROM {D.each(source, D.seq('0', '10'), 'i')} GROUP BY i"
    return f"mn AS ({rows}), be AS (SELECT max(i) AS best FROM mn WHERE mrr >= (SELECT max(mrr) FROM mn))"


def against_best(D: Dialect, replicate: str) -> str:
    """ci: each alpha's interval of the difference to the best one, from ``replicate``, a table of (b, a0 .. a10)."""
    return f"""bb AS (SELECT * FROM {replicate} CROSS JOIN be), df AS (SELECT i, {at_alpha(D, 'i')} - {at_alpha(D, 'best')} AS d FROM
        {D.each('bb', D.seq('0', '10'), 'i')}),
        ci AS (SELECT i, {D.pct('d', 0.025)} AS lo, {D.pct('d', 0.975)} AS hi FROM df GROUP BY i)"""


def b2(D: Dialect) -> str:
    sums = ", ".join(f"sum(w * a{i}) / nullif(sum(w), 0) AS a{i}" for i in ALPHAS)
    return f"""WITH {curves(D)}, {means(D, 'cv')}, {drawn(D, 'cv', 'query_id', 42)}, m AS (SELECT b, {sums} FROM rp GROUP BY b), {against_best(D, 'm')},
        st AS (SELECT max(i) AS star FROM ci WHERE lo <= 0 AND hi >= 0)
        SELECT mn.i / 10e0 AS alpha, round(mn.mrr, 6) AS mrr, round(ci.lo, 4) AS lo, round(ci.hi, 4) AS hi, ci.lo <= 0 AND ci.hi >= 0 AS tied,
        mn.i = be.best AS is_best, mn.i = st.star AS is_star FROM mn JOIN ci ON ci.i = mn.i CROSS JOIN be CROSS JOIN st"""


def b2_by_video(D: Dialect) -> str:
    return f"WITH {curves(D)} SELECT video_id, " + ", ".join(f"round(avg(a{i}), 4) AS a{i}" for i in ALPHAS) + " FROM cv GROUP BY video_id"


def b21(D: Dialect) -> str:
    per = ", ".join(f"sum(a{i}) AS a{i}" for i in ALPHAS)
    sums = ", ".join(f"sum(w * a{i}) / nullif(sum(w * c), 0) AS a{i}" for i in ALPHAS)
    return f"""WITH {curves(D)}, {means(D, 'cv')}, vs AS (SELECT video_id, count(*) AS c, {per} FROM cv GROUP BY video_id),
        {drawn(D, 'vs', 'video_id', 7)}, m AS (SELECT b, {sums} FROM rp GROUP BY b), {against_best(D, 'm')},
        sh AS (SELECT i, mrr, lag(mrr) OVER (ORDER BY i) AS left_mrr, lead(mrr) OVER (ORDER BY i) AS right_mrr FROM mn)
        SELECT sh.i / 10e0 AS alpha, round(ci.lo, 4) AS lo, round(ci.hi, 4) AS hi, ci.lo <= 0 AND ci.hi >= 0 AS tied,
        round(sh.mrr - greatest(coalesce(left_mrr, right_mrr), coalesce(right_mrr, left_mrr)), 6) AS neighbour_drop,
        sh.mrr > coalesce(left_mrr, -1e0) AND sh.mrr > coalesce(right_mrr, -1e0) AS local_maximum FROM sh JOIN ci ON ci.i = sh.i"""


def flips(D: Dialect, group: str, seed: int = 11) -> str:
    """fp: per group the sign-flip test's p-value of the mean difference."""
    return f"""f0 AS (SELECT {group} AS k, d, b, {D.draw('2', str(seed), 'b', 'query_id')} AS h FROM {D.each('(SELECT * FROM dl) x', D.seq('1', str(R)), 'b')}),
        fm AS (SELECT k, b, sum(d * (2 * h - 1)) AS m FROM f0 GROUP BY k, b), fo AS (SELECT {group} AS k, sum(d) AS obs FROM dl GROUP BY
        {group}),
        fp AS (SELECT fm.k, round(avg(CASE WHEN abs(fm.m) >= abs(fo.obs) - 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS p FROM fm JOIN fo ON fo.k =
        fm.k GROUP BY fm.k)"""


#: Step-up over the distinct p-values, of which there are no more than replicates.
BH = """pc AS (SELECT p, count(*) AS n FROM fp GROUP BY p), pr AS (SELECT p, sum(n) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS k, sum(n) OVER () AS m FROM pc),
        ct AS (SELECT coalesce(max(CASE WHEN p <= k * 0.05e0 / m THEN p END), -1e0) AS cut FROM pr)"""


def b5(D: Dialect) -> str:
    p = lambda x: f"""round(greatest(1e0 / nullif(count(*), 0), least(1e0, 2e0 * least(avg(CASE WHEN {x} <= 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN {x}
        >= 0 THEN 1e0 ELSE 0e0 END)))), 6) AS p"""  # noqa: E731
    return f"""WITH {videos_of(D)}, {drawn(D, 'dl', 'query_id', 9, 'rq')}, {drawn(D, 'vv', 'video_id', 9, 'rv')},
        mq AS (SELECT b, sum(w * d) / nullif(sum(w), 0) AS x FROM rq GROUP BY b),
        mv AS (SELECT b, sum(w * s) / nullif(sum(w * c), 0) AS x, sum(w * s / c) / nullif(sum(w), 0) AS y FROM rv GROUP BY b)
        SELECT 'query' AS unit, {bounds(D, 'x')}, {p('x')} FROM mq UNION ALL SELECT 'video', {bounds(D, 'x')}, {p('x')} FROM mv
        UNION ALL SELECT 'macro', {bounds(D, 'y')}, {p('y')} FROM mv"""


def b17(D: Dialect) -> str:
    return f"""WITH {deltas(D)}, {drawn(D, 'dl', 'query_id', 17)}, m AS (SELECT query_type, b, sum(w * m1) / nullif(sum(w), 0) AS x FROM rp
        GROUP BY query_type, b),
        c AS (SELECT query_type, {D.pct('x', 0.025)} AS lo FROM m GROUP BY query_type), n AS (SELECT query_type, sum(CASE WHEN m1 > 0 THEN 1
        ELSE 0 END) AS n FROM dl GROUP BY query_type)
        SELECT c.query_type, round(lo, 4) AS ci_lower, n.n AS n_pos, CASE WHEN lo < 0.6e0 THEN 'none' WHEN lo < 0.7e0 OR n.n < 50 THEN
        'weak' ELSE 'signal' END AS band,
        lo >= 0.7e0 AND n.n < 50 AS demoted FROM c JOIN n ON n.query_type = c.query_type"""


def b20(D: Dialect) -> str:
    """Gold first, then the others by hash, cut to each pool size; ranked inside the pool."""
    pools = "(" + " UNION ALL ".join(f"SELECT {p} AS pool" for p in POOLS) + ") pl"
    rank = lambda s: f"row_number() OVER (PARTITION BY pool, query_id ORDER BY {s} DESC, idx)"
    return f"""WITH {scores(D)}, zz AS (SELECT *, {zscore('ss')} AS zs, {zscore('sp')} AS zp FROM sc),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN good THEN 0 ELSE 1 END, {D.draw('1000000007', '20', 'query_id', 'idx')},
        idx) AS place FROM zz),
        c AS (SELECT pool, query_id, idx, good, round(zs, 8) AS s0, round(0.5e0 * zs + 0.5e0 * CASE WHEN mask THEN zs ELSE zp END, 8) AS s1
        FROM o JOIN {pools} ON o.place <= pl.pool),
        r AS (SELECT pool, query_id, good, {rank('s0')} AS r0, {rank('s1')} AS r1 FROM c),
        q AS (SELECT pool, query_id, coalesce(1e0 / min(CASE WHEN good THEN r1 END), 0e0) - coalesce(1e0 / min(CASE WHEN good THEN r0 END),
        0e0) AS d FROM r GROUP BY pool, query_id),
        p AS (SELECT pool, avg(d) AS d FROM q GROUP BY pool)
        SELECT pool, round(d, 6) AS delta, round(d - (SELECT max(x.d) FROM p x WHERE x.pool = {POOLS[0]}), 6) AS interaction FROM p"""


def b12(D: Dialect) -> str:
    """Changed characters over characters of the raw caption, per source; videos are drawn once for all sources."""
    return f"""WITH s AS (SELECT video_id, idx, max(caption_arm) AS arm, max(caption) AS cap, max(caption_raw) AS raw FROM {D.t('segments')}
        GROUP BY video_id, idx),
        vv AS (SELECT video_id, arm, sum(abs(length(coalesce(cap, '')) - length(raw))) AS s, sum(length(raw)) AS c FROM s WHERE raw IS NOT
        NULL AND arm IS NOT NULL GROUP BY video_id, arm),
        {drawn(D, 'vv', 'video_id', 5)}, m AS (SELECT arm, b, sum(w * s) * 1e0 / nullif(sum(w * c), 0) AS r FROM rp GROUP BY arm, b),
        o AS (SELECT b, avg(r) AS r FROM m GROUP BY b)
        SELECT m.arm, {bounds(D, 'm.r')}, {bounds(D, 'm.r - o.r', 'diff_lo', 'diff_hi')} FROM m JOIN o ON o.b = m.b GROUP BY m.arm"""


B = {
    "b1_paired_bootstrap": b1,
    "b2_alpha_search": b2,
    "b2_alpha_by_video": b2_by_video,
    "b3_query_interval": lambda D: f"""WITH {deltas(D)}, {drawn(D, 'dl', 'query_id', 3)}, m AS (SELECT b, sum(w * d) / nullif(sum(w), 0) AS x
        FROM rp GROUP BY b) SELECT {bounds(D, 'x')} FROM m""",
    "b4_cluster_bootstrap": lambda D: f"""WITH {videos_of(D)}, {drawn(D, 'vv', 'video_id', 7)},
        m AS (SELECT b, sum(w * s) / nullif(sum(w * c), 0) AS x, sum(w * s / c) / nullif(sum(w), 0) AS y FROM rp GROUP BY b)
        SELECT {bounds(D, 'x', 'w_lo', 'w_hi')}, {bounds(D, 'y', 'macro_lo', 'macro_hi')} FROM m""",
    "b5_bootstrap_p": b5,
    "b6_sign_flip": lambda D: f"WITH {deltas(D)}, {flips(D, chr(39) + 'all' + chr(39))} SELECT p FROM fp",
    "b7_benjamini_hochberg": lambda D: f"WITH {deltas(D)}, {flips(D, 'video_id')}, {BH} SELECT k AS video_id, p, p <= cut AS reject FROM fp CROSS JOIN ct",
    "b8_combined_family": lambda D: f"""WITH {deltas(D)}, {flips(D, 'query_type')}, fa AS (SELECT 'type' AS family, k, p FROM fp),
        {flips(D, 'video_id').replace('f0', 'g0').replace('fm', 'gm').replace('fo', 'go').replace('fp', 'gp')},
        al AS (SELECT * FROM fa UNION ALL SELECT 'video', k, p FROM gp), {BH.replace('FROM fp', 'FROM al')} SELECT family, k, p, p <= cut AS
        reject FROM al CROSS JOIN ct""",
    "b10_cluster_mean": lambda D: f"""WITH {seg(D)}, vv AS (SELECT video_id, sum(CASE WHEN still THEN 1e0 ELSE 0e0 END) AS s, count(*) AS c
        FROM seg WHERE still IS NOT NULL GROUP BY video_id),
        {drawn(D, 'vv', 'video_id', 10)}, m AS (SELECT b, sum(w * s) / nullif(sum(w * c), 0) AS x FROM rp GROUP BY b) SELECT {bounds(D, 'x')}
        FROM m""",
    "b11_paired_cluster": lambda D: f"""WITH {deltas(D)}, vv AS (SELECT query_type, video_id, sum(d) AS s, count(*) AS c FROM dl GROUP BY
        query_type, video_id),
        {drawn(D, 'vv', 'video_id', 12)}, m AS (SELECT query_type, b, sum(w * s) / nullif(sum(w * c), 0) AS x FROM rp GROUP BY query_type,
        b) SELECT query_type, {bounds(D, 'x')} FROM m GROUP BY query_type""",
    "b12_ratio_bootstrap": b12,
    "b13_hit_difference": lambda D: f"""WITH {deltas(D)}, {drawn(D, 'dl', 'query_id', 13)}, m AS (SELECT b, sum(w * hit10) / nullif(sum(w), 0)
        AS x FROM rp GROUP BY b) SELECT {bounds(D, 'x')} FROM m""",
    "b17_verdict": b17,
    "b18_reproduction_gate": lambda D: f"""WITH {inv(D)}, r AS (SELECT video_id, event_no, {D.at('span', 0)} AS a, {D.at('span', 1)} AS b,
        {D.low('seg_idx')} AS lo, {D.high('seg_idx')} AS hi FROM inv WHERE span IS NOT NULL AND seg_idx IS NOT NULL)
        SELECT video_id, count(*) AS n, sum(CASE WHEN a = lo AND b = hi THEN 0 ELSE 1 END) AS differing FROM r GROUP BY video_id""",
    "b19_significance_flag": lambda D: f"""WITH {deltas(D)}, {drawn(D, 'dl', 'query_id', 19)}, m AS (SELECT query_type, b, sum(w * d) /
        nullif(sum(w), 0) AS x FROM rp GROUP BY query_type, b),
        c AS (SELECT query_type, {D.pct('x', 0.025)} AS lo, {D.pct('x', 0.975)} AS hi FROM m GROUP BY query_type) SELECT query_type,
        round(lo, 4) AS lo, round(hi, 4) AS hi, lo > 0 OR hi < 0 AS significant FROM c""",
    "b20_pool_sizes": b20,
    "b21_alpha_curve": b21,
    "b22_channel_summaries": lambda D: f"""WITH {curves(D)}, {means(D, 'cv')} SELECT be.best / 10e0 AS alpha_star, round(max(mn.mrr), 6) AS
        best_mrr, round(max(CASE WHEN mn.i = 0 THEN mn.mrr END), 6) AS caption_mrr,
        round(max(CASE WHEN mn.i = 10 THEN mn.mrr END), 6) AS subtitle_mrr FROM mn CROSS JOIN be GROUP BY be.best""",
    "b23_single_sample": lambda D: f"""WITH {deltas(D)}, {drawn(D, 'dl', 'query_id', 23)}, m AS (SELECT query_type, b, sum(w * m1) /
        nullif(sum(w), 0) AS x FROM rp GROUP BY query_type, b),
        o AS (SELECT query_type, avg(m1) AS mean FROM dl GROUP BY query_type) SELECT m.query_type, round(max(o.mean), 6) AS mean, {bounds(D, 'x')}
        FROM m JOIN o ON o.query_type = m.query_type GROUP BY m.query_type""",
    "b24_three_arms": lambda D: f"""WITH {curves(D)}, vv AS (SELECT video_id, count(*) AS c, sum(a5 - a10) AS s1, sum(a0 - a10) AS s2 FROM
        cv GROUP BY video_id), {drawn(D, 'vv', 'video_id', 24)},
        m AS (SELECT b, sum(w * s1) / nullif(sum(w * c), 0) AS x, sum(w * s2) / nullif(sum(w * c), 0) AS y FROM rp GROUP BY b), o AS (SELECT
        sum(s1) / sum(c) AS dq, sum(s2) / sum(c) AS dd FROM vv)
        SELECT {bounds(D, 'x', 'fused_lo', 'fused_hi')}, {bounds(D, 'y', 'caption_lo', 'caption_hi')}, max(CASE WHEN dq >= 0 AND dd >= 0
        THEN 'both' WHEN dq >= 0 THEN 'fused' WHEN dd >= 0 THEN 'caption' ELSE 'neither' END) AS quadrant FROM m CROSS JOIN o""",
    "a55_slope": lambda D: f"""WITH {seg(D)}, vv AS (SELECT arm, video_id, sum(length(sub) * 1e0 * length(cap)) AS xy, sum(length(sub) * 1e0
        * length(sub)) AS xx FROM seg WHERE sub IS NOT NULL AND cap IS NOT NULL AND arm IS NOT NULL GROUP BY arm, video_id),
        {drawn(D, 'vv', 'video_id', 55)}, m AS (SELECT arm, b, sum(w * xy) / nullif(sum(w * xx), 0e0) AS x FROM rp GROUP BY arm, b), o AS
        (SELECT arm, sum(xy) / nullif(sum(xx), 0e0) AS slope FROM vv GROUP BY arm)
        SELECT o.arm, round(max(o.slope), 5) AS slope, round(1.96e0 * stddev_samp(m.x), 5) AS mde FROM o JOIN m ON m.arm = o.arm GROUP BY
        o.arm""",
}
QUERIES, SQL = register(B)
