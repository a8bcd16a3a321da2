"""Scoring, normalisation, fusion, ranking and retrieval metrics."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect, corrupted, index, minmax, paired, ranked, register, scores, seg, zscore


def top(D: Dialect, score: str, k: int = 10) -> str:
    return (f"""SELECT query_id, idx, round(v, 5) AS score, r AS rank FROM (SELECT query_id, idx, v, row_number() OVER (PARTITION BY query_id
        ORDER BY v DESC, idx) AS r """
            f"FROM (SELECT query_id, idx, round({score}, 8) AS v FROM src) a) b WHERE r <= {k}")


def variants(D: Dialect) -> str:
    """vc: scores of every variant of a query."""
    return f"""{scores(D)}, vq AS (SELECT g.query_id, g.video_id, g.i AS variant, v.ec AS qe, v.nc AS qn
        FROM (SELECT query_id, video_id, i FROM {D.each('q1', 'gt', 'i')}) g JOIN vn v ON v.video_id = g.video_id AND v.idx = g.i),
        vc AS (SELECT q.query_id, q.variant, v.idx, v.mask, round(coalesce({D.dot('v.es', 'q.qe')} / nullif(v.ns * q.qn, 0e0), 0e0), 9) AS ss,
        round(coalesce({D.dot('v.ec', 'q.qe')} / nullif(v.nc * q.qn, 0e0), 0e0), 9) AS sp FROM vq q JOIN vn v ON v.video_id = q.video_id)"""


B = {
    "j5_channel_scores": lambda D: f"WITH {scores(D)} SELECT query_id, idx, round(ss, 6) AS s_sub, round(sp, 6) AS s_cap FROM sc",
    "v3_minmax": lambda D: f"WITH {scores(D)} SELECT query_id, idx, round({minmax('sp')}, 5) AS v FROM sc",
    "v4_zscore": lambda D: f"WITH {scores(D)} SELECT query_id, idx, round({zscore('sp')}, 5) AS v FROM sc",
    "v5_combined": lambda D: f"WITH {ranked(D)} SELECT query_id, idx, round(score, 5) AS score FROM fu",
    "v6_fused_search": lambda D: f"WITH {ranked(D)} SELECT query_id, video_id, idx, round(score, 5) AS score, rank FROM rk WHERE rank <= 10",
    "v7_search_top3": lambda D: f"WITH {ranked(D)} SELECT query_id, idx, rank FROM rk WHERE rank <= 3",
    # Variants of a query: the caption vectors of all its true segments. V9 pools raw cosines before the normalisation, V10 fused scores.
    "v9_max_pool_variants": lambda D: f"WITH {variants(D)} SELECT query_id, idx, round(max(sp), 6) AS pooled FROM vc GROUP BY query_id, idx",
    "v10_score_pool": lambda D: f"""WITH {variants(D)}, vz AS (SELECT query_id, idx, {zscore('ss', 'query_id, variant')} AS zs,
        {zscore('sp', 'query_id, variant')} AS zp, mask FROM vc)
        SELECT query_id, idx, round(max(0.5e0 * zs + 0.5e0 * CASE WHEN mask THEN zs ELSE zp END), 5) AS pooled FROM vz GROUP BY query_id,
        idx""",
    "v11_channel_stats": lambda D: f"""WITH {scores(D)} SELECT query_id, round(max(ss), 6) AS sub_max, round(avg(ss), 6) AS sub_mean,
        round(max(sp), 6) AS cap_max, """
                                   "round(avg(sp), 6) AS cap_mean, stddev_pop(ss) < 1e-9 AS sub_flat, stddev_pop(sp) < 1e-9 AS cap_flat FROM sc GROUP BY query_id",
    "v12_rrf": lambda D: f"WITH {scores(D)}, a AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY ss DESC, idx) AS r1, "
                         "row_number() OVER (PARTITION BY query_id ORDER BY sp DESC, idx) AS r2 FROM sc), src AS (SELECT * FROM a) " + top(D, "1e0 / (60 + r1) + 1e0 / (60 + r2)"),
    "v13_raw_sum": lambda D: f"WITH {scores(D)}, src AS (SELECT * FROM sc) " + top(D, "0.4e0 * ss + 0.6e0 * sp"),
    "v13_minmax_fusion": lambda D: f"WITH {scores(D)}, src AS (SELECT query_id, idx, {minmax('ss')} AS a, {minmax('sp')} AS b FROM sc) " + top(D, "0.5e0 * a + 0.5e0 * b"),
    "v14_row_alpha": lambda D: f"""WITH {ranked(D)}, {seg(D)}, ct AS (SELECT video_id, idx, coalesce(trim(sub), '') = '' AS empty,
        {corrupted(D, 'cap')} AS corr FROM seg),
        al AS (SELECT video_id, idx, CASE WHEN empty AND NOT corr THEN 0e0 WHEN corr AND NOT empty THEN 1e0 ELSE 0.5e0 END AS alpha FROM
        ct),
        src AS (SELECT z.query_id, z.idx, alpha * zs + (1e0 - alpha) * zp AS v0 FROM zz z JOIN al ON al.video_id = z.video_id AND al.idx =
        z.idx) """ + top(D, "v0"),
    "v15_smooth_box": lambda D: f"""WITH {ranked(D)} SELECT query_id, idx, round(score + 0.25e0 * (coalesce(lag(score) OVER w, score) +
        coalesce(lead(score) OVER w, score)), 5) AS score """
                                "FROM fu WINDOW w AS (PARTITION BY query_id ORDER BY idx)",
    "v16_smooth_gauss": lambda D: f"WITH {ranked(D)}, e AS (SELECT query_id, idx, score, first_value(score) OVER (PARTITION BY query_id ORDER BY idx) AS lo, "
                                  "last_value(score) OVER (PARTITION BY query_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi FROM fu) SELECT query_id, idx, round((score + "
                                  + " + ".join(f"""exp(-{k * k / 2.0}e0) * (coalesce(lag(score, {k}) OVER w, lo) + coalesce(lead(score, {k})
        OVER w, hi))""" for k in range(1, 5))
                                  + ") / (1e0 + " + " + ".join(f"2e0 * exp(-{k * k / 2.0}e0)" for k in range(1, 5)) + "), 5) AS score FROM e WINDOW w AS (PARTITION BY query_id ORDER BY idx)",
    # The mean over all pairs follows from the length of the summed unit vectors; no pairs are made.
    "v18_segment_similarity": lambda D: f"""WITH {index(D)},
        u AS (SELECT video_id, idx, vec_id, {D.map_('ec', 'x -> x / nc')} AS e FROM vn WHERE nc > 0),
        n AS (SELECT video_id, e, lag(e) OVER (PARTITION BY video_id ORDER BY idx, vec_id) AS before FROM u),
        ad AS (SELECT video_id, count(*) AS n, avg({D.dot('e', 'before')}) AS adjacent FROM n GROUP BY video_id),
        su AS (SELECT video_id, sum(s * s) AS sq FROM (SELECT video_id, d, sum(CAST({D.at('e', 'd')} AS DOUBLE)) AS s
               FROM {D.each('u', D.seq('0', '63'), 'd')} GROUP BY video_id, d) x GROUP BY video_id)
        SELECT ad.video_id, ad.n, round(adjacent, 5) AS adjacent, round((sq - ad.n) / (ad.n * (ad.n - 1e0)), 5) AS pairs,
        round(adjacent - (sq - ad.n) / (ad.n * (ad.n - 1e0)), 5) AS gap FROM ad JOIN su ON su.video_id = ad.video_id WHERE ad.n > 1""",
    "v19_query_features": lambda D: f"""WITH {ranked(D)}, t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS t1, max(CASE WHEN
        rank = 2 THEN score END) AS t2, """
                                    "max(CASE WHEN rank = 5 THEN score END) AS t5, max(ss) AS ms, max(sp) AS mp FROM rk GROUP BY query_id) "
                                    "SELECT query_id, round(t1, 5) AS top1, round(t1 - t2, 5) AS gap12, round(t1 - t5, 5) AS gap15, round(ms - mp, 6) AS channel_gap FROM t",
    "v20_margin": lambda D: f"""WITH {ranked(D)} SELECT query_id, round(max(CASE WHEN good THEN score END) - max(CASE WHEN NOT good THEN score
        END), 5) AS margin FROM fu GROUP BY query_id""",
    "v22_percentile": lambda D: f"WITH {ranked(D)}, g AS (SELECT query_id, max(CASE WHEN good THEN sp END) AS own FROM fu GROUP BY query_id) "
                                "SELECT f.query_id, round(avg(CASE WHEN f.sp < g.own THEN 1e0 ELSE 0e0 END), 6) AS pct FROM fu f JOIN g ON f.query_id = g.query_id WHERE g.own IS NOT NULL GROUP BY f.query_id",
    "v23_identical_vectors": lambda D: f"""WITH {index(D)}, g AS (SELECT video_id, ec, count(*) AS n FROM vi GROUP BY video_id, ec) SELECT
        video_id, max(n) AS largest, count(*) AS blocks FROM g GROUP BY video_id""",
    "v24_epsilon_cosine": lambda D: f"""WITH {index(D)} SELECT a.vec_id, round({D.dot('a.ec', 'a.es')} / ((a.nc + 1e-9) * (a.ns + 1e-9)), 6)
        AS cosine FROM vn a WHERE a.es IS NOT NULL""",
    "r2_topk_slice": lambda D: f"WITH {ranked(D)} SELECT query_id, rank, idx FROM rk WHERE rank <= 5",
    "r3_first_rank": lambda D: f"WITH {ranked(D)} SELECT query_id, coalesce(min(CASE WHEN good THEN rank END), 0) AS rank FROM rk GROUP BY query_id",
    "r4_restricted_rr": lambda D: f"""WITH {ranked(D)}, c AS (SELECT query_id, idx, good, row_number() OVER (PARTITION BY query_id ORDER BY
        rank) AS r FROM rk WHERE good OR {D.draw('4', 'query_id', 'idx')} = 0) """
                                  "SELECT query_id, round(coalesce(1e0 / min(CASE WHEN good THEN r END), 0e0), 6) AS rr FROM c GROUP BY query_id",
    "r5_tie_block": lambda D: f"""WITH {ranked(D)}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM fu) SELECT query_id,
        sum(CASE WHEN abs(score - best) < 1e-9 THEN 1 ELSE 0 END) AS ties FROM t GROUP BY query_id""",
    "r7_rows_above_truth": lambda D: f"""WITH {ranked(D)}, g AS (SELECT query_id, min(rank) AS gr FROM rk WHERE good GROUP BY query_id) SELECT
        r.query_id, r.idx, r.rank FROM rk r JOIN g ON r.query_id = g.query_id WHERE r.rank < g.gr AND r.rank <= 3""",
    "r9_smallest_per_group": lambda D: f"""SELECT embed_model, min_by(vec_id, idx * CAST(1000000000 AS BIGINT) + vec_id) AS vec_id FROM
        (SELECT DISTINCT vec_id, idx, embed_model FROM {D.t('videoindex')}) a GROUP BY embed_model""",
    "a1_hit_at_k": lambda D: f"WITH {ranked(D)} SELECT query_id, " + ", ".join(f"""max(CASE WHEN good AND rank <= {k} THEN 1e0 ELSE 0e0 END)
        AS hit_{k}""" for k in (1, 5, 10)) + " FROM rk GROUP BY query_id",
    "a2_mrr": lambda D: f"WITH {ranked(D)} SELECT query_id, round(coalesce(1e0 / min(CASE WHEN good THEN rank END), 0e0), 6) AS rr FROM rk GROUP BY query_id",
    "a4_iou_recall": lambda D: f"""WITH {ranked(D)}, t AS (SELECT DISTINCT r.query_id, r.idx, greatest(0e0, least(q.gt_end, r.idx * 5e0 + 5e0)
        - greatest(q.gt_start, r.idx * 5e0)) AS inter, """
                               "greatest(q.gt_end, r.idx * 5e0 + 5e0) - least(q.gt_start, r.idx * 5e0) AS hull FROM rk r JOIN qry q ON q.query_id = r.query_id WHERE r.rank <= 5) "
                               "SELECT query_id, max(CASE WHEN hull > 0 AND inter / hull >= 0.3e0 THEN 1 ELSE 0 END) AS hit_03, max(CASE WHEN hull > 0 AND inter / hull >= 0.5e0 THEN 1 ELSE 0 END) AS hit_05 FROM t GROUP BY query_id",
    "a8_contested": lambda D: f"""WITH {paired(D)} SELECT CASE WHEN k0 = 1 AND k1 = 1 THEN 'saturated' ELSE 'contested' END AS part, count(*)
        AS n, round(avg(m0), 6) AS base, round(avg(m1), 6) AS fused FROM rr GROUP BY 1""",
    "a27_delta_distribution": lambda D: f"""WITH {paired(D)}, d AS (SELECT m1 - m0 AS d FROM rr) SELECT count(*) AS n, round(avg(d), 6) AS
        mean, round(""" + D.pct("d", 0.5) + ", 6) AS median, round(min(d), 6) AS lo, round(max(d), 6) AS hi, "
                                        "sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS losses, round(sum(CASE WHEN d > 0 THEN d ELSE 0e0 END), 5) AS gained FROM d",
    "a29_delta_by_type": lambda D: f"WITH {paired(D)} SELECT query_type, count(*) AS n, round(avg(m1 - m0), 6) AS delta FROM rr GROUP BY query_type",
    "a30_transfer_buckets": lambda D: f"""WITH {paired(D)}, b AS (SELECT CASE WHEN k0 = 0 THEN n + 1 ELSE k0 END AS a, CASE WHEN k1 = 0 THEN n
        + 1 ELSE k1 END AS b, m1 - m0 AS d FROM rr) """
                                      "SELECT CASE WHEN a > 10 THEN 'low' WHEN a > 1 THEN 'mid' ELSE 'top' END AS before, CASE WHEN b < a THEN 'up' WHEN b > a THEN 'down' ELSE 'same' END AS move, count(*) AS n, round(avg(d), 6) AS delta FROM b GROUP BY 1, 2",
    "f5_abstention": lambda D: f"""WITH {scores(D)} SELECT query_id, greatest(max(ss), max(sp)) < 0.55e0 AS abstain, max(ss) < 0.55e0 AS
        abstain_subtitle FROM sc GROUP BY query_id""",
    "proj_p5_top_windows": lambda D: f"""WITH {ranked(D)} SELECT query_id, {D.join(chr(39).join(['concat(CAST(idx * 5 AS STRING), ', '-', ', CAST(idx * 5 + 5 AS STRING))']), ' ', 'rank')}
        AS windows FROM rk WHERE rank <= 3 GROUP BY query_id""",
    "proj_p20_ribbon": lambda D: f"WITH {ranked(D)} SELECT query_id, idx, round(power({minmax('score')}, 2.2e0), 5) AS heat FROM fu",
    "proj_p23_quadrant": lambda D: f"""WITH {paired(D)} SELECT video_id, CASE WHEN avg(m1 - m0) >= 0 AND avg(k1 - k0) >= 0 THEN 'both' WHEN
        avg(m1 - m0) >= 0 THEN 'rr' WHEN avg(k1 - k0) >= 0 THEN 'rank' ELSE 'none' END AS quadrant FROM rr GROUP BY video_id""",
    "a56_query_independence": lambda D: f"""WITH {ranked(D)}, t AS (SELECT video_id, query_type, idx, count(*) AS n FROM rk WHERE rank = 1
        GROUP BY video_id, query_type, idx) SELECT video_id, query_type, count(*) AS distinct_top, round(max(n) * 1e0 / sum(n), 6) AS
        modal_share FROM t GROUP BY video_id, query_type""",
    "a28_leave_one_out": lambda D: f"""WITH {paired(D)}, v AS (SELECT video_id, sum(m1 - m0) AS s, count(*) AS n FROM rr GROUP BY video_id),
        t AS (SELECT sum(s) AS st, sum(n) AS nt FROM v)
        SELECT video_id, round(s / n, 6) AS own, round((st - s) / nullif(nt - n, 0), 6) AS without, coalesce(round(st, 9) * round(st - s, 9)
        < 0, false) AS flips FROM v CROSS JOIN t""",
    "a6_evaluate": lambda D: f"""WITH {paired(D)} SELECT coalesce(query_type, '*') AS query_type, count(*) AS n, round(avg(m0), 4) AS
        mrr_base, round(avg(m1), 4) AS mrr_fused, """
                             + ", ".join(f"round(avg(CASE WHEN k{a} BETWEEN 1 AND {k} THEN 1e0 ELSE 0e0 END), 4) AS hit{k}_{n}" for k in (1, 5, 10) for a, n in ((0, 'base'), (1, 'fused'))) + " FROM rr GROUP BY GROUPING SETS ((query_type), ())",
    # A rank that doesn't exist is infinite; a median that is infinite comes out as null.
    "a7_median_rank": lambda D: f"WITH {paired(D)}, m AS (SELECT " + ", ".join(D.pct(f"""CASE WHEN k{a} = 0 THEN 1e12 ELSE CAST(k{a} AS
        DOUBLE) END""", 0.5) + f"""
        AS r{a}""" for a in (0, 1)) + " FROM rr) SELECT "
                                + ", ".join(f"CASE WHEN r{a} < 1e11 THEN r{a} END AS {n}" for a, n in ((0, 'base'), (1, 'fused'))) + " FROM m",
    "a31_icc": lambda D: f"""WITH {paired(D)}, g AS (SELECT video_id, count(*) AS n, avg(m1 - m0) AS m, var_samp(m1 - m0) * (count(*) - 1)
        AS ss FROM rr GROUP BY video_id HAVING count(*) > 1),
        t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS gm, sum(ss) AS ssw, (sum(n) - sum(n * n * 1e0) / sum(n)) /
        (count(*) - 1) AS n0 FROM g),
        b AS (SELECT t.k, t.nn, t.n0, t.ssw / nullif(t.nn - t.k, 0) AS msw, (SELECT sum(g.n * g.m * g.m) FROM g) - t.nn * t.gm * t.gm AS ssb
        FROM t),
        i AS (SELECT k, nn, (ssb / (k - 1) - msw) / (ssb / (k - 1) + (n0 - 1) * msw) AS icc FROM b) SELECT k, round(icc, 5) AS icc, round(1
        + (nn * 1e0 / k - 1) * icc, 5) AS design_effect FROM i""",
    "a32_strata": lambda D: f"""WITH {paired(D)}, s AS (SELECT CASE WHEN k0 = 0 THEN 'none' WHEN k0 = 1 THEN 'rank1' WHEN k0 <= 5 THEN
        'rank2_5' ELSE 'rank6' END AS stratum, NOT (k0 = 1 AND k1 = 1) AS contested, m0, m1 FROM rr)
        SELECT stratum, contested, count(*) AS n, round(avg(m1 - m0), 6) AS delta, round(sum(m1 - m0) / nullif(sum(1e0 - m0), 0e0), 5) AS
        transfer FROM s GROUP BY GROUPING SETS ((stratum), (contested), ())""",
    "a33_macro_weighted": lambda D: f"""WITH {paired(D)}, v AS (SELECT video_id, {"substring_index(video_id, '_', 1)" if D.spark else "split_part(video_id, '_', 1)"}
        AS domain, CASE WHEN count(*) < 3 THEN 'few' ELSE 'many' END AS band, avg(m1 - m0) AS m, sum(m1 - m0) AS s, count(*) AS n FROM rr
        GROUP BY video_id)
        SELECT domain, band, count(*) AS videos, round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS weighted FROM v GROUP BY GROUPING
        SETS ((domain), (band))""",
}
QUERIES, SQL = register(B)
