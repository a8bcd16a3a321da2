"""Resampling, agreement, apportionment, sampling and set operations; randomness is hashing, so both engines draw alike."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect, hashed, present, qry, register, rep, seg

def raters(D: Dialect) -> str:
    return (f"""{seg(D)}, rt AS (SELECT video_id, idx, arm, CASE WHEN length(coalesce(cap, '')) < 30 THEN 'short' WHEN length(cap) < 60 THEN
        'mid' ELSE 'long' END AS a, """
            "CASE WHEN length(coalesce(cap, '')) < 28 THEN 'short' WHEN length(cap) < 66 THEN 'mid' ELSE 'long' END AS b FROM seg)")


B = {
    "b9_wilson": lambda D: f"""WITH {seg(D)}, g AS (SELECT arm, sum(CASE WHEN still THEN 1e0 ELSE 0e0 END) AS k, count(*) * 1e0 AS n FROM seg
        GROUP BY arm) SELECT arm, round(greatest(0e0, (k / n + 1.9208e0 / n - 1.96e0 * sqrt((k / n) * (1 - k / n) / n + 0.9604e0 / (n * n)))
        / (1 + 3.8416e0 / n)), 6) AS lo, round(least(1e0, (k / n + 1.9208e0 / n + 1.96e0 * sqrt((k / n) * (1 - k / n) / n + 0.9604e0 / (n *
        n))) / (1 + 3.8416e0 / n)), 6) AS hi FROM g""",
    "a19_cohens_kappa": lambda D: f"""WITH {raters(D)}, n AS (SELECT count(*) * 1e0 AS n, sum(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) AS same
        FROM rt), ca AS (SELECT a AS c, count(*) AS n FROM rt GROUP BY a), cb AS (SELECT b AS c, count(*) AS n FROM rt GROUP BY b), e AS
        (SELECT sum(ca.n * 1e0 * cb.n) AS x FROM ca JOIN cb ON ca.c = cb.c) SELECT round((same / n - x / (n * n)) / nullif(1 - x / (n * n),
        0), 6) AS kappa FROM n JOIN e ON true""",
    "a20_confusion": lambda D: f"WITH {raters(D)} SELECT a, " + ", ".join(f"sum(CASE WHEN b = '{c}' THEN 1 ELSE 0 END) AS b_{c}" for c in ("short", "mid", "long")) + " FROM rt GROUP BY a",
    "a21_purity": lambda D: f"""WITH {raters(D)}, c AS (SELECT video_id, arm, count(*) AS n FROM rt GROUP BY video_id, arm), g AS (SELECT
        video_id, max(n) AS top, sum(n) AS n FROM c GROUP BY video_id HAVING sum(n) >= 2) SELECT round(sum(top) * 1e0 / sum(n), 6) AS purity
        FROM g""",
    "a48_shares_by_family": lambda D: f"""WITH f AS (SELECT {'substring_index(video_id, ' + chr(39) + '_' + chr(39) + ', 1)' if D.spark else 'split_part(video_id, ' + chr(39) + '_' + chr(39) + ', 1)'}
        AS family, count(DISTINCT video_id) AS n FROM {D.t('videos')} GROUP BY 1) SELECT family, n, round(n * 1e0 / sum(n) OVER (), 6) AS
        share FROM f""",
    "a51_parity": lambda D: f"""SELECT video_id, CASE WHEN count(DISTINCT channel_id) > 1 THEN 'mismatch' WHEN count(channel_id) = 0 THEN
        'unknown' WHEN count(channel_id) < count(*) THEN 'partially_recorded' ELSE 'match' END AS parity FROM {D.t('videos')} GROUP BY
        video_id""",
    "n1_hamilton": lambda D: f"""WITH s AS (SELECT n_name AS k, count(*) AS supply FROM {D.t('customer')} JOIN {D.t('nation')} ON c_nationkey
        = n_nationkey GROUP BY n_name), q AS (SELECT k, supply, 100e0 * supply / sum(supply) OVER () AS exact FROM s), """
                             "r AS (SELECT k, supply, floor(exact) AS base, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, k) AS pos, 100 - sum(floor(exact)) OVER () AS rest FROM q) SELECT k, CAST(least(supply, base + CASE WHEN pos <= rest THEN 1 ELSE 0 END) AS BIGINT) AS seats FROM r",
    "n3_cap": lambda D: f"""SELECT n_name, CAST(floor(0.3e0 / 0.7e0 * count(*) + 1e-9) AS BIGINT) AS cap FROM {D.t('supplier')} JOIN
        {D.t('nation')} ON s_nationkey = n_nationkey GROUP BY n_name""",
    "n10_candidate_pool": lambda D: f"""WITH {qry(D)}, {seg(D)}, g AS (SELECT DISTINCT query_id, video_id, gt FROM qry WHERE gt IS NOT NULL),
        c AS (SELECT g.query_id, s.idx, {D.has('g.gt', 's.idx')} AS gold, {D.sha('concat(g.query_id, ' + chr(39) + '|' + chr(39) + ', CAST(s.idx AS STRING))')}
        AS h FROM g JOIN seg s ON s.video_id = g.video_id), """
                                    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN gold THEN 0 ELSE 1 END, h) AS r FROM c) SELECT query_id, idx FROM r WHERE r <= 12",
    "n14_spot_check": lambda D: f"""WITH {rep(D)} SELECT report_id, sent_id FROM rep ORDER BY {D.draw('1000000007', '17', 'report_id', 'sent_id')},
        report_id, sent_id LIMIT 30""",
    "n20_census_cells": lambda D: f"WITH {raters(D)} SELECT arm, a, count(*) <= 50 AS census FROM rt GROUP BY arm, a",
    "u1_split_leak": lambda D: f"""WITH {qry(D)} SELECT video_id FROM qry WHERE split = 'dev' AND video_id IS NOT NULL INTERSECT SELECT
        video_id FROM qry WHERE split = 'test'""",
    "u2_except": lambda D: f"""WITH {qry(D)}, a AS (SELECT video_id, i FROM {D.each('qry', 'gt', 'i')}) SELECT video_id, i AS idx FROM a WHERE
        video_id IS NOT NULL EXCEPT SELECT video_id, idx FROM {D.t('segments')}""",
    "u3_symmetric_difference": lambda D: f"""WITH a AS (SELECT DISTINCT video_id FROM {D.t('segments')}), b AS (SELECT DISTINCT video_id FROM
        {D.t('report')}) SELECT coalesce(a.video_id, b.video_id) AS video_id, a.video_id IS NULL AS only_report FROM a FULL OUTER JOIN b ON
        a.video_id = b.video_id WHERE a.video_id IS NULL OR b.video_id IS NULL""",
    "u5_common_arms": lambda D: f"""WITH {seg(D)}, n AS (SELECT count(DISTINCT video_id) AS n FROM seg), c AS (SELECT arm, count(DISTINCT
        video_id) AS v FROM seg GROUP BY arm) SELECT arm, v, v = n AS everywhere FROM c JOIN n ON true""",
    "s2_segment_contract": lambda D: f"""WITH {seg(D)}, v AS (SELECT video_id, max(n_segments) AS n FROM {D.t('videos')} GROUP BY video_id), g
        AS (SELECT video_id, count(*) AS c, min(idx) AS lo, max(idx) AS hi, sum(CASE WHEN s <> idx * 5 THEN 1 ELSE 0 END) AS off, sum(CASE
        WHEN cap IS NULL THEN 1 ELSE 0 END) AS missing FROM seg GROUP BY video_id) SELECT g.video_id, lo = 0 AND hi = c - 1 AS contiguous,
        off = 0 AS on_grid, missing, c = v.n AS counted FROM g LEFT JOIN v ON v.video_id = g.video_id""",
    "s3_query_contract": lambda D: f"""WITH {qry(D)} SELECT video_id, count(DISTINCT split) > 1 AS leak, sum(CASE WHEN gt IS NULL OR
        {D.size('gt')} = 0 THEN 1 ELSE 0 END) AS no_truth, sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS no_text FROM
        qry WHERE video_id IS NOT NULL GROUP BY video_id""",
    "s5_index_gates": lambda D: f"""WITH v AS (SELECT DISTINCT vec_id, video_id, embed_model, {D.size('emb_cap')} AS dim FROM
        {D.t('videoindex')}), s AS (SELECT video_id, count(DISTINCT idx) AS n FROM {D.t('segments')} GROUP BY video_id) SELECT v.video_id,
        count(DISTINCT v.embed_model) = 1 AS one_model, sum(CASE WHEN dim = 64 THEN 0 ELSE 1 END) AS bad_dim, count(*) = max(s.n) AS
        complete FROM v LEFT JOIN s ON s.video_id = v.video_id GROUP BY v.video_id""",
    "v2_norm_check": lambda D: f"""WITH v AS (SELECT DISTINCT vec_id, emb_cap FROM {D.t('videoindex')} WHERE {D.size('emb_cap')} = 64) SELECT
        abs(sqrt({D.dot('emb_cap', 'emb_cap')}) - 1e0) < 1e-4 AS unit, count(*) AS n FROM v GROUP BY 1""",
    "s7_caption_lengths": lambda D: f"""WITH {seg(D)}, a AS (SELECT arm, video_id, count(*) AS n FROM seg GROUP BY arm, video_id), m AS
        (SELECT video_id, count(DISTINCT idx) AS n FROM seg GROUP BY video_id) SELECT a.arm, sum(CASE WHEN a.n = m.n THEN 1 ELSE 0 END) AS
        whole, sum(CASE WHEN a.n <> m.n THEN 1 ELSE 0 END) AS part FROM a JOIN m ON a.video_id = m.video_id GROUP BY a.arm""",
    "s14_first_seen_order": lambda D: f"""SELECT video_id, min(query_id) AS first_query FROM {D.t('queries_dev_only')} WHERE
        lower(trim(split)) = 'dev' AND video_id IS NOT NULL GROUP BY video_id""",
    "f24_exclude_used": lambda D: f"""WITH {qry(D)}, {seg(D)}, u AS (SELECT DISTINCT video_id, i FROM {D.each('qry', 'gt', 'i')}) SELECT
        s.video_id, count(*) AS n, sum(CASE WHEN u.i IS NULL THEN 1 ELSE 0 END) AS kept FROM seg s LEFT JOIN u ON u.video_id = s.video_id
        AND u.i = s.idx GROUP BY s.video_id""",
    "f31_arm_shapes": lambda D: f"""WITH {seg(D)}, a AS (SELECT video_id, arm, count(*) AS n FROM seg GROUP BY video_id, arm) SELECT video_id,
        count(DISTINCT n) = 1 AS even FROM a GROUP BY video_id""",
    "j14_audit": lambda D: f"""WITH v AS (SELECT video_id, max(n_segments) AS n FROM {D.t('videos')} GROUP BY video_id), s AS (SELECT
        video_id, count(DISTINCT idx) AS c FROM {D.t('segments')} GROUP BY video_id), x AS (SELECT video_id, count(DISTINCT vec_id) AS c
        FROM {D.t('videoindex')} GROUP BY video_id) SELECT v.video_id, CASE WHEN s.c IS NULL THEN 'not_segmented' WHEN x.c IS NULL THEN
        'not_indexed' WHEN s.c <> v.n THEN 'count_differs' ELSE 'ok' END AS status FROM v LEFT JOIN s ON s.video_id = v.video_id LEFT JOIN x
        ON x.video_id = v.video_id""",
    "n4_stratified_pick": lambda D: f"""WITH {seg(D)}, {hashed(D, 'seg', 'arm', '13', 'video_id', 'idx')} SELECT video_id, idx, arm FROM hk
        WHERE rn <= ceil(n * 0.1e0)""",
    "n5_deal": lambda D: f"""WITH v AS (SELECT DISTINCT video_id FROM {D.t('videos')}), {hashed(D, 'v', '1', '21', 'video_id')} SELECT
        video_id, CAST(ceil(rn / 6e0) AS BIGINT) AS hand FROM hk""",
    # No turn beyond the quota can be picked, so every ranking is cut at it before it is shuffled on.
    "n8_round_robin": lambda D: f"""WITH {raters(D)}, t AS (SELECT video_id, idx, arm, a, row_number() OVER (PARTITION BY a, arm ORDER BY
        {D.draw('1000000007', '5', 'video_id', 'idx')}, video_id, idx) AS turn FROM rt),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY turn, arm) AS pos FROM t WHERE turn <= 30) SELECT a, arm, video_id, idx,
        pos FROM p WHERE pos <= 30""",
    "n9_simple_sample": lambda D: f"""WITH {raters(D)}, t AS (SELECT video_id, idx, a, row_number() OVER (PARTITION BY a ORDER BY
        {D.draw('1000000007', '9', 'video_id', 'idx')}, video_id, idx) AS r FROM rt)
        SELECT a, video_id, idx FROM t WHERE r <= 50""",
    "n12_half_split": lambda D: f"""WITH v AS (SELECT DISTINCT video_id FROM {D.t('videos')}), {hashed(D, 'v', '1', '2', 'video_id')} SELECT
        video_id, rn <= n / 2e0 AS first_half FROM hk""",
    "proj_p21_blind_ids": lambda D: f"""WITH f AS (SELECT rep_frame FROM {D.t('segments')} WHERE rep_frame IS NOT NULL GROUP BY rep_frame),
        {hashed(D, 'f', '1', '42', 'rep_frame')},
        k AS (SELECT rep_frame, concat('V', lpad(CAST(rn AS STRING), CAST(greatest(3, length(CAST(rn AS STRING))) AS INT), '0')) AS blind
        FROM hk)
        SELECT DISTINCT s.video_id, s.idx, k.blind FROM {D.t('segments')} s JOIN k ON k.rep_frame = s.rep_frame""",
    "u6_duplicate_sources": lambda D: f"""SELECT source_id, count(DISTINCT video_id) AS n, {D.join('video_id', ',', 'video_id')} AS videos
        FROM (SELECT DISTINCT trim(source_id) AS source_id, video_id FROM {D.t('videos')} WHERE {present(D, 'source_id')}) a GROUP BY
        source_id HAVING count(*) > 1""",
    "c1_resolve_provenance": lambda D: f"""WITH v AS (SELECT DISTINCT video_id, trim(source_id) AS source_id, {present(D, 'source_id')} AS
        known, trim(file_sha256) AS sha FROM {D.t('videos')}),
        d AS (SELECT source_id FROM v WHERE known GROUP BY source_id HAVING count(DISTINCT video_id) > 1)
        SELECT DISTINCT v.video_id, CASE WHEN v.sha IS NULL OR NOT {D.rx('v.sha', '^[0-9a-f]{64}$')} THEN 'missing_hash' WHEN NOT known THEN
        'missing_source' WHEN d.source_id IS NOT NULL THEN 'duplicate_source' ELSE 'ok' END AS status
        FROM v LEFT JOIN d ON d.source_id = v.source_id""",
    "a52_divergence": lambda D: f"""WITH s AS (SELECT DISTINCT video_id, idx, caption_arm AS arm, caption, caption_raw FROM
        {D.t('segments')})
        SELECT arm, count(*) AS n, round(avg(CASE WHEN caption = caption_raw THEN 1e0 ELSE 0e0 END), 6) AS same FROM s WHERE caption IS NOT
        NULL AND caption_raw IS NOT NULL GROUP BY arm""",
    "a37_weighted_rate": lambda D: f"""WITH {raters(D)},
        c AS (SELECT arm, a, count(*) AS pop, avg(CASE WHEN a <> b THEN 1e0 ELSE 0e0 END) AS every,
        avg(CASE WHEN {D.draw('3', 'video_id', 'idx')} = 0 THEN CASE WHEN a <> b THEN 1e0 ELSE 0e0 END END) AS rate FROM rt GROUP BY arm, a)
        SELECT arm, round(sum(pop * every) / sum(pop), 6) AS census, round(sum(pop * rate) / nullif(sum(CASE WHEN rate IS NOT NULL THEN pop END), 0), 6) AS rate FROM c GROUP BY arm""",
}
QUERIES, SQL = register(B)
