"""Further scoring and statistics variants."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect, paired, present, qry, register, scores, seg, zscore

# Synonym pairs for query expansion.
SYNONYMS = (("장면", "모습"), ("요리사", "주방장"), ("교사", "선생님"))


def expanded(D: Dialect) -> str:
    return f"{qry(D)}, ex AS (" + " UNION ".join(
        ["SELECT query_id, text FROM qry WHERE text IS NOT NULL"] + [f"""SELECT query_id, replace(text, '{a}', '{b}') AS text FROM qry WHERE
        text LIKE '%{a}%'""" for a, b in SYNONYMS]) + ")"


def noisy(D: Dialect) -> str:
    """One character of sub at place p: dropped in 5 of 100 cases, replaced in 10."""
    at = "p" if D.spark else "CAST(p AS INT)"
    d = D.draw("100", "3", "video_id", "idx", "p")
    return f"CASE WHEN {d} < 5 THEN '' WHEN {d} < 15 THEN '*' ELSE substring(sub, {at}, 1) END"


B = {
    "v8_expand_query": lambda D: f"WITH {expanded(D)} SELECT query_id, text FROM ex",
    "v17_joint_text": lambda D: f"WITH {seg(D)} SELECT video_id, idx, concat('자막: ', coalesce(sub, ''), ' 장면: ', coalesce(cap, '')) AS joint FROM seg",
    "a61_effect_decomposition": lambda D: f"""WITH {paired(D)} SELECT sum(CASE WHEN m1 > m0 THEN 1 ELSE 0 END) AS win, sum(CASE WHEN m1 = m0
        THEN 1 ELSE 0 END) AS tie, sum(CASE WHEN m1 < m0 THEN 1 ELSE 0 END) AS loss, round(avg(m1) - avg(m0), 6) AS effect FROM rr""",
    "a62_rows_at_three_alphas": lambda D: f"""WITH {scores(D)}, zz AS (SELECT *, {zscore('ss')} AS zs, {zscore('sp')} AS zp FROM sc), g AS
        (SELECT k / 2e0 AS alpha, zz.* FROM {D.each('zz', D.seq('0', '2'), 'k')}), """
                                          "s AS (SELECT alpha, query_id, good, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(alpha * zs + (1e0 - alpha) * CASE WHEN mask THEN zs ELSE zp END, 8) DESC, idx) AS r FROM g) SELECT alpha, query_id, coalesce(min(CASE WHEN good THEN r END), 0) AS rank FROM s GROUP BY alpha, query_id",
    "a60_external_subset": lambda D: f"""WITH {qry(D)} SELECT query_type, count(*) AS n, sum(CASE WHEN {D.size('gt')} <= 3 THEN 1 ELSE 0 END)
        AS discriminative FROM qry WHERE gt IS NOT NULL GROUP BY query_type""",
    "n13_balanced_positions": lambda D: f"""WITH {seg(D)} SELECT video_id, idx, arm, row_number() OVER (PARTITION BY arm, video_id ORDER BY
        {D.draw('1000000007', '31', 'idx', 'video_id')}, idx) % 2 AS position FROM seg""",
    "c8_index_facts": lambda D: f"""WITH {seg(D)} SELECT arm, count(*) AS n, count(DISTINCT video_id) AS videos, sum(CASE WHEN
        coalesce(trim(cap), '') = '' THEN 1 ELSE 0 END) AS blank FROM seg GROUP BY arm""",
    "n16_inject_noise": lambda D: f"""WITH {seg(D)} SELECT video_id, idx, {D.text(D.map_(D.seq('1', 'length(sub)'), "p -> " + noisy(D)))} AS
        noisy FROM seg WHERE sub <> ''""",
    "c2_propagate": lambda D: f"""WITH v AS (SELECT video_id, loaded_at, CASE WHEN {present(D, 'source_id')} THEN trim(source_id) END AS
        src, CASE WHEN {present(D, 'file_sha256')} THEN trim(file_sha256) END AS sha FROM {D.t('videos')}),
        k AS (SELECT video_id, min_by(src, loaded_at) AS src, min_by(sha, loaded_at) AS sha, count(DISTINCT src) > 1 OR count(DISTINCT sha)
        > 1 AS conflict FROM v WHERE video_id IS NOT NULL GROUP BY video_id)
        SELECT DISTINCT r.report_id, k.video_id, CASE WHEN conflict THEN NULL ELSE src END AS source_id, CASE WHEN conflict THEN NULL ELSE
        sha END AS file_sha256, conflict FROM {D.t('report')} r JOIN k ON k.video_id = r.video_id""",
}
QUERIES, SQL = register(B)
