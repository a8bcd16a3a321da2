import random

from tidemark.operators import periods as P

SCHEMA = "video_id string, start_sec double, end_sec double, e int, at string"


def brute(rows):
    by = {}
    for v, s, t, *_ in rows:
        if v is None or s is None or t is None or s != s or t != t:
            continue
        s, t = round(s * 1000), round(t * 1000)
        if t > s:
            by.setdefault(v, []).append((s, t))
    gaps, periods = set(), set()
    for v, xs in by.items():
        xs.sort()
        lo, hi = xs[0]
        for s, t in xs[1:]:
            if s > hi:
                gaps.add((v, hi, s))
                periods.add((v, lo, hi))
                lo, hi = s, t
            hi = max(hi, t)
        periods.add((v, lo, hi))
    return gaps, periods


def run(spark, rows, slice_rows):
    df = spark.createDataFrame(rows, SCHEMA)
    g = {tuple(r) for r in P.gaps(df, "video_id", "start_sec", "end_sec", slice_rows=slice_rows).collect()}
    p = {tuple(r) for r in P.periods(df, "video_id", "start_sec", "end_sec", slice_rows=slice_rows).collect()}
    return g, p


def test_against_brute_force_with_hot_key_and_dirt(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        v = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        s = rng.randint(0, 40_000) / 10
        rows.append((v, s, s + rng.choice([-1.0, 0.0, 0.5, 2.0, 9.0]), i, "x"))
    rows += [("n", None, 1.0, 0, ""), ("n", 1.0, None, 0, ""), ("n", float("nan"), 2.0, 0, "")]
    rows += [("touch", 0.0, 1.0, 0, ""), ("touch", 1.0, 2.0, 0, ""), ("touch", 5.0, 6.0, 0, "")] * 2
    expected = brute(rows)
    for slice_rows in (3, 50, 50_000):
        assert run(spark, rows, slice_rows) == expected


def test_crowded_slices_are_cut_again(spark):
    rng = random.Random(4)
    rows = [("v", s, s + 0.0004 * rng.randint(3, 20), i, "x") for i in range(2000) for s in [7.0 + rng.randint(0, 20_000) / 1000]]
    rows += [("v", 0.0, 1.0, 0, "x"), ("v", 5_000_000.0, 5_000_001.0, 0, "x")]
    points = P._points(P.clean_intervals(spark.createDataFrame(rows, SCHEMA), "video_id", "start_sec", "end_sec", 1000))
    sliced = P._sliced(P._sliced(points, ["e"], "b", 50), ["e", "b"], "c", 50)
    assert points.groupBy().count().first()[0] > 1000 and max(r["count"] for r in sliced.groupBy("b", "c").count().collect()) < 200
    assert run(spark, rows, 50) == brute(rows)


def test_empty(spark):
    assert run(spark, [], 10) == (set(), set())
