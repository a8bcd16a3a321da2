import numpy as np
import pytest

from tidemark.plans import resampling


def units(spark, n):
    rng = np.random.default_rng(4)
    x = rng.exponential(size=n) - 0.4
    return x, spark.createDataFrame([(f"u{i}", float(v), 1.0) for i, v in enumerate(x)], "k string, v double, c double")


def test_bootstrap_draws_as_many_units_in_2000_replicates(spark):
    x, df = units(spark, 300)
    got = resampling.bootstrap(df, "k", ["v", "c"], 1).toPandas()
    assert len(got) == 2000 and (got.n == 300).all() and (got.c == 300).all()
    want = x[np.random.default_rng(0).integers(0, 300, (2000, 300))].mean(axis=1)
    m = got.v / got.n
    assert m.mean() == pytest.approx(x.mean(), abs=0.01) and m.std() == pytest.approx(want.std(), rel=0.1)
    for p in (2.5, 97.5):
        assert np.percentile(m, p) == pytest.approx(np.percentile(want, p), abs=0.03)
    assert got.v.nunique() > 1990


def test_sign_flips_of_equal_sizes(spark):
    d = [0.5] * 40 + [-0.5] * 25 + [1.0] * 10 + [0.0] * 30 + [0.25]
    df = spark.createDataFrame([(v,) for v in d], "v double")
    got = resampling.sign_flips(df, "v", 1).toPandas().v
    assert len(got) == 200_000 and got.std() == pytest.approx(np.sqrt(np.square(d).sum()), rel=0.02) and abs(got.mean()) < 0.05
    want = (np.random.default_rng(2).choice([-1.0, 1.0], size=(50_000, len(d))) * d).sum(axis=1)
    assert (got.abs() >= 8).mean() == pytest.approx((abs(want) >= 8).mean(), abs=0.01)
    assert (resampling.sign_flips(df.where("v = 0"), "v", 1).toPandas().v == 0).all()
