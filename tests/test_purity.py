import numpy as np

from tidemark.plans import resampling


def test_permuted_purity_equals_shuffling(spark):
    rng = np.random.default_rng(6)
    owner, label = rng.integers(0, 40, 300), rng.choice(["a", "b", "c", None], 300, p=[0.5, 0.3, 0.1, 0.1])
    owner[:5] = np.arange(100, 105)  # owners of one row don't count
    df = spark.createDataFrame([(f"v{o}", k) for o, k in zip(owner, label)], "video_id string, arm string")
    got = resampling.permuted_purity(df, "video_id", "arm", 3).first()
    code, values = np.unique([str(k) for k in label], return_inverse=True)[1], []
    for _ in range(1000):
        rng.shuffle(code)
        each = np.bincount(owner * 4 + code, minlength=105 * 4).reshape(-1, 4)
        each = each[each.sum(axis=1) >= 2]
        values.append(each.max(axis=1).sum() / each.sum())
    values.sort()
    assert got.rounds == 1000 and got.mean <= got.p95 <= got.max
    assert abs(got["mean"] - np.mean(values)) < 0.003 and abs(got.p95 - values[950]) < 0.008 and abs(got["max"] - values[-1]) < 0.04
