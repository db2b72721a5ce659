import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hotspots.operators.threshold import fit_threshold
from tests.test_threshold import ref_fit


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_fit_equals_restatement(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    y = rng.poisson(rng.uniform(0.2, 3), n).astype(float)
    yhat = np.round(rng.uniform(0, 3, n), 3)
    if (y - yhat).max() <= 0:
        y[0] = 10.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, yhat)], "y double, y_hat double")
    try:
        m = fit_threshold(df, "y", "y_hat", 0.95)
    except ValueError:
        return
    t0, best = ref_fit(y.copy(), yhat.copy(), 0.95)
    assert abs(m.t0 - t0) < 1e-12
    assert best is not None and abs(m.threshold - best) < 1e-12
