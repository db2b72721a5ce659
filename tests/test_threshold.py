import numpy as np

from hotspots.operators.threshold import fit_threshold


def ref_fit(y_true, y_pred, frac, n=1000):
    """Restatement of the two-stage fit with numpy (argsort / cumsum / searchsorted)."""
    err = y_true - y_pred
    err[err < 0] = 0
    idx = np.argsort(err, kind="stable")
    cum = np.cumsum(y_true[idx])
    t0 = err[idx[np.searchsorted(cum, frac * y_true.sum())]]
    lab = (err > t0).astype(int)
    best, hi = None, 0.0
    for t in np.linspace(err.min(), err.max(), n):
        pred = (err > t).astype(int)
        rec = []
        for c in (0, 1):
            m = lab == c
            if m.any():
                rec.append((pred[m] == c).mean())
        ba = np.mean(rec)
        if ba > hi:
            hi, best = ba, t
    return t0, best


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.poisson(1.5, 800).astype(float)
    y[rng.random(800) < 0.05] += rng.integers(3, 12, int((rng.random(800) < 0.05).sum()) or 1)[0]
    yhat = rng.uniform(0, 3, 800)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, yhat)], "y double, y_hat double")
    m = fit_threshold(df, "y", "y_hat", 0.95)
    t0, best = ref_fit(y.copy(), yhat.copy(), 0.95)
    assert abs(m.t0 - t0) < 1e-12
    assert abs(m.threshold - best) < 1e-12
