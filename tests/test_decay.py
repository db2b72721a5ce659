import datetime as dt
import math
import random

from hotspots.operators.decay import decay_scores


def py_decay(rows, rate, mid, cutoff):
    """Sequential restatement: rows (cell, date, score) in any order."""
    last = {}
    out = {}
    for cell, d, s in sorted(rows, key=lambda r: (r[1], r[0])):
        if s > 0:
            last[cell] = (d, s)
            out[(cell, d)] = s
        elif cell in last:
            ld, ls = last[cell]
            t = (d - ld).days
            dec = 0.0 if t > cutoff else 1 / (1 + math.exp(rate * (t - mid)))
            v = dec * ls
            out[(cell, d)] = v if (v > s and v > 0) else s
        else:
            out[(cell, d)] = s
    return out


def _run(spark, rows, rate, mid, cutoff):
    df = spark.createDataFrame(rows, "grid_cell string, acq_date date, significance_score double")
    r = decay_scores(df, rate=rate, midpoint=mid, cutoff=cutoff).collect()
    return {(x.grid_cell, x.acq_date): (x.significance_score_decay, x.abnormal_label_decay) for x in r}


def test_literal_fixture(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 6)]
    rows = [("A", d[0], .8), ("A", d[1], -.5), ("B", d[2], .9), ("B", d[3], -.2), ("A", d[4], -.7)]
    got = _run(spark, rows, 0.1, 5, 10)
    assert abs(got[("A", d[1])][0] - 0.47895) < 1e-5
    assert abs(got[("B", d[3])][0] - 0.53882) < 1e-5
    assert abs(got[("A", d[4])][0] - 0.41998) < 1e-5
    assert got[("A", d[0])][0] == .8 and got[("B", d[2])][0] == .9
    assert all(v[1] == 1 for v in got.values())


def test_random_against_sequential(spark):
    rng = random.Random(7)
    rows = []
    for c in "ABCD":
        for i in range(40):
            rows.append((c, dt.date(2024, 1, 1) + dt.timedelta(days=i), rng.uniform(-1, 1) * (rng.random() < 0.8)))
    got = _run(spark, rows, 1.0, 5.0, 10.0)
    exp = py_decay(rows, 1.0, 5.0, 10.0)
    for k, v in exp.items():
        assert abs(got[k][0] - v) < 1e-12
        assert got[k][1] == (1 if v > 0 else 0)
