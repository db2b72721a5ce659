"""Threshold, significance, decay and scored-fire queries (M6-M8, W5, J6, PF8, PF9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotspots.config import FIXTURE_END, FIXTURE_START
from hotspots.functions.scoring import clipped_error
from hotspots.operators import densify as D
from hotspots.operators.prefix import running_total
from hotspots.operators.threshold import best_threshold, first_stage, group_errors, label_groups, sweep
from hotspots.plans.catalog import register
from hotspots.plans.oracle_sql import with_adapters as W
from hotspots.plans.scoring import score_series, scored_fires, with_cell_mean
from hotspots.sources import fixtures as X
from hotspots.sources.tables import Tables


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _series(spark, sf):
    snapped = D.snap_points(X.fires(Tables(spark, sf)))
    return snapped, with_cell_mean(D.densify(snapped, FIXTURE_START, FIXTURE_END))


SCORE_CTES = """
, sc AS (SELECT grid_cell, acq_date, latitude, longitude, fire_count AS y,
    avg(fire_count) OVER (PARTITION BY grid_cell) AS y_hat FROM series),
e AS (SELECT *, CASE WHEN CAST(y AS DOUBLE) - y_hat < 0 THEN CAST(0 AS DOUBLE) ELSE CAST(y AS DOUBLE) - y_hat END AS err FROM sc),
g AS (SELECT err, SUM(y) AS ys FROM e GROUP BY err),
cumg AS (SELECT err, ys, SUM(ys) OVER (ORDER BY err ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g),
t0 AS (SELECT MIN(err) AS t0 FROM cumg WHERE cum >= CAST(0.95 AS DOUBLE) * (SELECT SUM(y) FROM e)),
lab AS (SELECT err, CASE WHEN err > (SELECT t0 FROM t0) THEN 1 ELSE 0 END AS label FROM e),
st AS (SELECT MIN(err) AS lo, MAX(err) AS hi, SUM(label) AS P, SUM(1-label) AS N FROM lab),
th AS (SELECT i, CASE WHEN i = 999 THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / 999) + lo END AS t
       FROM range(1000) r(i), st),
gl AS (SELECT err, SUM(label) AS pos, SUM(1-label) AS neg FROM lab GROUP BY err),
cm AS (SELECT th.i, th.t, SUM(CASE WHEN gl.err > th.t THEN gl.pos ELSE 0 END) AS tp,
         SUM(CASE WHEN gl.err <= th.t THEN gl.neg ELSE 0 END) AS tn
       FROM th, gl GROUP BY th.i, th.t),
ba AS (SELECT i, t, CASE WHEN st.P > 0 AND st.N > 0 THEN (tn / CAST(st.N AS DOUBLE) + tp / CAST(st.P AS DOUBLE)) / 2
                      WHEN st.N > 0 THEN tn / CAST(st.N AS DOUBLE) ELSE tp / CAST(st.P AS DOUBLE) END AS bacc
       FROM cm, st),
best AS (SELECT i, t, bacc FROM ba WHERE bacc > 0 ORDER BY bacc DESC, i LIMIT 1),
scored AS (SELECT e.*, CASE WHEN err > (SELECT t FROM best) THEN 1 ELSE 0 END AS abnormal_label,
    CASE WHEN err = (SELECT t FROM best) THEN CAST(0 AS DOUBLE)
         WHEN err < (SELECT t FROM best) THEN (err - (SELECT t FROM best)) / (SELECT t FROM best)
         ELSE (err - (SELECT t FROM best)) / err END AS significance_score FROM e),
lastpos AS (SELECT *,
    last_value(CASE WHEN significance_score > 0 THEN acq_date END IGNORE NULLS) OVER w AS ld,
    last_value(CASE WHEN significance_score > 0 THEN significance_score END IGNORE NULLS) OVER w AS ls
  FROM scored WINDOW w AS (PARTITION BY grid_cell ORDER BY acq_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dec AS (SELECT *, CASE WHEN date_diff('day', ld, acq_date) > 10 THEN CAST(0 AS DOUBLE)
    ELSE 1 / (1 + exp(CAST(1.0 AS DOUBLE) * (date_diff('day', ld, acq_date) - 5))) END * ls AS dv FROM lastpos),
decayed AS (SELECT *, CASE WHEN significance_score > 0 THEN significance_score
    WHEN ld IS NOT NULL AND dv > significance_score AND dv > 0 THEN dv ELSE significance_score END AS significance_score_decay
  FROM dec),
final AS (SELECT *, CASE WHEN significance_score_decay > 0 THEN 1 ELSE 0 END AS abnormal_label_decay FROM decayed)
"""


def score_sql(body: str, extra: tuple = ()) -> str:
    return W(["series", "snapped", *extra], SCORE_CTES + body).replace("\n\n,", ",", 1)


@register("w5_running_error_total", score_sql(
    "SELECT round(err, 6) AS err, CAST(ys AS BIGINT) AS ys, CAST(cum AS BIGINT) AS cum FROM cumg"))
def q_w5(spark, sf):
    _, s = _series(spark, sf)
    g = (s.select(clipped_error("fire_count", "y_hat").alias("err"), "fire_count")
         .groupBy("err").agg(F.sum("fire_count").alias("ys")))
    c = running_total(g, "err", "ys", "cum")
    return c.select(r6("err").alias("err"), F.col("ys").cast("bigint").alias("ys"),
                    F.col("cum").cast("bigint").alias("cum"))


@register("m6_threshold_fit", score_sql("""
SELECT round((SELECT t0 FROM t0), 6) AS t0, round(t, 6) AS threshold, CAST(i AS BIGINT) AS threshold_index,
  round(bacc, 6) AS balanced_accuracy FROM best"""))
def q_m6(spark, sf):
    _, s = _series(spark, sf)
    g = group_errors(s.select(clipped_error("fire_count", "y_hat").alias("err"),
                              F.col("fire_count").alias("y"))).cache()
    t0 = first_stage(g, 0.95)
    best = best_threshold(sweep(label_groups(g, t0)))
    return best.select(F.round(F.lit(t0), 6).alias("t0"), r6("threshold").alias("threshold"),
                       F.col("i").cast("bigint").alias("threshold_index"),
                       r6("balanced_accuracy").alias("balanced_accuracy"))


@register("m6_threshold_sweep", score_sql("""
SELECT CAST(i AS BIGINT) AS i, round(t, 6) AS threshold, round(bacc, 6) AS balanced_accuracy FROM ba"""))
def q_m6s(spark, sf):
    _, s = _series(spark, sf)
    g = group_errors(s.select(clipped_error("fire_count", "y_hat").alias("err"),
                              F.col("fire_count").alias("y"))).cache()
    t0 = first_stage(g, 0.95)
    return sweep(label_groups(g, t0)).select(F.col("i").cast("bigint").alias("i"), r6("threshold").alias("threshold"),
                             r6("balanced_accuracy").alias("balanced_accuracy"))


@register("m7_threshold_apply", score_sql("""
SELECT grid_cell, acq_date, round(err, 6) AS err, abnormal_label, round(significance_score, 6) AS significance_score
FROM scored"""))
def q_m7(spark, sf):
    _, s = _series(spark, sf)
    scored, _ = score_series(s)
    return scored.select("grid_cell", "acq_date", r6("err").alias("err"), "abnormal_label",
                         r6("significance_score").alias("significance_score"))


M8_BODY = """
SELECT grid_cell, acq_date, abnormal_label, round(significance_score, 6) AS significance_score,
  abnormal_label_decay, round(significance_score_decay, 6) AS significance_score_decay FROM final"""


@register("m8_decay", score_sql(M8_BODY))
def q_m8(spark, sf):
    _, s = _series(spark, sf)
    scored, _ = score_series(s)
    return scored.select("grid_cell", "acq_date", "abnormal_label", r6("significance_score").alias("significance_score"),
                         "abnormal_label_decay", r6("significance_score_decay").alias("significance_score_decay"))


SCORED_FIRES_BODY = """
, sfires AS (SELECT s.acq_date, s.longitude_original AS longitude, s.latitude_original AS latitude,
    f.abnormal_label, f.significance_score, f.abnormal_label_decay, f.significance_score_decay
  FROM snapped s LEFT JOIN final f ON f.grid_cell = s.grid_cell AND f.acq_date = s.acq_date)
"""


def sfires_sql(body: str, extra: tuple = ()) -> str:
    return score_sql(SCORED_FIRES_BODY + body, extra)


def scored_fire_frame(spark, sf, keep_cell: bool = False):
    snapped, s = _series(spark, sf)
    scored, _ = score_series(s)
    return scored_fires(snapped, scored, keep_cell)


def _r(df):
    return df.select("acq_date", "longitude", "latitude", "abnormal_label",
                     r6("significance_score").alias("significance_score"), "abnormal_label_decay",
                     r6("significance_score_decay").alias("significance_score_decay"))


_SF_COLS = """acq_date, longitude, latitude, abnormal_label, round(significance_score,6) AS significance_score,
  abnormal_label_decay, round(significance_score_decay,6) AS significance_score_decay"""


@register("j6_scored_fires", sfires_sql(f"SELECT {_SF_COLS} FROM sfires"))
def q_j6(spark, sf):
    return _r(scored_fire_frame(spark, sf))


@register("pf8_abnormal_fires", sfires_sql(f"SELECT {_SF_COLS} FROM sfires WHERE abnormal_label_decay = 1"))
def q_pf8(spark, sf):
    return _r(scored_fire_frame(spark, sf).filter(F.col("abnormal_label_decay") == 1))


@register("pf8_normal_fires", sfires_sql(f"SELECT {_SF_COLS} FROM sfires WHERE abnormal_label_decay = 0"))
def q_pf8n(spark, sf):
    return _r(scored_fire_frame(spark, sf).filter(F.col("abnormal_label_decay") == 0))


@register("pf9_single_day", sfires_sql(f"SELECT {_SF_COLS} FROM sfires WHERE acq_date = DATE '2024-01-15'"))
def q_pf9(spark, sf):
    return _r(scored_fire_frame(spark, sf).filter(F.col("acq_date") == F.lit("2024-01-15").cast("date")))


@register("m8_streaming_decay", score_sql(M8_BODY))
def q_m8s(spark, sf):
    """The decay run as a stateful stream over two daily batches of scores; the
    state carried between the batches must give the batch result exactly."""
    from hotspots.session import scratch_dir
    from hotspots.streaming.decay_stream import start_decay_stream
    _, s = _series(spark, sf)
    scored, _ = score_series(s)
    base = scored.select("grid_cell", "acq_date", "abnormal_label", "significance_score")
    landing = scratch_dir(spark, "scores-landing")
    out = scratch_dir(spark, "scores-decayed")
    name = out.rstrip("/").rsplit("/", 1)[-1]
    cut = F.lit("2024-01-15").cast("date")
    for part in (base.filter(F.col("acq_date") <= cut), base.filter(F.col("acq_date") > cut)):
        part.write.mode("append").parquet(landing)
        q = start_decay_stream(spark, landing, out, name)
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    r = spark.read.parquet(out)
    return r.select("grid_cell", "acq_date", "abnormal_label", r6("significance_score").alias("significance_score"),
                    "abnormal_label_decay", r6("significance_score_decay").alias("significance_score_decay"))
