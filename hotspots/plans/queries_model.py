"""Model-operator queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from hotspots.config import FEATURES, FIXTURE_PERIODS, PCA_VARIANCE, RANDOM_STATE
from hotspots.functions.calendar import date_lit
from hotspots.operators import densify as D
from hotspots.operators.explain import quartile_table, stack_features
from hotspots.operators.imputer import fit_knn_imputer
from hotspots.operators.joins import broadcast_if_small
from hotspots.operators.kmeans import kmeans_groups
from hotspots.operators.nearest_days import NearestDays
from hotspots.operators.neighbors import nearest
from hotspots.operators.pca import fit_pca
from hotspots.operators.qforest import weighted_quantile
from hotspots.operators.scaler import fit_scaler
from hotspots.plans.catalog import register
from hotspots.plans.scoring_model import KEY, FirePredictionPipeline
from hotspots.plans.oracle_sql import with_adapters as W
from hotspots.plans.queries_core import features_no_border
from hotspots.plans.views import cluster_summary
from hotspots.sources import fixtures as X
from hotspots.sources.tables import Tables


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


TR = FIXTURE_PERIODS.train
CAL = FIXTURE_PERIODS.calibration
TE = FIXTURE_PERIODS.test


def _period(df, p):
    return df.filter(F.col("acq_date").between(date_lit(p[0]), date_lit(p[1])))


def _features(spark, sf):
    """Cell-day features, kept in memory: every fitted stage reads them again."""
    return features_no_border(spark, sf).select(*KEY, "fire_count", *FEATURES).persist(
        StorageLevel.MEMORY_AND_DISK)


# ---------------------------------------------------------------- SQL pieces
_TRAIN_SQL = "tr AS (SELECT * FROM features WHERE acq_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-16')"
_STATS_SQL = "st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM tr)"


def _scaled(src: str) -> str:
    cols = ", ".join(
        f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}"
        for c in FEATURES)
    return f"SELECT grid_cell, acq_date, grid_cell || '|' || CAST(acq_date AS VARCHAR) AS k, {cols} FROM {src}, st"


# ---------------------------------------------------------------- M1
M1_SQL = W(["features"], f""", {_TRAIN_SQL}, {_STATS_SQL}, z AS ({_scaled('features')})
SELECT grid_cell, acq_date, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM z""")


@register("m1_standard_scaler", M1_SQL)
def q_m1(spark, sf):
    f = _features(spark, sf)
    sc = fit_scaler(_period(f, TR), FEATURES)
    return sc.transform(f).select(*KEY, *[r6(c).alias(c) for c in FEATURES])


@register("a11_feature_stats", W(["features"], f""", {_TRAIN_SQL}
SELECT {', '.join(f'round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}' for c in FEATURES)} FROM tr"""))
def q_a11(spark, sf):
    from hotspots.operators.scaler import feature_stats
    st = feature_stats(_period(_features(spark, sf), TR), FEATURES)
    return st.select(*[r6(f"{c}__{s}").alias(f"{s}_{c}") for c in FEATURES for s in ("mean", "std")])


# ---------------------------------------------------------------- M2
def _m2_sql() -> str:
    n = len(FEATURES)
    sq = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0 END"
                    for c in FEATURES)
    cnt = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in FEATURES)
    anynull = " OR ".join(f"{c} IS NULL" for c in FEATURES)
    vals = ", ".join(f"d.{c} AS v_{c}, r.{c} IS NULL AS n_{c}" for c in FEATURES)
    cand = " UNION ALL ".join(
        f"SELECT rk, '{c}' AS feature, dist, dk, v_{c} AS value FROM dist WHERE n_{c} AND v_{c} IS NOT NULL AND dist IS NOT NULL"
        for c in FEATURES)
    outs = ", ".join(
        f"round(COALESCE(z.{c}, (SELECT value FROM top WHERE top.rk = z.k AND top.feature = '{c}'), "
        f"(SELECT avg({c}) FROM z)), 6) AS {c}" for c in FEATURES)
    return W(["features"], f""", {_TRAIN_SQL}, {_STATS_SQL}, z AS ({_scaled('tr')}),
r AS (SELECT * FROM z WHERE {anynull}),
pr AS (SELECT r.k AS rk, d.k AS dk, ({sq}) AS sq, ({cnt}) AS cnt, {vals} FROM r, z d),
dist AS (SELECT *, CASE WHEN cnt = 0 THEN NULL ELSE round(sqrt(sq * {n} / cnt), 9) END AS dist FROM pr),
cand AS ({cand}),
top AS (SELECT rk, feature, avg(value) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY rk, feature ORDER BY dist, dk) AS rn FROM cand) WHERE rn <= 10
  GROUP BY rk, feature)
SELECT z.grid_cell, z.acq_date, {outs} FROM z""")


@register("m2_knn_imputer", _m2_sql())
def q_m2(spark, sf):
    tr = _period(_features(spark, sf), TR)
    sc = fit_scaler(tr, FEATURES)
    z = sc.transform(tr).select(*KEY, *FEATURES)
    imp = fit_knn_imputer(z, FEATURES, KEY)
    return imp.transform(z, KEY).select(*KEY, *[r6(c).alias(c) for c in FEATURES])


# ---------------------------------------------------------------- M3
@register("m3_pca_projection")
def q_m3(spark, sf):
    tr = _period(_features(spark, sf), TR)
    sc = fit_scaler(tr, FEATURES)
    scaled = sc.transform(tr).select(*KEY, *FEATURES)
    z = fit_knn_imputer(scaled, FEATURES, KEY).transform(scaled, KEY)
    p = fit_pca(z, FEATURES)
    return p.transform(z).select(*KEY, *p.out_cols())


@register("m3_pca_rotation", lambda: W(["features"], _imputed_sql() + f"""
SELECT grid_cell, acq_date, round({' + '.join(
        f'({c} - (SELECT avg({c}) FROM imp)) * ({c} - (SELECT avg({c}) FROM imp))' for c in FEATURES)}, 6) AS squared_norm
FROM imp"""))
def q_m3r(spark, sf):
    """All components together turn the centred rows without changing their
    length: the sign-free form of the projection."""
    tr = _period(_features(spark, sf), TR)
    scaled = fit_scaler(tr, FEATURES).transform(tr).select(*KEY, *FEATURES)
    z = fit_knn_imputer(scaled, FEATURES, KEY).transform(scaled, KEY)
    p = fit_pca(z, FEATURES, variance=1.0)
    total = sum((F.col(c) * F.col(c) for c in p.out_cols()), F.lit(0.0))
    return p.transform(z).select(*KEY, r6(total).alias("squared_norm"))


def _eigen_sql() -> str:
    """CTEs up to ``kept``: the principal components in SQL. The covariance matrix
    (a list, row by row) is squared ``_SQUARINGS`` times, which leaves its leading
    eigenvector in every column; its part is taken out and the next one follows."""
    d = len(FEATURES)
    cov = ", ".join(f"covar_pop({a}, {b})" for a in FEATURES for b in FEATURES)
    product = (f"list_transform(range({d * d}), lambda i: list_sum(list_transform(range({d}), "
               f"lambda k: m[(i // {d}) * {d} + k + 1] * m[k * {d} + i % {d} + 1])))")
    # the column of the largest diagonal entry, so that it is not orthogonal to the vector
    column = (f"list_transform(range({d}), lambda i: m[i * {d} + 1 + list_position(list_transform(range({d}), lambda j: m[j * {d} + j + 1]), "
              f"list_max(list_transform(range({d}), lambda j: m[j * {d} + j + 1]))) - 1])")
    times = f"list_sum(list_transform(range({d * d}), lambda i: c[i + 1] * v[i // {d} + 1] * v[i % {d} + 1]))"
    scaled = lambda x: f"list_transform({x}, lambda q: q / list_max(list_transform({x}, lambda z: abs(z))))"
    return _imputed_sql() + f"""
, ready AS MATERIALIZED (SELECT * FROM imp), cov AS MATERIALIZED (SELECT [{cov}] AS c FROM ready),
steps AS (
  SELECT 1 AS component, 0 AS squared, c, {scaled('c')} AS m, CAST([] AS DOUBLE[]) AS v, CAST(0 AS DOUBLE) AS variance FROM cov
  UNION ALL
  SELECT CASE WHEN squared = {_SQUARINGS} + 1 THEN component + 1 ELSE component END,
    CASE WHEN squared = {_SQUARINGS} + 1 THEN 0 ELSE squared + 1 END,
    CASE WHEN squared = {_SQUARINGS} + 1 THEN list_transform(range({d * d}), lambda i: c[i + 1] - variance * v[i // {d} + 1] * v[i % {d} + 1]) ELSE c END,
    CASE WHEN squared < {_SQUARINGS} THEN {scaled(product)}
         WHEN squared = {_SQUARINGS} + 1 THEN {scaled(f"list_transform(range({d * d}), lambda i: c[i + 1] - variance * v[i // {d} + 1] * v[i % {d} + 1])")}
         ELSE m END,
    CASE WHEN squared = {_SQUARINGS} THEN list_transform({column}, lambda x: x / sqrt(list_sum(list_transform({column}, lambda z: z * z)))) ELSE v END,
    CASE WHEN squared = {_SQUARINGS} + 1 THEN 0 ELSE variance END
  FROM (SELECT component, squared, c, m, v, CASE WHEN squared = {_SQUARINGS} + 1 THEN {times} ELSE 0 END AS variance FROM steps) s
  WHERE component <= {d}),
found AS (SELECT component, v, {times} AS variance FROM steps WHERE squared = {_SQUARINGS} + 1 AND component <= {d}),
shares AS (SELECT *, variance / SUM(variance) OVER () AS share,
  SUM(variance) OVER (ORDER BY component) / SUM(variance) OVER () AS reached FROM found),
kept AS (SELECT * FROM shares WHERE reached - share <= {PCA_VARIANCE})"""


def _recursive(body: str) -> str:
    return W(["features"], body).replace("WITH ", "WITH RECURSIVE ", 1)


_SQUARINGS = 14


@register("m3_pca_components", lambda: _recursive(_eigen_sql() + """
SELECT CAST(component AS INTEGER) AS component, round(variance, 6) AS variance, round(share, 6) AS share FROM kept"""))
def q_m3c(spark, sf):
    """The kept components: how much variance the scores have along each, as a
    value and as a share; the fewest that reach more than 0.95 together. A wrong
    basis has other variances, a wrong cut another number of rows."""
    z = _imputed_training(spark, sf)
    p = fit_pca(z, FEATURES)
    spread = p.transform(z).agg(*[F.var_pop(c).alias(c) for c in p.out_cols()])
    total = z.agg(sum((F.var_pop(c) for c in FEATURES), F.lit(0.0)).alias("total"))
    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(c).alias("variance")) for i, c in enumerate(p.out_cols())])
    return (spread.join(F.broadcast(total)).select(F.explode(each).alias("c"), "total")  # one row each
            .select("c.component", r6("c.variance").alias("variance"), r6(F.col("c.variance") / F.col("total")).alias("share")))


@register("m3_pca_kept_length", lambda: _recursive(_eigen_sql() + f"""
, means AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in FEATURES)} FROM ready)
SELECT grid_cell, acq_date, CAST(COUNT(*) AS INTEGER) AS k, round(SUM(score * score), 5) AS squared_length
FROM (SELECT grid_cell, acq_date, {' + '.join(f'v[{i + 1}] * ({c} - m_{c})' for i, c in enumerate(FEATURES))} AS score
  FROM ready, means, kept) s GROUP BY grid_cell, acq_date"""))
def q_m3k(spark, sf):
    """Squared length of every row's kept scores: the sign-free form of the
    projection, which only the right subspace gives."""
    z = _imputed_training(spark, sf)
    p = fit_pca(z, FEATURES)
    total = sum((F.col(c) * F.col(c) for c in p.out_cols()), F.lit(0.0))
    return p.transform(z).select(*KEY, F.lit(p.k).alias("k"), F.round(total, 5).alias("squared_length"))


def _imputed_training(spark, sf):
    """Scaled and imputed features of the training rows."""
    tr = _period(_features(spark, sf), TR)
    scaled = fit_scaler(tr, FEATURES).transform(tr).select(*KEY, *FEATURES)
    return fit_knn_imputer(scaled, FEATURES, KEY).transform(scaled, KEY).persist(StorageLevel.MEMORY_AND_DISK)


# ---------------------------------------------------------------- M5 step (O)
@register("m5_weighted_quantile", W(["series"], """
, g AS (SELECT grid_cell, fire_count AS y, COUNT(*) AS w FROM series GROUP BY ALL),
c AS (SELECT *, SUM(w) OVER (PARTITION BY grid_cell ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      / SUM(w) OVER (PARTITION BY grid_cell) AS cf FROM g)
SELECT grid_cell, MIN(y) AS q95 FROM c WHERE cf >= CAST(0.95 AS DOUBLE) - CAST(1e-9 AS DOUBLE) GROUP BY grid_cell"""))
def q_m5w(spark, sf):
    s = D.densify(D.snap_points(X.fires(Tables(spark, sf))), TR[0], TE[1])
    g = s.groupBy("grid_cell", F.col("fire_count").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    return weighted_quantile(g, ["grid_cell"], "y", "w", 0.95, "q95")


# ---------------------------------------------------------------- M4 / M5 / M14 (rows only)
def _pipeline(spark, sf, num_trees=100):
    f = _features(spark, sf)
    pipe = FirePredictionPipeline(num_trees=num_trees).fit(_period(f, TR), _period(f, CAL))
    return pipe, f


@register("m4_m5_quantile_forest")
def q_m4(spark, sf):
    f = _features(spark, sf)
    pipe = FirePredictionPipeline().fit_rf(_period(f, TR))
    return pipe.expected(_period(f, TE)).select(*KEY, "fire_count", "y_hat")


@register("m5_forest_weights", W(["features"], """
SELECT grid_cell, acq_date, CAST(1.0 AS DOUBLE) AS weight, TRUE AS in_labels
FROM features WHERE acq_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'"""))
def q_m5f(spark, sf):
    """Every row's weights over the training labels sum to one, and its
    quantile is one of the labels that its leaves hold."""
    f = _features(spark, sf)
    pipe = FirePredictionPipeline().fit_rf(_period(f, TR))
    ready = pipe.prepare(_period(f, TE))
    total = F.aggregate("labels", F.lit(0.0), lambda n, x: n + x["w"])
    known = F.transform("labels", lambda x: x["y"])
    return (pipe.forest.weights(ready, KEY).join(pipe.forest.predict(ready, KEY), KEY)
            .select(*KEY, r6(total).alias("weight"), F.array_contains(known, F.col("y_hat")).alias("in_labels")))


@register("m5_label_weights", W(["features"], f""", {_TRAIN_SQL}
SELECT CAST(fire_count AS DOUBLE) AS y, CAST(COUNT(*) AS DOUBLE) AS weight FROM tr GROUP BY fire_count"""))
def q_m5l(spark, sf):
    """Over the training rows themselves, the weights of a label add up to the
    number of rows that have it: a tree's leaf of n rows gives each of its n
    rows 1/n of its labels. A lost, doubled or moved weight shows here."""
    f = _features(spark, sf)
    train = _period(f, TR)
    pipe = FirePredictionPipeline().fit_rf(train)
    return (pipe.forest.weights(pipe.prepare(train), KEY).select(F.explode("labels").alias("l"))
            .groupBy(F.col("l.y").alias("y")).agg(r6(F.sum("l.w")).alias("weight")))


@register("m14_fire_scoring_model")
def q_m14(spark, sf):
    pipe, f = _pipeline(spark, sf)
    p = pipe.predict(_period(f, TE))
    return p.select(*KEY, "fire_count", "y_hat", "abnormal_label", r6("significance_score").alias("significance_score"),
                    "abnormal_label_decay", r6("significance_score_decay").alias("significance_score_decay"))


# ---------------------------------------------------------------- M9 (O)
M9_SQL = """
WITH c AS (SELECT * FROM embeddings),
cu AS (SELECT vec_id, CASE WHEN label > 0 THEN 1 ELSE 0 END AS cls, generate_subscripts(embedding, 1) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM c),
st AS (SELECT i, AVG(x) AS mu, STDDEV_POP(x) AS sd FROM cu GROUP BY i),
cs AS (SELECT cu.vec_id, cu.cls, cu.i, (cu.x - st.mu) / CASE WHEN st.sd = 0 THEN 1 ELSE st.sd END AS z FROM cu JOIN st USING (i)),
d AS (SELECT q.vec_id AS qid, c2.vec_id AS cid, c2.cls, round(sqrt(SUM((q.z - c2.z) * (q.z - c2.z))), 9) AS dist
  FROM cs q JOIN cs c2 ON q.i = c2.i AND q.vec_id <> c2.vec_id GROUP BY q.vec_id, c2.vec_id, c2.cls),
b AS (SELECT *, row_number() OVER (PARTITION BY qid, cls ORDER BY dist, cid) AS rn FROM d)
SELECT b.qid AS vec_id, CAST(b.cls AS BIGINT) AS class, b.cid AS match_id, c.label AS match_label,
  round(b.dist, 6) AS distance FROM b JOIN c ON c.vec_id = b.cid WHERE rn = 1"""


@register("m9_nearest_fire_and_nofire_day", M9_SQL)
def q_m9(spark, sf):
    """For every vector its nearest other vector with label > 0 ("fire day") and
    with label 0, in the standardised space (leave-one-out over the table)."""
    emb = Tables(spark, sf).embeddings
    dims = emb.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("mu"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    st = sorted((r["i"], r["mu"], r["sd"]) for r in dims.collect())  # fitted: one pair per dimension
    mu = F.array(*[F.lit(float(m)) for _, m, _ in st])
    sd = F.array(*[F.lit(float(s) if s else 1.0) for _, _, s in st])
    z = (emb.withColumn("z", F.transform("embedding", lambda x, i: (x.cast("double") - mu[i]) / sd[i]))
         .withColumn("cls", F.when(F.col("label") > 0, 1).otherwise(0).cast("bigint")))
    nn = nearest(z.select("vec_id", "z"), z.select(F.col("vec_id").alias("cid"), "cls", "z"),
                 "vec_id", "cid", "z", group="cls", k=1, exclude_self=True)
    return (nn.join(z.select(F.col("vec_id").alias("cid"), F.col("label").alias("match_label")), "cid")
            .select("vec_id", F.col("cls").alias("class"), F.col("cid").alias("match_id"), "match_label",
                    r6("distance").alias("distance")))


def nearest_training_days(spark, sf):
    """Per test cell-day, the nearest training cell-day with fires and without
    (J11 / M9 on the feature matrix): scaled and imputed features, exact search.
    Returns the match's original features and fire count."""
    f = _features(spark, sf)
    tr, te = _period(f, TR), _period(f, TE)
    sc = fit_scaler(tr, FEATURES)
    imp = fit_knn_imputer(sc.transform(tr).select(*KEY, *FEATURES), FEATURES, KEY)
    ready = lambda df: imp.transform(sc.transform(df).select(*KEY, *FEATURES), KEY)
    days = NearestDays.fit(tr, ready(tr), FEATURES, KEY, "fire_count")
    return days.search(ready(te)).withColumn("distance", r6("distance"))


def _imputed_sql(extra: str = "") -> str:
    """CTEs up to ``imp``: scaled and imputed features of the training rows
    (``part`` 'tr') and, with ``extra``, of further rows (``part`` 'te')."""
    n = len(FEATURES)
    both = lambda c: f"r.{c} IS NOT NULL AND d.{c} IS NOT NULL"
    sq = " + ".join(f"CASE WHEN {both(c)} THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0 END" for c in FEATURES)
    cnt = " + ".join(f"CASE WHEN {both(c)} THEN 1 ELSE 0 END" for c in FEATURES)
    vals = ", ".join(f"d.{c} AS v_{c}, r.{c} IS NULL AS n_{c}" for c in FEATURES)
    cand = " UNION ALL ".join(
        f"SELECT rk, '{c}' AS feature, dist, dk, v_{c} AS value FROM dist WHERE n_{c} AND v_{c} IS NOT NULL AND dist IS NOT NULL"
        for c in FEATURES)
    outs = ", ".join(f"COALESCE(z.{c}, p.{c}, (SELECT avg({c}) FROM zt)) AS {c}" for c in FEATURES)
    tops = ", ".join(f"max(value) FILTER (feature = '{c}') AS {c}" for c in FEATURES)
    anynull = " OR ".join(f"{c} IS NULL" for c in FEATURES)
    return f""", {_TRAIN_SQL}, {_STATS_SQL}, zt AS ({_scaled('tr')}), {extra}
z AS (SELECT 'tr' AS part, * FROM zt {"UNION ALL SELECT 'te', * FROM ze" if extra else ""}),
r AS (SELECT * FROM z WHERE {anynull}),
pr AS (SELECT r.k AS rk, d.k AS dk, ({sq}) AS sq, ({cnt}) AS cnt, {vals} FROM r, zt d),
dist AS (SELECT *, CASE WHEN cnt = 0 THEN NULL ELSE round(sqrt(sq * {n} / cnt), 9) END AS dist FROM pr),
cand AS ({cand}),
top AS (SELECT rk, feature, avg(value) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY rk, feature ORDER BY dist, dk) AS rn FROM cand) WHERE rn <= 10
  GROUP BY rk, feature),
filled AS (SELECT rk, {tops} FROM top GROUP BY rk),
imp AS (SELECT z.part, z.grid_cell, z.acq_date, {outs} FROM z LEFT JOIN filled p ON p.rk = z.k)"""


_TE_SQL = "te AS (SELECT * FROM features WHERE acq_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'), "
M9_DAYS_SQL = W(["features"], _imputed_sql(_TE_SQL + f"ze AS ({_scaled('te')}),") + f"""
, pairs AS (SELECT q.grid_cell, q.acq_date, CAST(CASE WHEN t.fire_count > 0 THEN 1 ELSE 0 END AS BIGINT) AS class,
    c.grid_cell AS match_grid_cell, c.acq_date AS match_acq_date,
    round(sqrt({' + '.join(f'(q.{c} - c.{c}) * (q.{c} - c.{c})' for c in FEATURES)}), 9) AS distance
  FROM imp q, imp c JOIN tr t ON t.grid_cell = c.grid_cell AND t.acq_date = c.acq_date
  WHERE q.part = 'te' AND c.part = 'tr'),
best AS (SELECT *, row_number() OVER (PARTITION BY grid_cell, acq_date, class
  ORDER BY distance, match_grid_cell, match_acq_date) AS rn FROM pairs)
SELECT b.grid_cell, b.acq_date, b.class, b.match_grid_cell, b.match_acq_date, t.fire_count,
  {', '.join('t.' + c for c in FEATURES)}, round(b.distance, 6) AS distance
FROM best b JOIN tr t ON t.grid_cell = b.match_grid_cell AND t.acq_date = b.match_acq_date WHERE b.rn = 1""")


@register("m9_nearest_training_days", M9_DAYS_SQL)
def q_m9d(spark, sf):
    return nearest_training_days(spark, sf)


# ---------------------------------------------------------------- M10 (O) / M11-M12 (rows)
def _m10_sql() -> str:
    parts = []
    for c in FEATURES:
        parts.append(f"""SELECT '{c}' AS feature, q1, q2, q3, CAST(CASE WHEN {c} > q3 THEN 3 WHEN {c} > q2 THEN 2
  WHEN {c} > q1 THEN 1 ELSE 0 END AS INTEGER) AS bin FROM tr,
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM tr) qq
  WHERE {c} IS NOT NULL""")
    u = " UNION ALL ".join(parts)
    return W(["features"], f""", {_TRAIN_SQL}, b AS ({u})
SELECT feature, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, bin, COUNT(*) AS n
FROM b GROUP BY ALL""")


@register("m10_explainer_fit", _m10_sql())
def q_m10(spark, sf):
    tr = _period(_features(spark, sf), TR)
    qt = quartile_table(tr, FEATURES)
    j = stack_features(tr, FEATURES).join(F.broadcast(qt), "feature")  # one row per feature: bounded
    b = j.withColumn("bin", F.when(F.col("x") > F.col("q3"), 3).when(F.col("x") > F.col("q2"), 2)
                     .when(F.col("x") > F.col("q1"), 1).otherwise(0))
    return b.groupBy("feature", r6("q1").alias("q1"), r6("q2").alias("q2"), r6("q3").alias("q3"),
                     "bin").agg(F.count(F.lit(1)).alias("n"))


@register("m11_m12_explanations")
def q_m11(spark, sf):
    pipe, f = _pipeline(spark, sf)
    # every abnormal cell-day of the test period gets its explanation
    flagged = pipe.predict(_period(f, TE)).filter(F.col("abnormal_label") == 1).select(*KEY)
    rows = (_period(f, TE).join(flagged, KEY)
            .withColumn("row_id", F.concat_ws("|", "grid_cell", F.col("acq_date").cast("string"))))
    return pipe.explain(rows, "row_id")


def _explained_sql() -> str:
    quart = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}, avg({c}) AS m_{c}" for c in FEATURES)

    def rule(c):
        x, two = f"COALESCE(e.{c}, m_{c})", lambda i: f"format('{{:.2f}}', CAST(q_{c}[{i}] AS DOUBLE))"
        return (f"CASE WHEN {x} <= q_{c}[1] THEN '{c} <= ' || {two(1)} WHEN {x} <= q_{c}[2] THEN {two(1)} || ' < {c} <= ' || {two(2)} "
                f"WHEN {x} <= q_{c}[3] THEN {two(2)} || ' < {c} <= ' || {two(3)} ELSE '{c} > ' || {two(3)} END")

    rules = " || '; ' || ".join(rule(c) for c in FEATURES)
    return W(["features"], f""", {_TRAIN_SQL}, q AS (SELECT {quart} FROM tr)
SELECT grid_cell, acq_date, {rules} AS rules, CAST(2000 AS BIGINT) AS copies, CAST(0.0 AS DOUBLE) AS equation_error
FROM features e, q WHERE acq_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' AND fire_count >= 9""")


@register("m12_explained_equations", _explained_sql())
def q_m12e(spark, sf):
    """The days of many fires explained: the rule of every feature, and how far
    the reported weights are from solving the weighted normal equations, summed
    again from the copies (sum of w r = 0 and of w z r = weight for each flag z,
    r being what the surrogate leaves of a copy's prediction)."""
    f = _features(spark, sf)
    pipe = FirePredictionPipeline(num_trees=20).fit_rf(_period(f, TR)).fit_views(_period(f, TR))
    ex, predict = pipe.explainer, pipe.predict_fn()
    rows = (_period(f, TE).filter("fire_count >= 9")
            .withColumn("row_id", F.concat_ws("|", "grid_cell", F.col("acq_date").cast("string"))))
    given = rows.select("row_id", *[F.coalesce(F.col(c), F.lit(ex.means[c])).cast("double").alias(c) for c in FEATURES])
    # made and scored once, for the explanation, its coefficients and the check
    scored = ex.scored_copies(given, "row_id", predict, 2000, RANDOM_STATE).checkpoint()
    explained = ex.explain(rows, "row_id", predict, num_samples=2000, scored=scored).checkpoint()
    named = F.map_from_entries("explanation")
    # the weights as reported, brought back to the order of the features by their rules
    fitted = ex.coefficients(rows, "row_id", predict, 2000, scored=scored).join(explained, "row_id")
    texts = [[F.lit(r) for r in ex.rules(c)] for c in FEATURES]
    own = [F.when(named[r[0]].isNotNull(), r[0]).when(named[r[1]].isNotNull(), r[1]).when(named[r[2]].isNotNull(), r[2])
           .otherwise(r[3]) for r in texts]
    known = fitted.select("row_id", F.array(*own).alias("_rules"), F.array(*[named[r] for r in own]).alias("_b"), "intercept")
    copies = scored.join(broadcast_if_small(known), "row_id")
    left = F.col("y_hat") - F.col("intercept") - sum((F.col("_b")[i] * ex.flag(i) for i in range(len(FEATURES))), F.lit(0.0))
    errors = [F.abs(F.sum(ex.weight() * left)), *[F.abs(F.sum(ex.weight() * ex.flag(i) * left) - F.first(F.col("_b")[i]))
                                                  for i in range(len(FEATURES))]]
    checked = copies.groupBy("row_id").agg(F.count(F.lit(1)).alias("copies"), F.round(F.greatest(*errors), 6).alias("equation_error"),
                                           F.first(F.array_join("_rules", "; ")).alias("rules"))
    return rows.select(*KEY, "row_id").join(checked, "row_id").select(*KEY, "rules", "copies", "equation_error")


# ---------------------------------------------------------------- M13 (rows)
def _scored_points(spark, sf):
    from hotspots.plans.queries_scoring import _series
    from hotspots.plans.scoring import score_series
    snapped, s = _series(spark, sf)
    scored, _ = score_series(s)
    sc = scored.select("grid_cell", "acq_date", "abnormal_label_decay", "significance_score_decay")
    return snapped.join(sc, ["grid_cell", "acq_date"], "left").select(
        F.col("event_id").alias("_pid"), "acq_date", "abnormal_label_decay", "significance_score_decay",
        F.col("latitude_original").alias("lat"), F.col("longitude_original").alias("lon"))


@register("m13_kmeans_day_clusters")
def q_m13(spark, sf):
    pts = _scored_points(spark, sf)
    return kmeans_groups(pts, ["acq_date", "abnormal_label_decay"], k=5)


@register("a10_kmeans_cluster_summary")
def q_a10k(spark, sf):
    pts = _scored_points(spark, sf)
    cl = kmeans_groups(pts, ["acq_date", "abnormal_label_decay"], k=5)
    cl = cl.withColumnRenamed("lat", "latitude").withColumnRenamed("lon", "longitude")
    return cluster_summary(cl)

