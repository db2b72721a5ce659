"""Analysis views over scored fires (A5-A10, J7-J9, PF10, PF12, F10-F13, F16, F17).

Every view is computed for all days at once instead of one selected day.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.config import HIST_BIN_WIDTH, POP_DISPLAY_CAP
from hotspots.functions import display, geo
from hotspots.operators.densify import zero_fill_daily
from hotspots.operators.joins import broadcast_if_small, first_interval_match, within_windows

# Display texts of the two fire classes.
ABNORMAL_TEXT = "War-related"
NORMAL_TEXT = "Non war-related"


def date_range_of(df: DataFrame, col: str = "acq_date"):
    """(min, max) of ``col`` from one scalar subquery (one aggregation, no join)."""
    r = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    return r.getField("lo"), r.getField("hi")


def abnormal_per_day(scored: DataFrame) -> DataFrame:
    """Abnormal fires per day over the whole scored range, 0 filled (A5, TS2)."""
    lo, hi = date_range_of(scored)
    counts = (scored.filter(F.col("abnormal_label_decay") == 1)
              .groupBy("acq_date").agg(F.count(F.lit(1)).alias("n_abnormal")))
    return zero_fill_daily(counts, "acq_date", "n_abnormal", lo, hi)


def class_counts_per_day(scored: DataFrame) -> DataFrame:
    """Abnormal and normal fires of every day with fires."""
    lab = F.col("abnormal_label_decay")
    return scored.groupBy("acq_date").agg(
        F.count_if(lab == 1).alias("n_abnormal"), F.count_if(lab == 0).alias("n_normal"))


def global_ranges(scored: DataFrame, weather: DataFrame) -> DataFrame:
    """Date range of the scored fires and the mean-temperature range of the
    weather inside it (A7)."""
    lo, hi = date_range_of(scored)
    w = weather.filter(F.col("acq_date").between(lo, hi))
    return w.agg(F.min("t_mean").alias("min_temp"), F.max("t_mean").alias("max_temp")).select(
        lo.alias("min_date"), hi.alias("max_date"), "min_temp", "max_temp")


def colour_range_per_event(scored: DataFrame, windows: DataFrame,
                           col: str = "significance_score_decay") -> DataFrame:
    """vmin = min(0, min score), vmax = max(0, max score) of the abnormal fires in
    each event window; 0, 0 for a window without fires (A8, J9)."""
    inside = within_windows(scored.filter(F.col("abnormal_label_decay") == 1), windows)
    agg = inside.groupBy("event").agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    return (windows.select("event", "start_date", "end_date").join(agg, "event", "left")
            .select("event", "start_date", "end_date",
                    F.coalesce(F.least(F.lit(0.0), "_mn"), F.lit(0.0)).alias("vmin"),
                    F.coalesce(F.greatest(F.lit(0.0), "_mx"), F.lit(0.0)).alias("vmax")))


def sorted_for_plot(df: DataFrame, col: str = "significance_score_decay") -> DataFrame:
    """Rows ordered by a score so the strongest are drawn last (SL2); a global
    sort is a range-partitioned shuffle, used only right before a sink."""
    return df.orderBy(F.col(col).asc_nulls_first())


def fires_in_windows(scored: DataFrame, windows: DataFrame) -> DataFrame:
    """Each fire once per event window containing its day."""
    return within_windows(scored, windows)


def score_histogram(scored: DataFrame, col: str = "significance_score_decay",
                    width: float = HIST_BIN_WIDTH) -> DataFrame:
    """Equal-width histogram per class.

    Both classes use the bin count int((max - min of the normal class) / width);
    each class spans its own [min, max]; the last bin is closed on the right.
    The class ranges are fitted parameters (four numbers); the bins of both
    classes are then counted in one aggregation, and every bin appears, empty
    ones with 0.
    """
    spark = scored.sparkSession
    cls = F.when(F.col("abnormal_label_decay") == 1, F.lit("abnormal")).otherwise(F.lit("normal"))
    # two narrow columns, read twice (ranges, then counts): kept in memory
    s = (scored.select(cls.alias("class"), F.col(col).alias("x")).filter(F.col("x").isNotNull())
         .persist(StorageLevel.MEMORY_AND_DISK))
    ranges = {r["class"]: (r["lo"], r["hi"]) for r in
              s.groupBy("class").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    if "normal" not in ranges:
        return spark.createDataFrame([], "class string, bin int, lo double, hi double, n bigint")
    nlo, nhi = ranges["normal"]
    n = max(int((nhi - nlo) / width), 1)

    def per_class(fn):
        e = None
        for c, (lo, hi) in sorted(ranges.items()):
            v = fn(lo, hi)
            e = F.when(F.col("class") == c, v) if e is None else e.when(F.col("class") == c, v)
        return e

    def edge(k, lo, hi):
        step = (hi - lo) / n
        return F.when(k == n, F.lit(hi)).otherwise(k.cast("double") * F.lit(step) + F.lit(lo))

    def bin_expr(lo, hi):
        if hi <= lo:
            return F.lit(0)
        x = F.col("x")
        b = F.floor((x - F.lit(lo)) * F.lit(n / (hi - lo))).cast("int")
        b = F.least(F.greatest(b, F.lit(0)), F.lit(n - 1))
        b = F.when(x < edge(b, lo, hi), b - 1).otherwise(b)
        return F.when((x >= edge(b + 1, lo, hi)) & (b != n - 1), b + 1).otherwise(b)

    counts = s.groupBy("class", per_class(bin_expr).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    classes = F.array(*[F.lit(c) for c in sorted(ranges)])
    bins = spark.range(n).select(F.col("id").cast("int").alias("bin"), F.explode(classes).alias("class"))
    k = F.col("bin")
    return bins.join(counts, ["class", "bin"], "left").select(
        "class", "bin", per_class(lambda lo, hi: edge(k, lo, hi)).alias("lo"),
        per_class(lambda lo, hi: edge(k + 1, lo, hi)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _exact_mean(col: str):
    """Mean accumulated in integer micro-degrees: exact and independent of the
    order in which partial sums are merged, so re-executed tasks and other
    partitionings give the identical value."""
    micro = F.rint(F.col(col) * F.lit(1e6)).cast("bigint")
    return F.sum(micro) / F.count(micro) / F.lit(1e6)


def cluster_summary(scored_with_cluster: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Per (day, class, cluster): centre, mean score (negated for normal fires),
    size, marker size and texts (A10, F10-F12)."""
    lab = F.when(F.col("abnormal_label_decay") == 1, F.lit("abnormal")).otherwise(F.lit("normal"))
    g = (scored_with_cluster.withColumn("label", lab)
         .groupBy("acq_date", "label", cluster_col)
         .agg(_exact_mean("latitude").alias("center_lat"), _exact_mean("longitude").alias("center_lon"),
              F.avg("significance_score_decay").alias("_s"), F.count(F.lit(1)).alias("size")))
    s = display.signed_for_label(F.col("_s"), F.col("label"))
    return g.select(
        "acq_date", "label", cluster_col, "center_lat", "center_lon",
        s.alias("mean_significance"), "size", display.marker_size("size").alias("marker_size"),
        display.position_text("Lat", "center_lat").alias("lat_text"),
        display.position_text("Lon", "center_lon").alias("lon_text"),
        display.percent(s).alias("significance_pct"), display.percent_text(s).alias("significance_text"),
        F.when(F.col("label") == "abnormal", F.lit(ABNORMAL_TEXT)).otherwise(F.lit(NORMAL_TEXT))
        .alias("fire_type"),
        F.when(F.col("size") > 1, F.concat(F.lit("Cluster of "), F.col("size").cast("string"),
                                           F.lit(" fires"))).otherwise(F.lit("Single fire"))
        .alias("cluster_size"))


def region_day_layers(regions: DataFrame, weather: DataFrame, start, end) -> DataFrame:
    """Every region x day of [start, end]: cloud opacity (cloud/100, else 0), mean
    temperature (else 0) and the temperature scaled to [0, 1] over the weather
    of the range (J7, F13). The days are generated per region row."""
    days = F.sequence(start, end, F.expr("INTERVAL 1 DAY"))
    grid = regions.select("oblast_id", F.explode(days).alias("acq_date"))
    w = weather.filter(F.col("acq_date").between(start, end))
    tmin = w.select(F.min("t_mean")).scalar()
    tmax = w.select(F.max("t_mean")).scalar()
    first = w.groupBy("oblast_id", "acq_date").agg(
        F.min_by(F.struct("cloud_cover", "t_mean"), F.struct("cloud_cover", "t_mean")).alias("_w"))
    j = grid.join(broadcast_if_small(first), ["oblast_id", "acq_date"], "left")
    temp = F.coalesce(F.col("_w.t_mean"), F.lit(0.0))
    return j.select("oblast_id", "acq_date",
                    F.coalesce(F.col("_w.cloud_cover") / 100, F.lit(0.0)).alias("cloud_opacity"),
                    temp.alias("mean_temperature"),
                    display.min_max_normalise(temp, tmin, tmax).alias("temperature_scaled"))


def overlay_per_day(days: DataFrame, overlays: DataFrame) -> DataFrame:
    """The first overlay (file order) whose [start, end] holds the day."""
    ov = parse_overlays(overlays)
    return first_interval_match(days, ov, ["acq_date"], "acq_date").select(
        "acq_date", "pos", "url", "bounds")


def parse_overlays(overlays: DataFrame) -> DataFrame:
    """``bounds`` text -> array<array<double>>, dates as dates (SC7, F16)."""
    return overlays.select(
        "pos", "url", F.from_json("bounds", "array<array<double>>").alias("bounds"),
        F.col("start_date").cast("date").alias("start_date"),
        F.col("end_date").cast("date").alias("end_date"))


def capped_population(grid: DataFrame, cap: float = POP_DISPLAY_CAP) -> DataFrame:
    """Population density capped for display (PF10)."""
    return grid.select("latitude", "longitude", display.cap("pop_density", cap).alias("pop_density"))


def dominant_land_use(land_use: DataFrame) -> DataFrame:
    """Arg-max land-use class 0..4, the first maximum wins (PF12)."""
    return land_use.select("latitude", "longitude",
                           geo.dominant_class("c0", "c1", "c2", "c3", "c4").alias("land_use_class"))


def reproject_vertices(vertices: DataFrame) -> DataFrame:
    """Web Mercator vertices -> longitude/latitude (F17, SC5)."""
    return vertices.select("id", geo.mercator_to_lon("x").alias("lon"),
                           geo.mercator_to_lat("y").alias("lat"))
