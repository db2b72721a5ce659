"""Feature pipeline (E1 / M15): detections -> cell-day features and fire counts.

    fires - distinct - date filter - point in polygon - snap - densify
          - left join static layers - left join daily weather

The result is one lazy DataFrame keyed by (grid_cell, acq_date); keys travel
with the features, nothing depends on row order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspots.functions.calendar import date_lit
from hotspots.functions.scoring import nan_to_null
from hotspots.operators import densify as D
from hotspots.operators.joins import broadcast_if_small
from hotspots.operators.spatial import points_in_polygons
from hotspots.operators.static import static_layers


def filter_dates(df: DataFrame, start, end, col: str = "acq_date") -> DataFrame:
    """Inclusive date range after a cast to date (PF1)."""
    return df.withColumn(col, F.col(col).cast("date")).filter(
        F.col(col).between(date_lit(start), date_lit(end)))


def prepare_fires(fires: DataFrame, start, end, edges: DataFrame | None = None,
                  resolution: str = "50km") -> DataFrame:
    """Distinct detections (by position and day) in [start, end], inside the
    borders, snapped to cells. Any id of the source is left out first: two rows
    of one place and day are one detection."""
    pts = filter_dates(fires, start, end).select("latitude", "longitude", "acq_date").distinct()
    pts = pts.withColumn("day_of_year", F.dayofyear("acq_date"))
    if edges is not None:
        pts = points_in_polygons(pts, edges)
    return D.snap_points(pts, resolution)


def join_context(series: DataFrame, static: DataFrame | None, weather: DataFrame | None) -> DataFrame:
    out = series
    if static is not None:
        # static layers are bounded by the grid, not by the data: checked broadcast
        out = out.join(broadcast_if_small(static), ["latitude", "longitude"], "left")
    if weather is not None:
        out = out.join(broadcast_if_small(weather), ["oblast_id", "acq_date"], "left")
    return out


@dataclass
class DataPipeline:
    """``fit`` builds the static layer; ``transform`` builds features for a window."""

    resolution: str = "50km"
    static: DataFrame | None = None

    def fit(self, *layers: DataFrame) -> "DataPipeline":
        """Build the static layer once: merged, winsorised and checkpointed to
        the shared folder, so every later join reads the finished table."""
        self.static = static_layers(*layers).checkpoint(eager=True)
        return self

    def transform(self, fires: DataFrame, weather: DataFrame | None, start, end,
                  edges: DataFrame | None = None) -> DataFrame:
        snapped = prepare_fires(nan_to_null(fires), start, end, edges, self.resolution)
        series = D.densify(snapped, start, end)
        if weather is not None:
            weather = filter_dates(nan_to_null(weather).distinct(), start, end)
        return join_context(series, self.static, weather)

    def fit_transform(self, layers, fires, weather, start, end, edges=None) -> DataFrame:
        return self.fit(*layers).transform(fires, weather, start, end, edges)
