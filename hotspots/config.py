"""Domain parameters.

Fixed values (must equal the original model configuration for equal results):
  decay_rate = 1.0, decay_midpoint = 5, decay_cutoff = 10 days
  quantile = 0.95, pca_variance = 0.95, calibration_confidence = 0.95
  n_estimators = 100, random_state = 42, n_neighbors = 10
  threshold_candidates = 1000
  grid resolutions: "1km" = 2 decimals, "10km" = 1 decimal, "50km" = nearest 0.5
  Web Mercator sphere radius = 6378137 m
  population density display cap = 250
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

DECAY_RATE = 1.0
DECAY_MIDPOINT = 5.0
DECAY_CUTOFF = 10.0
QUANTILE = 0.95
PCA_VARIANCE = 0.95
CALIBRATION_CONFIDENCE = 0.95
N_ESTIMATORS = 100
RANDOM_STATE = 42
N_NEIGHBORS = 10
THRESHOLD_CANDIDATES = 1000
MERCATOR_RADIUS = 6378137.0
POP_DISPLAY_CAP = 250.0
HIST_BIN_WIDTH = 0.05
RESOLUTIONS = ("1km", "10km", "50km")

# Feature order of the model matrix (rounded cell position, calendar, static
# layers, weather).
FEATURES = ["latitude", "longitude", "day_of_year", "c0", "c1", "c2", "c3", "c4",
            "pop_density", "t_mean", "cloud_cover"]


@dataclass(frozen=True)
class Periods:
    """Chronological train / calibration / test split (TS5)."""

    train: tuple[dt.date, dt.date]
    calibration: tuple[dt.date, dt.date]
    test: tuple[dt.date, dt.date]

    @property
    def start(self) -> dt.date:
        return self.train[0]

    @property
    def end(self) -> dt.date:
        return self.test[1]


# The periods of the original 50 km study.
STUDY_PERIODS = Periods(
    train=(dt.date(2015, 1, 1), dt.date(2021, 2, 23)),
    calibration=(dt.date(2021, 2, 24), dt.date(2022, 2, 23)),
    test=(dt.date(2022, 2, 24), dt.date(2024, 9, 30)),
)

# The same split laid over the 30 days covered by the driver tables.
FIXTURE_PERIODS = Periods(
    train=(dt.date(2024, 1, 1), dt.date(2024, 1, 16)),
    calibration=(dt.date(2024, 1, 17), dt.date(2024, 1, 23)),
    test=(dt.date(2024, 1, 24), dt.date(2024, 1, 30)),
)

FIXTURE_START = FIXTURE_PERIODS.start
FIXTURE_END = FIXTURE_PERIODS.end


@dataclass
class Limits:
    """Size bounds behind every broadcast (rows and estimated bytes) and the
    block size of broadcast query rows in the exact neighbour searches."""

    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 128 * 1024 * 1024
    query_block_rows: int = 4096


LIMITS = Limits()
