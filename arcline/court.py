"""Court dimensions and thresholds, centre-origin coordinates (net at y = 0)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CourtSpec:
    # Singles court in metres.
    half_width: float = 4.115
    half_length: float = 11.885
    net_y: float = 0.0
    net_height: float = 0.914
    service_line: float = 6.4
    baseline_zone: float = 6.885  # within 5 m of a baseline
    in_margin: float = 0.15
    net_zone: float = 1.5


COURT = CourtSpec()
FPS = 25.0
GRAVITY = 9.81


def to_centre_origin(df: DataFrame, x: str = "x", y: str = "y", court: CourtSpec = COURT) -> DataFrame:
    """Convert corner-origin rows to the centre-origin system used everywhere here."""
    return df.withColumns({x: F.col(x) - court.half_width, y: F.col(y) - court.half_length})


def in_court(x: Column, y: Column, margin: float = 0.0, court: CourtSpec = COURT) -> Column:
    return (F.abs(x) <= court.half_width + margin) & (F.abs(y) <= court.half_length + margin)
