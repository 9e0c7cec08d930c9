"""Distance-time curves with fewer points, within an error of distance or of time."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

from .kernels import fold_by_object

NEAR = 1e-3


def thinned(points: list[tuple[float, float]], error: float, by_time: bool) -> list[int]:
    """Places of the (dist, time) points to keep.

    From the last kept point a cone of slopes holds all lines that stay within the error at each point
    since; a point outside closes it, and the one before is kept. With the error in time a new cone
    begins with the point that closed the old one; with the error in distance, with the one after.
    """
    if not points:
        return []
    kept, low, high = [0], -math.inf, math.inf

    def narrowed(start: tuple[float, float], p: tuple[float, float], low: float, high: float) -> tuple[float, float]:
        d, t = p[0] - start[0], p[1] - start[1]
        if by_time:
            if d <= 0:
                return low, high
            soon, late = t - error, t + error
            return (max(low, d / late) if late > 0 else low), (min(high, d / soon) if soon > 0 else high)
        return (max(low, (d - error) / t), min(high, (d + error) / t)) if t > 0 else (low, high)

    for i in range(1, len(points)):
        start, p = points[kept[-1]], points[i]
        d, t = p[0] - start[0], p[1] - start[1]
        floor, roof = (low * t if low > -math.inf else -math.inf), (high * t if high < math.inf else math.inf)
        slack = 1e-9 * max(1.0, abs(d)) if by_time else NEAR
        if floor - slack <= d <= roof + slack:
            low, high = narrowed(start, p, low, high)
            continue
        kept.append(i - 1)
        low, high = -math.inf, math.inf
        if by_time:
            low, high = narrowed(points[i - 1], p, low, high)
    return [*kept, len(points) - 1]


def angular_compress(curves: DataFrame, error: float, by_time: bool) -> DataFrame:
    """Points (obj, id, dist, time) that are kept; a curve of one point stays as it is."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        keep = sorted(set(thinned(list(zip(rows["dist"].astype(float), rows["time"].astype(float), strict=True)), error, by_time)))
        return rows.iloc[keep][["obj", "id", "dist", "time"]]

    return fold_by_object(curves, kernel, "id int, dist double, time double")
