"""Planar geometry and emission probabilities as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_008.8


def std_distance(x1: Column, x2: Column, y1: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def rounded(c: Column, digits: int) -> Column:
    """A double of 0 or more to so many digits, halves up, by arithmetic as SQL engines do it.

    F.round() makes a decimal from the text of each number, which takes longer than to find and measure a pair.
    """
    unit = 10.0**digits
    x = c * unit
    whole = F.floor(x)
    return (whole + F.when(x - whole >= 0.5, 1).otherwise(0)) / unit


def project(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """Equirectangular metres around latitude lat0, that of the middle of a map: (north, east)."""
    return F.radians(lat) * EARTH_RADIUS, F.radians(lon) * (EARTH_RADIUS * math.cos(math.radians(lat0)))


def distance_points(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat0: float | None = None) -> Column:
    """Metres between two places; lat0 None: east is measured at the mean latitude of the two."""
    east = F.radians(lon1 - lon2) * (F.cos(F.radians((lat1 + lat2) / 2)) if lat0 is None else F.lit(math.cos(math.radians(lat0))))
    north = F.radians(lat1 - lat2)
    return F.sqrt(east * east + north * north) * EARTH_RADIUS


def share_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a segment its point nearest to p lies, from 0 to 1; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    share = ((px - ax) * dx + (py - ay) * dy) / F.when(squared > 0, squared)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0))


def closest_point(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The point of a segment nearest to p; an end of it is that end exactly, so segments that meet there are as far."""
    return point_at(share_on_segment(px, py, ax, ay, bx, by), ax, ay, bx, by)


def point_at(t: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The point of a segment at a share of it."""
    return F.when(t >= 1, bx).otherwise(ax + t * (bx - ax)), F.when(t >= 1, by).otherwise(ay + t * (by - ay))


def distance_point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    cx, cy = closest_point(px, py, ax, ay, bx, by)
    return std_distance(px, cx, py, cy)


def normal_cdf(z: float) -> float:
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def line_probability(px: float, py: float, ax: float, ay: float, bx: float, by: float, sigma: float, epsilon: float = 2.220446049250313e-16) -> float:
    """Gaussian noise around a point, summed along a segment in units of its profile."""
    length2 = (bx - ax) ** 2 + (by - ay) ** 2
    if length2 == 0:
        return math.exp(-((ax - px) ** 2 + (ay - py) ** 2) / (2 * sigma * sigma)) + epsilon
    along = 2 * ((ax - px) * (bx - ax) + (ay - py) * (by - ay))
    off = (ax - px) ** 2 + (ay - py) ** 2
    scale = 2 * sigma * math.sqrt(length2)
    inside = normal_cdf((2 * length2 + along) / scale) - normal_cdf(along / scale)
    return math.exp((along * along / (4 * length2) - off) / (2 * sigma * sigma)) * inside + epsilon


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of an array, to some 1e-15: its series near 0, a continued fraction beyond, 1 from 6 on."""
    out = np.sign(x)
    size = np.abs(x)
    near = size < 2.5
    z = size[near]
    term = total = z.copy()
    for n in range(1, 80):
        term = term * z * z * 2 / (2 * n + 1)
        total = total + term
    out[near] *= np.exp(-z * z) * total * 2 / math.sqrt(math.pi)
    mid = ~near & (size < 6)  # beyond, what is missing to 1 is less than 1 can tell
    z = size[mid]
    tail = np.zeros_like(z)
    for n in range(60, 0, -1):
        tail = n / 2 / (z + tail)
    out[mid] *= 1 - np.exp(-z * z) / ((z + tail) * math.sqrt(math.pi))
    return out


def line_probabilities(px, py, ax, ay, bx, by, sigma: float, epsilon: float = 2.220446049250313e-16) -> np.ndarray:
    """line_probability() of arrays."""
    dx, dy, ox, oy = bx - ax, by - ay, ax - px, ay - py
    length2, along, off = dx * dx + dy * dy, 2 * (ox * dx + oy * dy), ox * ox + oy * oy
    some = length2 > 0
    safe = np.where(some, length2, 1.0)
    scale = 2 * sigma * np.sqrt(safe)
    inside = 0.5 * (erf((2 * safe + along) / scale / math.sqrt(2)) - erf(along / scale / math.sqrt(2)))
    return np.where(some, np.exp((along * along / (4 * safe) - off) / (2 * sigma * sigma)) * inside, np.exp(-off / (2 * sigma * sigma))) + epsilon


def segment_probability(sigma: float):
    """Arrow function of line_probability(), a batch at a time; Spark has no erf."""

    @F.pandas_udf("double")
    def run(px: pd.Series, py: pd.Series, ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series(line_probabilities(*(v.to_numpy(float) for v in (px, py, ax, ay, bx, by)), sigma))

    return run


def transition_probability(straight: Column, routed: Column, seconds: Column, beta: float = 1.0, time_scale: float = 10.0, epsilon: float = 2.220446049250313e-16) -> Column:
    """Exponential in the difference of straight and routed distance; a missing route leaves epsilon."""
    b = F.lit(beta) + seconds / time_scale
    return F.coalesce(F.exp(-F.abs(straight - routed) / b) / b, F.lit(0.0)) + epsilon
