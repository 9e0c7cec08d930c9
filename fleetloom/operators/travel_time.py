"""Travel time of segments: training by expectation and maximisation, filtering, and restoring."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from .kernels import fold_by_object, settled
from .models import context_model
from .sequence import before, em_windows, online_chunks


def maximise(times: DataFrame, segments: DataFrame, avg_speed: float) -> DataFrame:
    """(seg, mu, sigma): mean, and one more than the deviation, of times(seg, x); unseen segments by length."""
    seen = times.groupBy("seg").agg(F.avg("x").alias("mu"), (1 + F.stddev_pop("x")).alias("sigma"))
    every = segments.select("seg", "length").join(seen, "seg", "left")
    return every.select("seg", F.coalesce("mu", F.col("length") / avg_speed).alias("mu"), F.coalesce("sigma", F.col("length") / 5).alias("sigma"))


def solve(mu: np.ndarray, sigma: np.ndarray, lengths: np.ndarray, sigma_trans: float, windows: list[tuple[int, int, float, float]]) -> np.ndarray:
    """The times x >= 0 of a trajectory's segments that fit best.

    Three squares: x to its mean, pace of neighbours to each other, and sums over windows
    (from, to, seconds, sigma) to what was observed. The matrix has all of its own terms on the
    diagonal, so it is positive definite; coordinates that would be negative are held at zero, and
    released when that costs more. A window is a block, and only the ends of neighbouring blocks are
    coupled: elimination goes from block to block, so memory is that of the blocks, not of the whole.
    """
    n = len(mu)
    pace = np.where(lengths > 0, 1 / np.maximum(lengths, 1e-12), 0.0)
    diagonal, g = 1 / sigma**2, mu / sigma**2
    link = np.zeros(max(n - 1, 0))  # between i and i + 1
    if sigma_trans > 0:
        square = pace**2 / sigma_trans**2
        diagonal[1:] += square[1:]
        diagonal[:-1] += square[:-1]
        link = -pace[1:] * pace[:-1] / sigma_trans**2
    cuts = sorted({0, n, *(x for a, b, _, _ in windows for x in (a, b))})
    seen = {(a, b): 1 / noise**2 for a, b, _, noise in windows}
    for a, b, seconds, noise in windows:
        g[a:b] += seconds / noise**2
    spans = [(a, b, seen.get((a, b), 0.0)) for a, b in zip(cuts, cuts[1:], strict=False)]
    blocks = [np.diag(diagonal[a:b]) + np.diag(link[a : b - 1], 1) + np.diag(link[a : b - 1], -1) + w for a, b, w in spans]

    def minimum(free: np.ndarray) -> np.ndarray:
        x, held, carry, told = np.zeros(n), [], 0.0, 0.0
        for k, (a, b, _) in enumerate(spans):
            here = np.flatnonzero(free[a:b])
            matrix, rhs = blocks[k][np.ix_(here, here)], g[a:b][here]
            joint = link[a - 1] if a and free[a - 1] and free[a] else 0.0
            if joint and len(here):
                matrix[0, 0] -= joint**2 * carry
                rhs = rhs.copy()
                rhs[0] -= joint * told
            held.append((a, here, matrix, rhs))
            if len(here):
                last = np.zeros(len(here))
                last[-1] = 1.0
                both = np.linalg.solve(matrix, np.stack([last, rhs], axis=1))
                carry, told = both[-1, 0], both[-1, 1]
        after = 0.0
        for k in range(len(spans) - 1, -1, -1):
            a, here, matrix, rhs = held[k]
            b = spans[k][1]
            if len(here):
                rhs = rhs.copy()
                if b < n and free[b - 1] and free[b]:
                    rhs[-1] -= link[b - 1] * after
                x[a + here] = np.linalg.solve(matrix, rhs)
            after = x[a]
        return x

    def slope(x: np.ndarray) -> np.ndarray:
        out = diagonal * x - g
        out[1:] += link * x[:-1]
        out[:-1] += link * x[1:]
        for a, b, w in spans:
            out[a:b] += w * x[a:b].sum()
        return out

    free = np.ones(n, bool)
    x = np.zeros(n)
    for _ in range(3 * n + 1):
        x = minimum(free)
        if (x < 0).any():
            free &= x >= 0
            continue
        cost = slope(x)
        back = ~free & (cost < -1e-9)
        if not back.any():
            break
        free[np.argmin(np.where(back, cost, 0))] = True
    return np.maximum(x, 0)


def expect(traj: DataFrame, model: DataFrame, sigma_trans: float, gps_sigma: float = DEFAULT.gps_sigma) -> DataFrame:
    """(obj, id, seg, x): each segment's time by solve(). traj needs length; model(seg, mu, sigma) joins by segment."""
    rows = traj.join(model, "seg")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = [i for i, t in enumerate(rows["time"]) if pd.notna(t)]
        empty = pd.DataFrame({"obj": [], "id": [], "seg": [], "x": []})
        if len(at) < 2:
            return empty
        inner = rows.iloc[at[0] + 1 : at[-1] + 1]
        lengths, windows = inner["length"].to_numpy(float), []
        for a, b in zip(at, at[1:], strict=False):
            lo, hi = a - at[0], b - at[0]
            seconds = float(rows["time"].iloc[b] - rows["time"].iloc[a])
            speed = lengths[lo:hi].sum() / seconds if seconds > 0 else 0.0
            windows.append((lo, hi, seconds, 2 * gps_sigma / (speed if speed > 0 else DEFAULT.max_speed)))
        x = solve(inner["mu"].to_numpy(float), inner["sigma"].to_numpy(float), lengths, sigma_trans, windows)
        return pd.DataFrame({"obj": inner["obj"], "id": inner["id"], "seg": inner["seg"], "x": x})

    return fold_by_object(rows, run, "id int, seg int, x double")


def start_times(traj: DataFrame) -> DataFrame:
    """(obj, id, seg, x): the time between observations dealt to segments by length; where training begins. traj needs length."""
    rows = online_chunks(traj).withColumn("_start", F.last("time", ignorenulls=True).over(before())).where("chunk > 0")
    part = Window.partitionBy("obj", "chunk")
    gap = F.max("time").over(part) - F.min("_start").over(part)
    return rows.select("obj", "id", "seg", (gap * F.col("length") / F.sum("length").over(part)).alias("x"))


def objective(traj: DataFrame, times: DataFrame, model: DataFrame, sigma_trans: float, gps_sigma: float = DEFAULT.gps_sigma) -> DataFrame:
    """(value, n): what training lowers, over all of times(obj, id, seg, x): a negative log likelihood up to constants.

    Of each segment's time to its mean, with the log of its deviation; of the change of pace between
    neighbours; and, at each observation, of the sum since the one before to the seconds observed.
    """
    w = Window.partitionBy("obj").orderBy("id")
    seen = em_windows(traj, gps_sigma).select("obj", F.col("id").alias("_at"), "dt", F.col("sigma").alias("noise"))
    rows = times.join(model, "seg").join(traj.select("obj", "id", "length", F.col("time").alias("_t")), ["obj", "id"])
    pace = F.col("x") / F.when(F.col("length") > 0, F.col("length"))
    rows = rows.withColumn("own", F.pow((F.col("x") - F.col("mu")) / F.col("sigma"), 2) / 2 + F.ln("sigma"))
    rows = rows.withColumn("turn", F.coalesce(F.pow((pace - F.lag(pace).over(w)) / sigma_trans, 2) / 2, F.lit(0.0)) if sigma_trans > 0 else F.lit(0.0))
    rows = rows.withColumn("_k", F.coalesce(F.count("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = rows.groupBy("obj", "_k").agg(F.sum("x").alias("x"), F.max(F.when(F.col("_t").isNotNull(), F.col("id"))).alias("_at"))
    misses = sums.join(seen, ["obj", "_at"]).agg(F.sum(F.pow((F.col("x") - F.col("dt")) / F.col("noise"), 2) / 2).alias("miss"))
    whole = rows.agg(F.sum(F.col("own") + F.col("turn")).alias("fit"), F.count("*").alias("n"))
    one = whole.withColumn("_j", F.lit(1)).join(misses.withColumn("_j", F.lit(1)), "_j")
    return one.select((F.coalesce("fit", F.lit(0.0)) + F.coalesce("miss", F.lit(0.0))).alias("value"), "n")


def train(traj: DataFrame, segments: DataFrame, avg_speed: float, sigma_trans: float, iterations: int) -> tuple[DataFrame, list[float]]:
    """The model after so many rounds from start_times(), and the objective after each.

    A round's times are made once and kept; they give the objective and the next model, a row a segment
    of the map.
    """
    model = settled(maximise(start_times(traj), segments, avg_speed))
    values = []
    for _ in range(iterations):
        times = settled(expect(traj, model, sigma_trans))
        model = settled(maximise(times, segments, avg_speed))
        values.append(float(objective(traj, times, model, sigma_trans).first()["value"]))
    return model, values


def train_combined(traj: DataFrame, segments: DataFrame, order: int, avg_speed: float, sigma_trans: float, iterations: int) -> tuple[DataFrame, DataFrame]:
    """The context model and the travel-time model of the combined compressor."""
    return context_model(traj, order), train(traj, segments, avg_speed, sigma_trans, iterations)[0]


def filtered(mu: list[float], sigma: list[float], observed: list[tuple[float, float] | None], start: float, most: float) -> list[tuple[int, float]]:
    """(place, time) of the observations to keep: where what the model says and what it learns from an
    observation, weighed by their variances, differ by more than `most`. Prediction goes on from there."""
    kept = [(0, start)]
    told = fused = start
    ahead = spread = 0.0
    for i in range(1, len(mu)):
        ahead += mu[i]
        spread += sigma[i] ** 2
        if observed[i] is None:
            continue
        seconds, noise = observed[i]
        fused += ahead + spread / (spread + noise**2) * (seconds - ahead)
        told += ahead
        if abs(told - fused) > most:
            kept.append((i, fused))
            told = fused
        ahead = spread = 0.0
    return kept


def _observed(rows: pd.DataFrame, gps_sigma: float) -> list[tuple[float, float] | None]:
    out: list[tuple[float, float] | None] = [None] * len(rows)
    last, run = None, 0.0
    for i, (t, length) in enumerate(zip(rows["time"], rows["length"], strict=True)):
        run += float(length)
        if pd.notna(t):
            if last is not None:
                seconds = float(t - last)
                speed = run / seconds if seconds > 0 else 0.0
                out[i] = (seconds, 2 * gps_sigma / (speed if speed > 0 else DEFAULT.max_speed))
            last, run = t, 0.0
    return out


def time_compress(traj: DataFrame, model: DataFrame, most: float, gps_sigma: float = DEFAULT.gps_sigma) -> DataFrame:
    """(obj, id, seg, time): the first observation, and those that the travel-time model misses by more than `most`.

    Fills before the first observation tell nothing; an object without observations has no rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[_first_seen(rows) :].reset_index(drop=True)
        if not len(rows):
            return pd.DataFrame({"obj": [], "id": [], "seg": [], "time": []})
        kept = filtered(rows["mu"].tolist(), rows["sigma"].tolist(), _observed(rows, gps_sigma), float(rows["time"].iloc[0]), most)
        picked = rows.iloc[[i for i, _ in kept]]
        return picked.assign(time=[t for _, t in kept])[["obj", "id", "seg", "time"]]

    return fold_by_object(traj.join(model, "seg"), run, "id int, seg int, time double")


def _first_seen(rows: pd.DataFrame) -> int:
    """The place of the first observation, or the number of rows."""
    seen = rows["time"].notna().to_numpy()
    return int(seen.argmax()) if seen.any() else len(rows)


def time_restore(traj: DataFrame, model: DataFrame, *by: str) -> DataFrame:
    """(obj, id, seg, time): times of rows without one, between known ones in proportion to the model's means.

    by: further columns that tell pieces of an object apart, which are kept.
    """
    keys = ["obj", *by]
    along_, back = Window.partitionBy(*keys).orderBy("id"), Window.partitionBy(*keys).orderBy(F.desc("id"))
    so_far_ = along_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = traj.join(model.select("seg", "mu"), "seg").withColumn("_k", F.coalesce(F.count("time").over(so_far_), F.lit(0)))
    rows = rows.withColumn("_last", F.last("time", ignorenulls=True).over(so_far_))
    rows = rows.withColumn("_next", F.last("time", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_run", F.sum("mu").over(so_far_))
    part = Window.partitionBy(*keys, "_k")
    rows = rows.withColumn("_begin", F.min("_run").over(part)).withColumn("_own", F.lead("mu").over(along_))
    rows = rows.withColumn("_all", F.max(F.when(F.col("_own").isNotNull(), F.col("_run") + F.col("_own"))).over(part) - F.col("_begin"))
    share = (F.col("_run") - F.col("_begin")) / F.when(F.col("_all") > 0, F.col("_all"))
    filled = F.col("_last") + (F.col("_next") - F.col("_last")) * share
    return rows.select(*keys, "id", "seg", F.coalesce(F.col("time").cast("double"), filled).alias("time"))


def combined_compress(traj: DataFrame, flags: DataFrame, model: DataFrame, most: float, gps_sigma: float = DEFAULT.gps_sigma) -> DataFrame:
    """(obj, id, seg, time) to store: rows whose segment was not predicted, and observations whose time was not.

    flags(obj, id, hit) says whether the context model has a row's segment. Times of stored rows go in
    proportion to the length so far in the window. The first and the last row and the first observation
    are always stored, so nothing at either end is lost; rows before that observation have no time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = _first_seen(rows)
        mu, sigma, lengths = rows["mu"].tolist(), rows["sigma"].tolist(), rows["length"].tolist()
        observed, hit, segs = _observed(rows, gps_sigma), rows["hit"].tolist(), rows["seg"].tolist()
        out = [(i, math.nan) for i in range(min(first, len(rows))) if not i or not hit[i]]
        told = fused = float(rows["time"].iloc[first]) if first < len(rows) else math.nan
        if first < len(rows):
            out.append((first, told))
        pending = []
        ahead = spread = run_ = 0.0
        for i in range(first + 1, len(rows)):
            ahead, spread, run_ = ahead + mu[i], spread + sigma[i] ** 2, run_ + lengths[i]
            if not hit[i]:
                pending.append((i, run_))
            if observed[i] is None:
                continue
            seconds, noise = observed[i]
            gained = ahead + spread / (spread + noise**2) * (seconds - ahead)
            fused += gained
            missed = abs(told + ahead - fused) > most
            step = (fused - told) if missed else ahead
            out += [(j, told + step * r / run_ if run_ else told) for j, r in pending]
            if missed and (not pending or pending[-1][0] != i):
                out.append((i, fused))
            told = fused if missed else told + ahead
            pending, ahead, spread, run_ = [], 0.0, 0.0, 0.0
        out += [(j, told + ahead * r / run_ if run_ else told) for j, r in pending]
        if out[-1][0] != len(rows) - 1:
            out.append((len(rows) - 1, told + ahead))
        return pd.DataFrame({"obj": rows["obj"].iloc[0], "id": [int(rows["id"].iloc[i]) for i, _ in out], "seg": [segs[i] for i, _ in out], "time": [t for _, t in out]})

    kept = fold_by_object(traj.join(flags, ["obj", "id"]).join(model, "seg"), run, "id int, seg int, time double")
    return kept.withColumn("time", F.nanvl("time", F.lit(None).cast("double")))
