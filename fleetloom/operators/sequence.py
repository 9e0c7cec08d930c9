"""Operators along a trajectory: rows (obj, id, seg, time, dist); a row without time is a fill."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT
from .kernels import fold_by_object



def along() -> WindowSpec:
    return Window.partitionBy("obj").orderBy("id")


def so_far() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return along().rowsBetween(Window.unboundedPreceding, -1)


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """rows with id: the place within its object, from 0."""
    w = Window.partitionBy("obj").orderBy(*order)
    return rows.withColumn("id", F.row_number().over(w) - 1)


def dedup_runs(traj: DataFrame) -> DataFrame:
    """Of each run of one segment the last row."""
    return traj.withColumn("_next", F.lead("seg").over(along())).where("_next is null or _next <> seg").drop("_next")


def chunk_number() -> Column:
    """Observations strictly before a row: a chunk ends with each observation."""
    return F.coalesce(F.count("time").over(before()), F.lit(0)).cast("long")


def online_chunks(traj: DataFrame) -> DataFrame:
    """traj with chunk; the fills after the last observation are in none."""
    total = F.count("time").over(Window.partitionBy("obj"))
    return traj.withColumn("chunk", chunk_number()).withColumn("_n", total).where("chunk < _n").drop("_n")


def uniform_times(traj: DataFrame, shifted: bool = False) -> DataFrame:
    """Distance so far, and time in proportion to it between observations: (obj, id, seg, run, t).

    traj needs `length`, that of each row's segment. shifted: counts from the window's end and cuts to
    whole units, as old files do.
    """
    rows = online_chunks(traj).withColumn("run", F.sum("length").over(so_far()))
    part = Window.partitionBy("obj", "chunk")
    rows = rows.withColumn("_end", F.max("time").over(part)).withColumn("_all", F.sum("length").over(part))
    rows = rows.withColumn("_own", F.sum("length").over(part.orderBy("id")))
    rows = rows.withColumn("_start", F.last("time", ignorenulls=True).over(before()))
    gap = F.col("_end") - F.col("_start")
    share = gap * F.col("_own") / F.col("_all")
    t = F.floor(F.col("_end") + share).cast("double") if shifted else (F.col("_start") + share).cast("double")
    first = F.col("_start").isNull()
    return rows.select("obj", "id", "seg", "run", F.when(first, F.col("_end").cast("double")).otherwise(t).alias("t"))


def set_times_uniform(traj: DataFrame, shifted: bool = False) -> DataFrame:
    """traj with uniform_times() as its times, in whole units; rows after the last observation go."""
    times = uniform_times(traj, shifted).select("obj", "id", F.floor("t").cast("long").alias("_t"))
    return traj.join(times, ["obj", "id"]).withColumn("time", F.col("_t")).select(*traj.columns)


def renumbered(traj: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("obj").orderBy(*order)
    return traj.withColumn("id", (F.row_number().over(w) - 1).cast("int"))


def appended(traj: DataFrame, more: DataFrame) -> DataFrame:
    """traj with the rows of more after those of the same object; positions go on. Either may lack an object."""
    both = traj.withColumn("_side", F.lit(0)).unionByName(more.select(*traj.columns).withColumn("_side", F.lit(1)))
    return renumbered(both, "_side", "id").drop("_side")


def pushed_front(traj: DataFrame, more: DataFrame) -> DataFrame:
    """traj with the rows of more before those of the same object."""
    return appended(more.select(*traj.columns), traj)


def em_windows(traj: DataFrame, gps_sigma: float = DEFAULT.gps_sigma, idle_speed: float = DEFAULT.max_speed) -> DataFrame:
    """For each observation but the first: length and time since the one before, both so far, and its time error."""
    rows = online_chunks(traj).withColumn("_start", F.last("time", ignorenulls=True).over(before()))
    each = rows.where("chunk > 0").groupBy("obj", "chunk").agg(
        F.max("id").alias("id"), F.sum("length").alias("dist"), F.max("time").alias("_end"), F.max("_start").alias("_start")
    )
    each = each.withColumn("dt", F.col("_end") - F.col("_start"))
    w = Window.partitionBy("obj").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    speed = F.col("dist") / F.when(F.col("dt") > 0, F.col("dt"))
    sigma = 2 * gps_sigma / F.when(speed > 0, speed).otherwise(F.lit(idle_speed))
    return each.select("obj", "id", "dist", "dt", F.sum("dist").over(w).alias("total_dist"), F.sum("dt").over(w).alias("total_time"), sigma.alias("sigma"))


def smooth(rows: DataFrame, column: str, width: int, times: int = 1) -> DataFrame:
    """Centred moving average over width rows to each side, clipped at the ends."""
    for _ in range(times):
        rows = rows.withColumn(column, F.avg(column).over(along().rowsBetween(-width, width)))
    return rows


def speed_stats(windows: DataFrame) -> DataFrame:
    """Over all windows of em_windows(): mean speed, and the root mean square change of its inverse."""
    w = Window.partitionBy("obj").orderBy("id")
    each = windows.where("dist > 0 and dt > 0").withColumn("speed", F.col("dist") / F.col("dt")).withColumn("r", 1 / F.col("speed"))
    each = each.withColumn("d", F.col("r") - F.lag("r", 1, 0.0).over(w))
    return each.agg(F.avg("speed").alias("avg_speed"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("sigma_trans"), F.count("*").alias("n"))


def extend_paths(traj: DataFrame, paths: DataFrame, max_speed: float = DEFAULT.max_speed) -> DataFrame:
    """traj with fills from paths(src, dst, via array, path_length) between rows, where that is not too fast."""
    nxt = traj.withColumn("_seg", F.lead("seg").over(along())).withColumn("_time", F.lead("time").over(along()))
    known = nxt.join(paths, (F.col("seg") == F.col("src")) & (F.col("_seg") == F.col("dst")), "left")
    dt = F.col("_time") - F.col("time")
    fits = (dt > 0) & (F.col("path_length") / dt <= max_speed)
    known = known.withColumn("_via", F.when(fits, F.col("via")).otherwise(F.array().cast("array<int>")))
    own = F.array(F.struct(F.lit(0).alias("k"), F.col("seg").cast("int").alias("seg"), F.col("time"), F.col("dist")))
    fills = F.transform("_via", lambda s, i: F.struct((i + 1).alias("k"), s.alias("seg"), F.lit(None).cast("long").alias("time"), F.lit(None).cast("double").alias("dist")))
    rows = known.select("obj", "id", F.explode(F.concat(own, F.coalesce(fills, F.array().cast("array<struct<k:int,seg:int,time:bigint,dist:double>>")))).alias("r"))
    w = Window.partitionBy("obj").orderBy("_id", "_k")
    flat = rows.select("obj", F.col("id").alias("_id"), F.col("r.k").alias("_k"), "r.seg", "r.time", "r.dist")
    return flat.withColumn("id", F.row_number().over(w) - 1).select("obj", "id", "seg", "time", "dist")


def expand_trajectories(traj: DataFrame, paths: DataFrame, max_speed: float = DEFAULT.max_speed) -> DataFrame:
    """All trajectories with the fills of extend_paths(), of each run of a segment the last row, numbered anew."""
    return renumbered(dedup_runs(extend_paths(traj, paths, max_speed)), "id")


def delay_chunks(traj: DataFrame, delay: int) -> DataFrame:
    """Greedy chunks: a new one starts at the row whose time is over `delay` after the chunk's first."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, start, out = 0, None, []
        for t in rows["time"]:
            if pd.notna(t):
                if start is None:
                    start = t
                elif t - start > delay:
                    chunk, start = chunk + 1, t
            out.append(chunk)
        return rows.assign(chunk=out)[["obj", "id", "seg", "chunk"]]

    return fold_by_object(traj, kernel, "id int, seg int, chunk int")


def break_by_speed(traj: DataFrame, low: float = DEFAULT.min_speed, high: float = DEFAULT.max_speed, most: int | None = DEFAULT.max_piece) -> DataFrame:
    """Pieces of a trajectory whose fills between two observations were driven at a speed in [low, high].

    The speed is that of the fills alone, so observations without fills between them are a break.
    After a break the next pair is not looked at and the gap's fills go; pieces of `most` rows or more
    go, but for the last one. most None: all pieces stay.
    """

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        at = [i for i, t in enumerate(rows["time"]) if pd.notna(t)]
        lengths, times, seen = rows["length"].tolist(), rows["time"].tolist(), []
        pieces, piece, skip = [], at[:1], False
        for a, b in zip(at, at[1:], strict=False):
            fills = list(range(a + 1, b))
            seconds = times[b] - times[a]
            speed = sum(lengths[i] for i in fills) / seconds if seconds > 0 else float("inf")
            if skip or low <= speed <= high:
                piece, skip = piece + fills + [b], False
            else:
                pieces.append(piece)
                piece, skip = [b], True
        pieces = [p for p in pieces if most is None or len(p) < most] + [piece]
        for k, p in enumerate(pieces):
            seen += [(i, k) for i in p]
        picked = rows.iloc[[i for i, _ in seen]]
        return picked.assign(piece=[k for _, k in seen])[["obj", "id", "seg", "piece"]]

    return fold_by_object(traj, kernel, "id int, seg int, piece int")
