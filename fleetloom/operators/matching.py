"""Map matching by a hidden Markov model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.geometry import line_probabilities, share_on_segment, std_distance, transition_probability
from .graph import adjacency, routes, shortest_paths
from .joins import by_cell, nearest
from .kernels import object_type, settled
from .sequence import along, expand_trajectories


#: Points of a cell that go to one group, and pairs that are measured at once.
MOST_POINTS, MOST_PAIRS = 2048, 1 << 17
#: From so many sigmas on, what line_probability() adds to epsilon is less than a double of its size can tell.
FAR_SIGMAS = 13.0


def best_of(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float, sigma: float, k: int, epsilon: float = DEFAULT.epsilon) -> tuple[np.ndarray, ...]:
    """(point, segment, share of the probability of all segments within radius, share of the way): the k most probable of each point, of equals the first."""
    n, m = len(px), len(ax)
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    safe = np.where(squared > 0, squared, 1.0)
    total, least = np.zeros(n), np.zeros(n)  # least: of the k best so far, 0 while there are fewer
    point, way, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    more: list[tuple[np.ndarray, ...]] = []
    step = max(1, MOST_PAIRS // max(n, 1))
    near_radius = min(radius, FAR_SIGMAS * sigma)
    for a in range(0, m if n else 0, step):
        b = min(a + step, m)
        x, y = px[:, None], py[:, None]
        t = np.clip(((x - ax[a:b]) * dx[a:b] + (y - ay[a:b]) * dy[a:b]) / safe[a:b], 0.0, 1.0)
        ex = x - np.where(t >= 1, bx[a:b], ax[a:b] + t * dx[a:b])
        ey = y - np.where(t >= 1, by[a:b], ay[a:b] + t * dy[a:b])
        d = np.sqrt(ex * ex + ey * ey)
        within, near = d <= radius, d <= near_radius
        i, j = np.nonzero(near)
        j = j + a
        p = line_probabilities(px[i], py[i], ax[j], ay[j], bx[j], by[j], sigma, epsilon)
        far = within & ~near
        total += np.bincount(i, p, n) + epsilon * far.sum(1)
        good = p > least[i]
        more.append((i[good], j[good], p[good]))
        short = np.flatnonzero(least < epsilon)
        if len(short):
            i, j = np.nonzero(far[short])
            more.append((short[i], j + a, np.full(len(i), epsilon)))
        if len(short) or b == m or sum(len(x[0]) for x in more) > 2 * k * n:
            point, way, raw = (np.concatenate(x) for x in zip((point, way, raw), *more, strict=True))
            more = []
            order = np.lexsort((way, -raw, point))
            point, way, raw = point[order], way[order], raw[order]
            first = np.searchsorted(point, np.arange(n))
            rank = np.arange(len(point)) - first[point]
            full = rank == k - 1
            least[point[full]] = raw[full]
            point, way, raw = point[rank < k], way[rank < k], raw[rank < k]
    x, y = px[point], py[point]
    t = np.clip(((x - ax[way]) * dx[way] + (y - ay[way]) * dy[way]) / safe[way], 0.0, 1.0)
    return point, way, raw / total[point], t


def _nullable(kind: pa.DataType) -> pa.DataType:
    """A type as Spark reads it from a schema in words, where all fields can be null."""
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def candidates(points: DataFrame, segments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(pid, seg, p, offset): the most probable segments near each point, or the nearest one if none is near.

    Probabilities are shares of all segments within the radius, and stay so when only the best are kept.
    """
    radius = config.radius_sigmas * config.sigma
    shape = segments.select("seg", "ax", "ay", "bx", "by", "length")
    # Pairs are measured where they meet, by cell, and only the best leave it: all of them, a square of the
    # input, would be sorted on disk. A cell with many points is dealt to several groups.
    own, box = by_cell(points.select("pid", "x", "y"), shape, radius)
    cells = own.groupBy("cx", "cy").agg(F.ceil(F.count("*") / MOST_POINTS).cast("int").alias("_n"))
    own = own.join(cells, ["cx", "cy"]).withColumn("_c", F.pmod(F.xxhash64("pid"), F.col("_n")).cast("int")).drop("_n")
    box = box.join(cells, ["cx", "cy"]).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [side.repartition(n, "cx", "cy", "_c").groupBy("cx", "cy", "_c") for side in (own, box)]

    def run(near: pa.Table, ways: pa.Table) -> pa.Table:
        ways = ways.sort_by("seg")
        x, y = (near[c].to_numpy() for c in ("x", "y"))
        ends = [ways[c].to_numpy() for c in ("ax", "ay", "bx", "by")]
        point, way, share, offset = best_of(x, y, *ends, radius, config.sigma, config.max_candidates)
        return pa.table({"pid": near["pid"].take(point).cast(_nullable(near.schema.field("pid").type)), "seg": ways["seg"].take(way), "p": share, "offset": offset * ways["length"].to_numpy()[way]})

    kinds = [points.schema["pid"].dataType.simpleString(), segments.schema["seg"].dataType.simpleString()]
    best = settled(sides[0].cogroup(sides[1]).applyInArrow(run, f"pid {kinds[0]}, seg {kinds[1]}, p double, offset double"))
    offset = (share_on_segment(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")]) * F.col("length")).alias("offset")
    far = settled(points.join(best.select("pid").distinct(), "pid", "left_anti"))
    lone = nearest(far, segments, 1, 2 * radius).select("pid", "seg")
    single = lone.join(shape, "seg").join(far.select("pid", "x", "y"), "pid").withColumn("p", F.lit(1.0))
    return best.unionByName(single.select("pid", "seg", "p", offset))


def viterbi(steps: list[list[int]], emission: list[list[float]], transition: list[dict[tuple[int, int], float]]) -> list[int]:
    """The most probable candidate of each step. Of equals the later predecessor and the later candidate."""
    cost = [-math.log(p) for p in emission[0]]
    back: list[list[int]] = []
    for t in range(1, len(steps)):
        now, from_ = [], []
        for j, b in enumerate(steps[t]):
            best, at = math.inf, 0
            for i, a in enumerate(steps[t - 1]):
                c = cost[i] - math.log(transition[t].get((a, b), DEFAULT.epsilon))
                if c <= best:
                    best, at = c, i
            now.append(best - math.log(emission[t][j]))
            from_.append(at)
        cost = now
        back.append(from_)
    last = min(range(len(cost)), key=lambda i: (cost[i], -i))
    way = [last]
    for from_ in reversed(back):
        way.append(from_[way[-1]])
    return [steps[t][i] for t, i in enumerate(reversed(way))]


def map_match(gps: DataFrame, segments: DataFrame, extend: bool = False, config: Config = DEFAULT, bound: float | None = None) -> DataFrame:
    """gps(obj, id, time, x, y) on segments(seg, p_begin, p_end, ax, ay, bx, by, length): (obj, id, seg, time, dist).

    extend: fills in shortest paths between neighbouring points and keeps the last row of each run of a
    segment. bound: of the paths that are searched, as a length; None is that of config. Objects keep
    the type of their ids.
    """
    bound = config.path_bound if bound is None else bound
    points = gps.withColumn("pid", F.struct("obj", "id"))
    near = candidates(points.select("pid", "x", "y"), segments, config)
    found = near.join(points.select("pid", "time", "x", "y"), "pid").select("pid.obj", "pid.id", "seg", "p", "offset", "time", "x", "y")
    found = settled(found)  # read by three joins
    edges = adjacency(segments)
    routes_ = shortest_paths(edges, bound, found.select(F.col("seg").alias("src")).distinct())
    cur = found.select("obj", "id", F.col("seg").alias("s2"), F.col("offset").alias("o2"), F.col("time").alias("t2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    prev = found.select("obj", (F.col("id") + 1).alias("id"), F.col("seg").alias("s1"), F.col("offset").alias("o1"), F.col("time").alias("t1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    steps = prev.join(cur, ["obj", "id"]).join(routes_.select(F.col("src").alias("s1"), F.col("dst").alias("s2"), "d"), ["s1", "s2"], "left")
    routed = F.when(F.col("s1") == F.col("s2"), F.abs(F.col("o2") - F.col("o1"))).otherwise(F.col("d") - F.col("o1") + F.col("o2"))
    straight = std_distance(F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"))
    p = transition_probability(straight, routed, F.col("t2") - F.col("t1"), config.beta, config.time_scale)
    ways = steps.select(F.col("obj").alias("o"), "id", F.col("s1").cast("long"), F.col("s2").cast("long"), p.alias("p"))

    def run(cands: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        if not len(cands):
            return pd.DataFrame({"obj": [], "id": [], "seg": [], "time": [], "dist": []})
        cands = cands.sort_values(["id", "p", "seg"], ascending=[True, False, True], kind="stable")
        ids = sorted(cands["id"].unique())
        by = {i: g for i, g in cands.groupby("id")}
        moved: dict[int, dict[tuple[int, int], float]] = {}
        for i, a, b, q in zip(moves["id"], moves["s1"], moves["s2"], moves["p"], strict=True):
            moved.setdefault(i, {})[a, b] = q
        way = viterbi([by[i]["seg"].tolist() for i in ids], [by[i]["p"].tolist() for i in ids], [moved.get(i, {}) for i in ids])
        rows = [by[i][by[i]["seg"] == s].iloc[0] for i, s in zip(ids, way, strict=True)]
        return pd.DataFrame({"obj": [r["obj"] for r in rows], "id": ids, "seg": way, "time": [r["time"] for r in rows], "dist": [r["offset"] for r in rows]})

    matched = found.groupBy("obj").cogroup(ways.groupBy("o")).applyInPandas(run, f"obj {object_type(gps)}, id int, seg int, time long, dist double")
    if not extend:
        return matched
    matched = settled(matched)
    ahead = matched.select(F.col("seg").alias("src"), F.lead("seg").over(along()).alias("dst")).where("dst is not null and src <> dst")
    own = segments.select(F.col("seg").cast("long").alias("src"), F.col("length").alias("_own"))
    ways = routes(edges, ahead, bound).join(own, "src").select("src", "dst", F.col("via").cast("array<int>").alias("via"), (F.col("d") - F.col("_own")).alias("path_length"))
    return expand_trajectories(matched, ways, config.max_speed)
