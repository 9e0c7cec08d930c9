"""Folds, sampled questions, counters, and synthetic movement."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import MOST_LOCAL_EDGES, _is_local, dijkstra
from .kernels import numbered
from .sequence import before, online_chunks

T = TypeVar("T")


def folds(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """(obj, fold): objects dealt in turn, in the order of their first row."""
    first = rows.groupBy("obj").agg(F.min(order).alias("_first"))
    return numbered(first, "_k", "_first", "obj").select("obj", (F.col("_k") % n).cast("int").alias("fold"))


def sample_queries(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(qid, obj, at): n rows drawn with replacement."""
    held = numbered(rows.select("obj", "time"), "_k", "obj", "time")
    total = held.count()
    draws = rows.sparkSession.range(n).select(F.col("id").alias("qid"), F.floor(F.rand(seed) * total).alias("_k"))
    return draws.join(held, "_k").select("qid", "obj", F.col("time").alias("at"))


def compression_stats(original: DataFrame, kept: DataFrame) -> DataFrame:
    """(name, value): updates before and after, trajectories, ratio."""
    a = original.agg(F.count("*").alias("orig"), F.count_distinct("obj").alias("objects"))
    b = kept.agg(F.count("*").alias("comp"))
    one = a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j")
    values = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("num_updates_orig", "num_updates_comp", "num_traj", "compression_ratio")]),
        F.array(F.col("orig").cast("double"), F.col("comp").cast("double"), F.col("objects").cast("double"), F.col("orig") / F.col("comp")),
    )
    return one.select(F.explode(values).alias("name", "value"))


def timed(work: Callable[[], T]) -> tuple[T, float]:
    """What work returns, and the seconds it took."""
    began = time.perf_counter()
    return work(), time.perf_counter() - began


def store_stats(n_original: int, n_inserted: int, insert_seconds: float, n_queries: int = 0, query_seconds: float = 0.0) -> dict[str, float]:
    """The report of a store: rows before and after, their ratio, rows inserted and questions answered a second."""
    share = lambda a, b: a / b if b else 0.0
    return {
        "num_updates_orig": float(n_original),
        "num_updates_inserted": float(n_inserted),
        "compression_ratio": share(n_original, n_inserted),
        "insert_time": insert_seconds,
        "inserts_second": share(n_original, insert_seconds),
        "num_queries": float(n_queries),
        "query_time": query_seconds,
        "queries_second": share(n_queries, query_seconds),
    }


def timed_queries(answers: DataFrame, path: str) -> float:
    """Writes answers to questions, and the seconds that took."""
    from ..sources.text import write_results

    return timed(lambda: write_results(answers, path))[1]


def drive_stats(drives: DataFrame) -> DataFrame:
    """(avg_speed, sigma_speed, sigma_trans, n) of drives(obj, id, seg, speed, length): mean and deviation of speeds, and the
    root mean square change of time on a segment from one to the next."""
    w = Window.partitionBy("obj").orderBy("id")
    each = drives.withColumn("_t", F.col("length") / F.col("speed"))
    each = each.withColumn("_d", F.col("_t") - F.lag("_t").over(w))
    return each.agg(F.avg("speed").alias("avg_speed"), F.stddev_pop("speed").alias("sigma_speed"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("sigma_trans"), F.count("*").alias("n"))


def travel_times(drives: DataFrame) -> DataFrame:
    """(obj, id, seg, x): time on each segment of drives(obj, id, seg, speed, length)."""
    return drives.select("obj", "id", "seg", (F.col("length") / F.col("speed")).alias("x"))


def travel_times_of_updates(traj: DataFrame) -> DataFrame:
    """(obj, id, seg, x): the time since the update before dealt evenly to the segments of an update.

    The first update of an object counts from 0.
    """
    rows = online_chunks(traj).withColumn("_start", F.last("time", ignorenulls=True).over(before()))
    part = Window.partitionBy("obj", "chunk")
    gap = F.max("time").over(part) - F.coalesce(F.max("_start").over(part), F.lit(0))
    return rows.select("obj", "id", "seg", (gap / F.count("*").over(part)).alias("x"))


def segment_times(times: DataFrame, segments: DataFrame) -> DataFrame:
    """(seg, mu, sigma) of times(seg, x): mean and deviation, the latter a little over 0; 0 where none was seen."""
    least = math.sqrt(2.220446049250313e-16)
    seen = times.groupBy("seg").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))
    return segments.select("seg").join(seen, "seg", "left").select("seg", F.coalesce("mu", F.lit(0.0)).alias("mu"), (F.coalesce("sigma", F.lit(0.0)) + least).alias("sigma"))


def write_updates(traj: DataFrame, segments: DataFrame, path: str) -> None:
    """Trajectory lines with segment names: a line for each update, with the fills before it, its time and the segment's length."""
    rows = online_chunks(traj).join(segments.select("seg", "name", "length"), "seg")
    line = rows.groupBy("obj", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "name", "length"))).alias("s"), F.max("time").alias("t"))
    value = F.concat_ws(",", F.col("obj").cast("string"), F.array_join(F.transform("s", lambda x: x["name"]), ","), F.col("t").cast("string"), F.element_at("s", -1)["length"].cast("string"))
    line.sort("obj", "chunk").select(value.alias("value")).write.mode("overwrite").text(path)


def synthetic(segments: DataFrame, edges: DataFrame, n: int, gap: int, seed: int = 1, walk: bool = True, steps: int = 50, rate: float = 1e-5, speed: tuple[float, float] = (15.0, 4.0), own_sigma: float = 1.0, width: int = 0, times: int = 1, drives: bool = False) -> DataFrame:
    """(obj, id, seg, time, dist): n objects that drive by random walk, or on shortest paths to targets.

    Each segment has a speed from a normal distribution `speed` (mean, deviation), each pass one around
    it with own_sigma, and those of a drive are smoothed by a centred mean of `width` to each side, `times`
    over. An update is sent each `gap` seconds; segments between updates are fills. drives: (obj, id,
    seg, speed, length) instead. The map goes to the tasks, after a look at its size.
    """
    spark = segments.sparkSession
    if not _is_local(edges):
        raise ValueError(f"a map of over {MOST_LOCAL_EDGES} edges: drive on a part of it")
    shape = {int(r.seg): float(r.length) for r in segments.select("seg", "length").collect()}
    ways: dict[int, list[int]] = {}
    for r in edges.select("src", "dst").orderBy("src", "dst").collect():
        ways.setdefault(int(r.src), []).append(int(r.dst))
    names = sorted(shape)
    place = {s: i for i, s in enumerate(names)}
    heads = [[place[d] for d in ways.get(s, [])] for s in names]
    indptr = [0, *itertools.accumulate(map(len, heads))]
    flat = list(itertools.chain.from_iterable(heads))
    weights = [shape[s] for s, h in zip(names, heads, strict=True) for _ in h]

    def route(rng: random.Random) -> list[int]:
        at = rng.choice(names)
        if walk:
            out = [at]
            while len(out) < steps and ways.get(out[-1]):
                out.append(rng.choice(ways[out[-1]]))
            return out
        dist, pred = dijkstra(indptr, flat, weights, place[at], float("inf"))
        wanted = rng.expovariate(rate)
        node = min(dist, key=lambda v: (abs(dist[v] - wanted), v))
        out = [node]
        while out[-1] in pred:
            out.append(pred[out[-1]])
        return [names[i] for i in reversed(out)]

    def speeds(way: list[int], rng: random.Random) -> list[float]:
        out = [max(1.0, random.Random(seed * 7 + s).gauss(*speed) + rng.gauss(0, own_sigma)) for s in way]
        for _ in range(times if width else 0):
            out = [sum(x := out[max(0, i - width) : i + width + 1]) / len(x) for i in range(len(out))]
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for obj in part["id"]:
                rng = random.Random(seed * 1_000_003 + int(obj))
                clock, due = 0.0, 0.0
                way = route(rng)
                for i, (seg, v) in enumerate(zip(way, speeds(way, rng), strict=True)):
                    if drives:
                        rows.append((int(obj), i, seg, v, shape[seg]))
                        continue
                    begin, clock = clock, clock + shape[seg] / v
                    if due < clock or i == len(way) - 1:
                        at = min(max(due, begin), clock)
                        rows.append((int(obj), i, seg, int(at), (at - begin) * v))
                        due = at + gap
                    else:
                        rows.append((int(obj), i, seg, None, None))
            if drives:
                yield pd.DataFrame(rows, columns=["obj", "id", "seg", "speed", "length"])
            else:
                yield pd.DataFrame(rows, columns=["obj", "id", "seg", "time", "dist"]).astype({"time": "Int64"})

    return spark.range(n).mapInPandas(run, "obj long, id int, seg int, speed double, length double" if drives else "obj long, id int, seg int, time long, dist double")
