"""What algorithms and stores offer, and the algorithms by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import angular, models, sequence, tooling, travel_time
from .graph import shortest_paths
from .kernels import settled


class SegmentIndex(Protocol):
    """Segments of a map by place."""

    def create(self, segments: DataFrame) -> None: ...
    def insert(self, segments: DataFrame) -> None: ...
    def drop(self) -> None: ...
    def near(self, points: DataFrame, radius: float) -> DataFrame: ...
    def closest(self, points: DataFrame, k: int = 1) -> DataFrame: ...


class TrajectoryStorage(Protocol):
    """Stored rows (obj, id, seg, time) and questions to them."""

    def create(self, rows: DataFrame) -> None: ...
    def insert(self, rows: DataFrame) -> None: ...
    def drop(self) -> None: ...
    def where_at(self, queries: DataFrame) -> DataFrame: ...
    def where_at_id(self, queries: DataFrame) -> DataFrame: ...
    def trajectory(self, ranges: DataFrame) -> DataFrame: ...
    def objects_on(self, seg: int, since, until) -> DataFrame: ...
    def objects_near(self, centre: DataFrame, segments: DataFrame, radius: float, since, until) -> DataFrame: ...


class Compressor(Protocol):
    """An algorithm: trained with trajectories (obj, id, seg, time, dist), it keeps less of others."""

    def train(self, traj: DataFrame) -> None: ...
    def compress(self, traj: DataFrame) -> DataFrame: ...


@dataclass
class Options:
    """segments(seg, length) and edges(src, dst, weight) of the map, and the numbers of all algorithms."""

    segments: DataFrame
    edges: DataFrame
    order: int = 2
    longest: int = 10
    min_support: int = 1
    bound: float = 2000.0
    error: float = 60.0
    delay: int | None = None
    iterations: int = 1
    gps_sigma: float = 5.0
    paths: DataFrame | None = None

    def preds(self) -> DataFrame:
        if self.paths is None:
            self.paths = shortest_paths(self.edges, self.bound, strict=True)
        return self.paths

    def measured(self, traj: DataFrame) -> DataFrame:
        return traj.join(self.segments.select("seg", "length"), "seg")


@dataclass
class _Base:
    options: Options
    model: DataFrame | None = None
    times: DataFrame | None = None
    trained: DataFrame | None = field(default=None, repr=False)

    def train(self, traj: DataFrame) -> None:
        self.trained = traj

    def update(self, obj, seg: int, time: int) -> None:
        """A single update of an object: batch algorithms wait for whole ones; see streaming/online.py."""


class FrequentPatterns(_Base):
    def train(self, traj: DataFrame) -> None:
        self.model = settled(models.frequent(traj, self.options.longest, self.options.min_support))

    def compress(self, traj: DataFrame) -> DataFrame:
        return models.pattern_compress(traj, self.model)


class Paths(_Base):
    def compress(self, traj: DataFrame) -> DataFrame:
        return models.path_compress(traj, self.options.preds())


class PathsAndPatterns(_Base):
    def compress(self, traj: DataFrame) -> DataFrame:
        o = self.options
        return models.path_pattern_compress(traj, o.preds(), self.trained, o.longest, o.min_support, o.delay)


class Contexts(_Base):
    def train(self, traj: DataFrame) -> None:
        self.model = settled(models.context_model(traj, self.options.order))

    def compress(self, traj: DataFrame) -> DataFrame:
        return models.context_compress(traj, self.model, self.options.order, self.options.edges)


class _Angular(_Base):
    by_time = True

    def compress(self, traj: DataFrame) -> DataFrame:
        curves = sequence.uniform_times(self.options.measured(traj)).select("obj", "id", F.col("run").alias("dist"), F.col("t").alias("time"))
        return angular.angular_compress(curves, self.options.error, self.by_time)


class TimeError(_Angular):
    by_time = True


class DistanceError(_Angular):
    by_time = False


class TravelTimes(_Base):
    def train(self, traj: DataFrame) -> None:
        o = self.options
        rows = o.measured(traj)
        stats = sequence.speed_stats(sequence.em_windows(rows, o.gps_sigma)).first()
        self.times, _ = travel_time.train(rows, o.segments, stats.avg_speed or 1.0, stats.sigma_trans or 0.0, o.iterations)

    def compress(self, traj: DataFrame) -> DataFrame:
        return travel_time.time_compress(self.options.measured(traj), self.times, self.options.error, self.options.gps_sigma)


class Combined(TravelTimes):
    def train(self, traj: DataFrame) -> None:
        super().train(traj)
        self.model = settled(models.context_model(traj, self.options.order))

    def compress(self, traj: DataFrame) -> DataFrame:
        o = self.options
        flags = models.predicted(traj, self.model, o.order, o.edges).select("obj", "id", (F.col("seg") == F.col("pred")).alias("hit"))
        return travel_time.combined_compress(o.measured(traj), flags, self.times, o.error, o.gps_sigma)


ALGORITHMS: dict[str, Callable[[Options], Compressor]] = {
    "FS": FrequentPatterns,
    "SP": Paths,
    "SPFS": PathsAndPatterns,
    "PPM": Contexts,
    "NSTD": TimeError,
    "TSND": DistanceError,
    "EM": TravelTimes,
    "COMBINED": Combined,
}


def algorithm(name: str, options: Options) -> Compressor:
    """The algorithm of a name; an unknown one is an error."""
    if name not in ALGORITHMS:
        raise ValueError(f"no algorithm {name!r}; there are {', '.join(ALGORITHMS)}")
    return ALGORITHMS[name](options)


def tested(name: str, options: Options, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an algorithm keeps of test after training, and its counters (name, value) with the seconds of both steps."""
    algorithm_ = algorithm(name, options)
    _, t1 = tooling.timed(lambda: algorithm_.train(train))
    kept, t2 = tooling.timed(lambda: algorithm_.compress(test))
    times = test.sparkSession.createDataFrame([("train_time", t1), ("test_time", t2)], "name string, value double")
    return kept, tooling.compression_stats(test, kept).unionByName(times)
