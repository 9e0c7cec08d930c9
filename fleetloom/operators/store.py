"""Tables of a map and of stored rows (obj, id, seg, time), and questions to them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import project
from .joins import as_of, in_range, nearest, objects_on_segment, within_distance
from .kernels import object_type, settled
from .models import context_decompress, decompressor, predicted
from .sequence import set_times_uniform
from .travel_time import combined_compress, time_restore


class SegmentStore:
    """The segments of a map as a table with a grid cell, which files are sorted by, and questions by place."""

    def __init__(self, spark: SparkSession, name: str = "segments", cell: float = 1000.0, lat0: float = 0.0):
        self.spark, self.name, self.cell, self.lat0 = spark, name, cell, lat0

    def _placed(self, segments: DataFrame) -> DataFrame:
        cx, cy = (F.floor(F.least(a, b) / self.cell).alias(c) for a, b, c in (("ax", "bx", "cx"), ("ay", "by", "cy")))
        return segments.select("seg", "ax", "ay", "bx", "by", "length", cx, cy).repartitionByRange("cx", "cy").sortWithinPartitions("cx", "cy")

    def create(self, segments: DataFrame) -> None:
        self._placed(segments).write.mode("overwrite").format("parquet").saveAsTable(self.name)

    def insert(self, segments: DataFrame) -> None:
        self._placed(segments).write.mode("append").format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def points(self, places: DataFrame) -> DataFrame:
        """places(pid, lat, lon) in the metres of the map: (pid, x, y)."""
        x, y = project(F.col("lat"), F.col("lon"), self.lat0)
        return places.select("pid", x.alias("x"), y.alias("y"))

    def near(self, points: DataFrame, radius: float) -> DataFrame:
        """(pid, seg, d): segments within a radius of points(pid, x, y)."""
        return within_distance(points, self.rows(), radius)

    def closest(self, points: DataFrame, k: int = 1) -> DataFrame:
        return nearest(points, self.rows(), k, self.cell)


class TrajectoryStore:
    """Rows in a table bucketed by object and sorted by time, so questions by object read their buckets only."""

    def __init__(self, spark: SparkSession, name: str = "traj", buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.select("obj", "id", "seg", F.col("time").cast("double").alias("time")).write.mode(mode).format("parquet")
        writer.bucketBy(self.buckets, "obj").sortBy("time", "id").saveAsTable(self.name)

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "overwrite")

    def insert(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def insert_raw(self, traj: DataFrame) -> None:
        """Appends all rows of trajectories (with length), fills with the times of uniform speed."""
        self._write(set_times_uniform(traj), "append")

    def insert_compressed(self, traj: DataFrame, model: DataFrame, times: DataFrame, order: int, most: float, neighbours: DataFrame | None = None) -> None:
        """Appends what the combined compressor keeps of trajectories (with length); those of one row as they are."""
        flags = predicted(traj, model, order, neighbours).select("obj", "id", (F.col("seg") == F.col("pred")).alias("hit"))
        self._write(combined_compress(traj, flags, times, most), "append")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def where_at(self, queries: DataFrame) -> DataFrame:
        """queries(qid, obj, at): the stored row at or before a time; nulls if there is none."""
        return as_of(self.rows(), queries, "time", "id")

    def where_at_id(self, queries: DataFrame) -> DataFrame:
        return as_of(self.rows(), queries, "id", "time")

    def trajectory(self, ranges: DataFrame) -> DataFrame:
        return in_range(self.rows(), ranges)

    def objects_on(self, seg: int, since, until) -> DataFrame:
        return objects_on_segment(self.rows(), seg, since, until)

    def objects_near(self, centre: DataFrame, segments: DataFrame, radius: float, since, until) -> DataFrame:
        """Objects on any segment within a radius of centre(pid, x, y) in a time range."""
        near = within_distance(centre, segments, radius).select("seg").distinct()
        return self.rows().where(F.col("time").between(since, until)).join(near, "seg", "left_semi").select("obj").distinct()

    def where_at_restored(self, queries: DataFrame, model: DataFrame, times: DataFrame, order: int, neighbours: DataFrame | None = None) -> DataFrame:
        """where_at() on compressed rows: the objects that are asked about are decompressed first, in segments and times."""
        asked = self.rows().join(queries.select("obj").distinct(), "obj", "left_semi")
        return as_of(restored(asked, model, times, order, neighbours), queries, "time", "id")

    def where_at_part(self, queries: DataFrame, model: DataFrame, times: DataFrame, order: int, neighbours: DataFrame | None = None) -> DataFrame:
        """The answers of where_at_restored() from the stretches of objects alone that queries fall into."""
        return where_at_part(self.rows(), queries, model, times, order, neighbours)


def restored(kept: DataFrame, model: DataFrame, times: DataFrame, order: int, neighbours: DataFrame | None = None) -> DataFrame:
    """(obj, id, seg, time): all rows of compressed trajectories."""
    full = context_decompress(kept.select("obj", "id", "seg"), model, order, neighbours)
    known = full.join(kept.select("obj", "id", "time"), ["obj", "id"], "left")
    return time_restore(known, times)


def pieces(kept: DataFrame, queries: DataFrame, order: int) -> DataFrame:
    """(obj, piece, id, seg, time): of compressed rows, the stretches that are needed to restore what queries fall into.

    Stored times may go back where the compressor corrected itself, so stretches end only at stored rows
    that nothing before is later than and nothing after is earlier; a query falls into the one from the
    last such row at or before its time to the next. What the model predicts there depends on the
    `order` segments before; where that many neighbours are stored, or at the beginning, nothing before
    them is needed. So a piece goes from the last such place to the end of the stretch; queries of one
    stretch share it.
    """
    w, back = Window.partitionBy("obj").orderBy("id"), Window.partitionBy("obj").orderBy(F.desc("id"))
    run = kept.withColumn("_g", F.col("id") - F.row_number().over(w))
    run = run.withColumn("_n", F.row_number().over(Window.partitionBy("obj", "_g").orderBy("id")))
    whole = (F.col("_n") >= order) | (F.col("id") == F.col("_n") - 1)
    begin = F.when(whole, F.greatest(F.col("id") - order + 1, F.lit(0)))
    timed = F.col("time").isNotNull()
    marked = run.withColumn("_begin", F.last(begin, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = marked.withColumn("_before", F.max("time").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_after", F.min("time").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The first row with a time opens a stretch too, one that holds from the earliest time of all.
    opens = timed & (F.col("_before").isNull() | ((F.col("_before") <= F.col("time")) & (F.col("time") == F.col("_after"))))
    marked = marked.withColumn("_opens", opens)
    marked = marked.withColumn("_end", F.coalesce(F.last(F.when(F.col("_opens"), F.col("id")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.max(F.when(timed, F.col("id"))).over(Window.partitionBy("obj"))))
    anchors = marked.where("_opens").select("obj", "id", F.col("_after").alias("time"), "_begin", "_end")
    found = as_of(anchors, queries.select("qid", "obj", "at"), "time", "id").where("id is not null")
    spans = found.groupBy("obj", F.col("_begin").alias("piece")).agg(F.max("_end").alias("_until"))
    return kept.join(spans, "obj").where((F.col("id") >= F.col("piece")) & (F.col("id") <= F.col("_until"))).select("obj", "piece", "id", "seg", "time")


def where_at_part(kept: DataFrame, queries: DataFrame, model: DataFrame, times: DataFrame, order: int, neighbours: DataFrame | None = None) -> DataFrame:
    """(qid, obj, at, id, seg, time): where objects were at a time, from compressed rows and partial decompression."""
    part, run = settled(pieces(kept, queries, order)), decompressor(model, order, neighbours)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["piece", "id"], kind="stable")
        found, ids, segs = [], rows["id"].tolist(), rows["seg"].tolist()
        begins = [*(~rows["piece"].duplicated()).to_numpy().nonzero()[0].tolist(), len(rows)]
        for a, b in zip(begins, begins[1:], strict=False):
            found.append((rows["piece"].iloc[a], *run(ids[a:b], segs[a:b])))
        out = pd.DataFrame({"piece": [p for p, i, _ in found for _ in i], "id": [x for _, i, _ in found for x in i], "seg": [x for *_, s in found for x in s]})
        return out.assign(obj=rows["obj"].iloc[0])[["obj", "piece", "id", "seg"]]

    full = part.groupBy("obj").applyInPandas(kernel, f"obj {object_type(kept)}, piece int, id int, seg int")
    known = full.join(part.select("obj", "piece", "id", "time"), ["obj", "piece", "id"], "left")
    rows = time_restore(known, times, "piece").where("time is not null").groupBy("obj", "id").agg(F.min("seg").alias("seg"), F.min("time").alias("time"))
    return as_of(settled(rows), queries, "time", "id")
