"""As-of, interval, distance and nearest-neighbour joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point_at, share_on_segment, std_distance
from .kernels import settled


def as_of(rows: DataFrame, queries: DataFrame, on: str, tie: str, buckets: int = 16) -> DataFrame:
    """For each of queries(qid, obj, at) the row of its object with the largest `on` <= at, of equals the largest tie.

    Rows and queries go through one window by object and part of the range of `on`, whose last row so
    far is the answer; an object with very many rows is dealt to `buckets` tasks. What a part's rows
    leave open is the last row of the parts before, which one aggregate with partial results gives.
    No such row, or a query without object or time: nulls.
    """
    names = [c for c in rows.columns if c != "obj"]
    low, high = rows.agg(F.min(on).cast("double"), F.max(on).cast("double")).first()
    part = lambda c: F.least(F.greatest(F.floor((c.cast("double") - (low or 0.0)) / max(((high or 0.0) - (low or 0.0)) / buckets, 1e-9)), F.lit(-1)), F.lit(buckets)).cast("int")
    held = rows.where(F.col(on).isNotNull()).select("obj", F.col(on).alias("_at"), F.lit(0).alias("_q"), F.col(tie).cast("long").alias("_tie"), F.lit(None).cast("long").alias("qid"), F.struct(*names).alias("_row"))
    kind, time = held.schema["_row"].dataType, held.schema["_at"].dataType
    held = held.withColumn("_b", part(F.col("_at")))
    asked = queries.select("obj", F.col("at").alias("_at"), F.lit(1).alias("_q"), F.lit(0).cast("long").alias("_tie"), F.col("qid").cast("long"), F.lit(None).cast(kind).alias("_row"))
    asked = asked.withColumn("_b", F.coalesce(part(F.col("_at")), F.lit(-1)))
    # The last row of each part, carried to the later parts that hold queries.
    last = held.groupBy("obj", "_b").agg(F.max(F.struct("_at", "_tie", "_row")).alias("_last"))
    needed = asked.select("obj", "_b").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
    carried = last.withColumn("_need", F.lit(False)).unionByName(needed.withColumn("_need", F.lit(True)))
    # A part's own last row comes after its queries' carrier, so only earlier parts are before it.
    by_part = Window.partitionBy("obj").orderBy("_b", F.col("_need").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("_from", F.last("_last", ignorenulls=True).over(by_part)).where("_need and _from is not null")
    carried = carried.select("obj", F.col("_from._at").alias("_at"), F.lit(0).alias("_q"), F.col("_from._tie").alias("_tie"), F.lit(None).cast("long").alias("qid"), F.col("_from._row").alias("_row"), "_b")
    w = Window.partitionBy("obj", "_b").orderBy(F.col("_at").asc_nulls_first(), "_q", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = held.unionByName(carried).unionByName(asked).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_q = 1")
    return found.select("qid", "obj", F.col("_at").cast(queries.schema["at"].dataType).alias("at"), *[F.col(f"_row.{n}").alias(n) for n in names])


def in_range(rows: DataFrame, ranges: DataFrame, on: str = "time") -> DataFrame:
    """Rows of each of ranges(qid, obj, since, until), both ends included.

    Rows and ranges meet by object and stretch of time, a stretch as long as an eighth of the longest
    range, so no object's rows meet all of its ranges.
    """
    longest = ranges.agg(F.max(F.col("until").cast("double") - F.col("since").cast("double"))).first()[0] or 0.0
    width = max(longest / 8, 1.0)
    part = lambda c: F.floor(F.col(c).cast("double") / width)
    dealt = ranges.where("since <= until").withColumn("_b", F.explode(F.sequence(part("since"), part("until"))))
    return rows.withColumn("_b", part(on)).join(dealt, ["obj", "_b"]).where(F.col(on).between(F.col("since"), F.col("until"))).drop("_b", "since", "until")


def objects_on_segment(rows: DataFrame, seg, since, until) -> DataFrame:
    """Objects that were on a segment in a time range."""
    return rows.where((F.col("seg") == seg) & F.col("time").between(since, until)).select("obj").distinct()


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def by_cell(points: DataFrame, segments: DataFrame, radius: float, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and segments with the grid cells (cx, cy) where those at most radius apart meet: a point has one."""
    size = size or radius
    reach = radius * (1 + 1e-6)  # cells and lines take in a little more than the distances that decide
    box = segments.withColumn("cx", F.explode(_cells(F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach, size)))
    # In a column of cells only the rows that the part of the segment near it reaches.
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = lambda x: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("ax")) / F.when(dx != 0, dx))), F.lit(0.0))
    a, b = (F.col("ay") + share(x) * dy for x in (F.col("cx") * size - reach, (F.col("cx") + 1) * size + reach))
    low = F.when(dx == 0, F.least("ay", "by")).otherwise(F.least(a, b))
    high = F.when(dx == 0, F.greatest("ay", "by")).otherwise(F.greatest(a, b))
    box = box.withColumn("cy", F.explode(_cells(low - reach, high + reach, size)))
    own = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    return own, box


def close_pairs(points: DataFrame, segments: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """points(pid, x, y) with segments(seg, ax, ay, bx, by) at most radius away: the columns of both, and d.

    Segments are listed under the grid cells along their way, wider by the radius; a point has one cell,
    so a pair meets once and nothing is compared outside its cell. Of those that meet, most that are too
    far are told by the distance to the segment's line. size: of a cell; None is the radius.
    """
    own, box = by_cell(points, segments, radius, size)
    reach = radius * (1 + 1e-6)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    off = (F.col("x") - F.col("ax")) * dy - (F.col("y") - F.col("ay")) * dx
    # Dealt by number: what meets is far more than what is sent, by which Spark would put it all in a task.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = own.repartition(n, "cx", "cy").join(box.repartition(n, "cx", "cy"), ["cx", "cy"]).where(off * off <= (dx * dx + dy * dy) * (reach * reach))
    # Step by step, and kept out of the join by a column that no filter is moved below: as one expression the
    # share is written out eight times, a method so long that the JVM only interprets it.
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    steps = met.withColumn("_t", share_on_segment(F.col("x"), F.col("y"), *ends)).withColumn("_p", F.spark_partition_id())
    near = steps.withColumns(dict(zip(("_x", "_y"), point_at(F.col("_t"), *ends), strict=True)))
    d = std_distance(F.col("x"), F.col("_x"), F.col("y"), F.col("_y"))
    return near.withColumn("d", d).where((F.col("d") <= radius) & (F.col("_p") >= 0)).drop("cx", "cy", "_t", "_p", "_x", "_y")


def within_distance(points: DataFrame, segments: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """close_pairs() as (pid, seg, d)."""
    return close_pairs(points.select("pid", "x", "y"), segments.select("seg", "ax", "ay", "bx", "by"), radius, size).select("pid", "seg", "d")


def _start_radius(points: DataFrame, segments: DataFrame, k: int, radius: float) -> tuple[float, float]:
    """A radius to begin a search with, radius at most, and one that reaches from any point to any segment.

    Small cells list a segment often, large ones compare a point with many; the work of both is least
    where about one point lies in a cell. With few segments the radius is that in which k are found.
    The area is that of the points without the outermost twentieths, as a few that are far off say nothing.
    """
    span = segments.agg(*[F.min(F.least(a, b)) for a, b in (("ax", "bx"), ("ay", "by"))], *[F.max(F.greatest(a, b)) for a, b in (("ax", "bx"), ("ay", "by"))], F.sum(std_distance(F.col("ax"), F.col("bx"), F.col("ay"), F.col("by")))).first()
    reach = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*"), *[F.percentile_approx(c, [0.05, 0.95]) for c in ("x", "y")]).first()
    if reach[0] is None or span[0] is None:
        return radius, 0.0
    far = sum(max(span[i + 2], reach[i + 2]) - min(span[i], reach[i]) for i in (0, 1))
    area = (reach[5][1] - reach[5][0]) * (reach[6][1] - reach[6][0])
    if area > 0:
        fit = max(math.sqrt(area / reach[4]) / 2, k * area / (2 * span[4]) if span[4] > 0 else radius)
        radius = min(radius, fit)
    return radius, far


def nearest(points: DataFrame, segments: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest segments of each point: (pid, seg, d, rank); of equals the smaller segment.

    Radii begin by the density of the points, at the given one at most, and grow fourfold, each round for
    the points that still have fewer than k; one that has k within a radius has its k nearest there. A
    map with fewer than k segments gives them all.
    """
    n = segments.limit(k).count()
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("d", "seg"))
    if not n or points.isEmpty():
        return within_distance(points, segments, radius).withColumn("rank", F.lit(1)).limit(0)
    radius, far = _start_radius(points, segments, k, radius)
    open_, done = points, []
    while True:
        found = settled(within_distance(open_, segments, radius, 2 * radius).withColumn("rank", rank).where(F.col("rank") <= k))
        full = found.withColumn("_n", F.count("*").over(Window.partitionBy("pid"))).where(F.col("_n") >= n).drop("_n")
        done.append(full)
        if radius > far:
            break
        open_ = settled(open_.join(full.select("pid").distinct(), "pid", "left_anti"))
        if open_.isEmpty():
            break
        radius *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
