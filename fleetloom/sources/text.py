"""Text formats of maps, positions, trajectories, paths, questions and answers.

Lines are comma-separated without names; empty lines are skipped, and the last one needs no line end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EPOCH_SHIFT
from ..functions.geometry import EARTH_RADIUS, project, std_distance
from ..operators.kernels import numbered


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, f): the fields of each line, with a number that follows the order in a file."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    return raw.where("value <> ''").select("line", F.split("value", ",").alias("f"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, f): lines of a small file with sections, from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    return whole.where("trim(value) <> ''").select("n", F.split("value", ",").alias("f"))


def _shifted(time: Column, epoch_shift: bool) -> Column:
    return F.when(time < EPOCH_SHIFT, time + EPOCH_SHIFT).otherwise(time) if epoch_shift else time


def middle(lats: DataFrame) -> float:
    """The mean latitude of lats(lat, ...), for project(); 0 without any."""
    return float(lats.agg(F.avg("lat")).first()[0] or 0.0)


def read_raw_map(spark: SparkSession, path: str, lat0: float | None = None) -> DataFrame:
    """segments of a raw map: a count line, points (id, lat, lon), segments (id, p1, p2, dir).

    dir 0 is two-way and gives a second segment, named -1 and the id; segments without length go.
    Metres are those around latitude lat0, by default the mean of the map's points, which comes along.
    """
    rows = _numbered(spark, path)
    points_n, segments_n = (int(x) for x in rows.where("n = 0").first()["f"][:2])
    points = rows.where(F.col("n").between(1, points_n)).select(F.col("f")[0].alias("p"), F.col("f")[1].cast("double").alias("lat"), F.col("f")[2].cast("double").alias("lon"))
    lat0 = middle(points) if lat0 is None else lat0
    raw = rows.where((F.col("n") > points_n) & (F.col("n") <= points_n + segments_n) & (F.size("f") >= 4))
    ways = F.struct(F.lit(0).alias("back"), F.col("f")[0].alias("name"), F.col("f")[1].alias("p1"), F.col("f")[2].alias("p2"))
    back = F.struct(F.lit(1).alias("back"), F.concat(F.lit("-1"), F.col("f")[0]).alias("name"), F.col("f")[2].alias("p1"), F.col("f")[1].alias("p2"))
    two = F.trim(F.col("f")[3]) == "0"
    each = raw.select("n", two.alias("two_way"), F.explode(F.when(two, F.array(ways, back)).otherwise(F.array(ways))).alias("w")).select("n", "two_way", "w.*")
    ends = lambda c: points.select(F.col("p").alias(c), F.col("lat").alias(f"lat_{c}"), F.col("lon").alias(f"lon_{c}"))
    known = each.join(ends("p1"), "p1").join(ends("p2"), "p2").where("lat_p1 <> lat_p2 or lon_p1 <> lon_p2")
    (ax, ay), (bx, by) = project(F.col("lat_p1"), F.col("lon_p1"), lat0), project(F.col("lat_p2"), F.col("lon_p2"), lat0)
    placed = numbered(known.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by}), "seg", "n", "back")
    return placed.select(F.col("seg").cast("int").alias("seg"), "name", F.col("p1").alias("p_begin"), F.col("p2").alias("p_end"), F.col("lat_p1").alias("lat_b"), F.col("lat_p2").alias("lat_e"), F.col("lon_p1").alias("lon_b"), F.col("lon_p2").alias("lon_e"), "ax", "ay", "bx", "by", "two_way", std_distance(F.col("ax"), F.col("bx"), F.col("ay"), F.col("by")).alias("length"), F.lit(lat0).alias("lat0"))


def network_lat0(segments: DataFrame) -> float:
    """The latitude around which a network's metres are measured: of its metres east to the degrees, where any has some."""
    ends = segments.where("abs(lon_b) > 1e-6").select((F.col("ay") / F.radians("lon_b") / EARTH_RADIUS).alias("c"))
    share = ends.agg(F.avg("c")).first()[0]
    return math.degrees(math.acos(min(1.0, max(-1.0, share)))) if share is not None else 0.0


def write_network(segments: DataFrame, edges: DataFrame, path: str) -> None:
    """A count line, twelve fields for each segment, then each segment's neighbours."""
    out = edges.groupBy(F.col("src").alias("seg")).agg(F.array_sort(F.collect_list("dst")).alias("to"))
    every = segments.join(out, "seg", "left")
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in ("seg", "lat_b", "lat_e", "lon_b", "lon_e", "ax", "bx", "ay", "by")], F.col("two_way").cast("int").cast("string"), F.col("length").cast("string"), "name")
    near = F.concat_ws(",", F.col("seg").cast("string"), F.array_join(F.coalesce("to", F.array().cast("array<int>")).cast("array<string>"), ","))
    lines = every.select(F.lit(1).alias("k"), F.col("seg").alias("s"), row.alias("value")).union(every.select(F.lit(2), "seg", F.rtrim(near)))
    head = segments.agg(F.lit(0).alias("k"), F.lit(0).alias("s"), F.count("*").cast("string").alias("value")).select("k", "s", "value")
    lines.union(head).orderBy("k", "s").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, edges) of a network file; segments need all twelve fields."""
    rows = _numbered(spark, path)
    n = int(rows.where("n = 0").first()["f"][0])
    f = F.col("f")
    kinds = [("seg", "int"), ("lat_b", "double"), ("lat_e", "double"), ("lon_b", "double"), ("lon_e", "double"), ("ax", "double"), ("bx", "double"), ("ay", "double"), ("by", "double")]
    segments = rows.where((F.col("n").between(1, n)) & (F.size("f") == 12)).select(*[f[i].cast(t).alias(c) for i, (c, t) in enumerate(kinds)], (f[9] == "1").alias("two_way"), f[10].cast("double").alias("length"), f[11].alias("name"))
    near = rows.where(F.col("n") > n).select(f[0].cast("int").alias("src"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("d")).where("trim(d) <> ''")
    edges = near.select("src", F.col("d").cast("int").alias("dst")).join(segments.select(F.col("seg").alias("src"), F.col("length").alias("weight")), "src")
    return segments, edges


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst): the neighbours of a network file alone, whatever its segments' lines hold."""
    rows = _numbered(spark, path)
    n = int(rows.where("n = 0").first()["f"][0])
    near = rows.where(F.col("n") > n).select(F.trim(F.col("f")[0]).cast("int").alias("src"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("d"))
    return near.where("trim(d) <> ''").select("src", F.trim("d").cast("int").alias("dst"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(seg, length, name) of a network file: the first field and the last two of each segment's line."""
    rows = _numbered(spark, path)
    n = int(rows.where("n = 0").first()["f"][0])
    f = F.col("f")
    return rows.where(F.col("n").between(1, n)).select(f[0].cast("int").alias("seg"), F.element_at(f, -2).cast("double").alias("length"), F.element_at(f, -1).alias("name"))


def read_segments_of_objects(spark: SparkSession, path: str) -> DataFrame:
    """(obj, id, seg): all segments of trajectory lines, fills and observations alike, as they are named."""
    return read_trajectories(spark, path, epoch_shift=False, raw=True).select("obj", "id", F.col("name").alias("seg"))


def _gps(rows: DataFrame, lat0: float) -> DataFrame:
    f = F.col("f")
    rows = rows.where(F.size("f") >= 5).withColumns({"obj": f[0], "lat": f[1].cast("double"), "lon": f[2].cast("double"), "time": f[4].cast("long")})
    x, y = project(F.col("lat"), F.col("lon"), lat0)
    return rows.withColumns({"x": x, "y": y}).drop("f")


def read_gps(spark: SparkSession, path: str, lat0: float | None = None) -> DataFrame:
    """(obj, id, time, lat, lon, x, y) of lines obj,lat,lon,ignored,epoch; in order of time, then of lines.

    lat0: that of the network the points are matched with; by default the mean of the points.
    """
    lines = _lines(spark, path)
    if lat0 is None:
        lat0 = middle(lines.where(F.size("f") >= 5).select(F.col("f")[1].cast("double").alias("lat")))
    place = F.row_number().over(Window.partitionBy("obj").orderBy("time", "line")) - 1
    return _gps(lines, lat0).select("obj", place.alias("id"), "time", "lat", "lon", "x", "y")


def stream_gps(spark: SparkSession, path: str, lat0: float) -> DataFrame:
    """Files of position lines as a stream: (obj, time, ts, lat, lon, x, y)."""
    raw = spark.readStream.text(path).where("trim(value) <> ''").select(F.split("value", ",").alias("f"))
    return _gps(raw, lat0).select("obj", "time", F.timestamp_seconds("time").alias("ts"), "lat", "lon", "x", "y")


def read_trajectories(spark: SparkSession, path: str, names: DataFrame | None = None, epoch_shift: bool = True, strict: bool = True, raw: bool = False) -> DataFrame:
    """(obj, id, seg, time, dist) of lines obj,seg[,seg...],time,dist: all segments but a line's last are fills.

    names(name, seg) turns names to numbers; a name that is missing there is an error, or a null seg if
    not strict. raw: names as they are, in a column of that name.
    """
    f, size = F.col("f"), F.size("f")
    rows = _lines(spark, path).where(size >= 4).select("line", f[0].alias("obj"), _shifted(F.element_at("f", -2).cast("long"), epoch_shift).alias("t"), F.element_at("f", -1).cast("double").alias("d"), F.posexplode(F.slice("f", F.lit(2), size - 3)).alias("pos", "name"), (size - 4).alias("last"))
    place = F.row_number().over(Window.partitionBy("obj").orderBy("line", "pos")) - 1
    mine = F.col("pos") == F.col("last")
    each = rows.select("obj", place.alias("id"), "name", F.when(mine, F.col("t")).alias("time"), F.when(mine, F.col("d")).alias("dist"))
    if raw:
        return each
    if names is None:
        return each.select("obj", "id", F.col("name").cast("int").alias("seg"), "time", "dist")
    known = each.join(names.select("name", "seg"), "name", "left")
    if strict:
        known = known.withColumn("seg", F.coalesce("seg", F.raise_error(F.concat(F.lit("no segment is named "), "name")).cast("int")))
    return known.select("obj", "id", "seg", "time", "dist")


def write_trajectories(traj: DataFrame, path: str) -> None:
    """A line for each observation, with the fills before it; fills after the last one have no line."""
    from ..operators.sequence import online_chunks

    rows = online_chunks(traj)
    line = rows.groupBy("obj", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "seg"))).alias("s"), F.max("time").alias("t"), F.max("dist").alias("d"))
    value = F.concat_ws(",", F.col("obj").cast("string"), F.array_join(F.transform("s", lambda x: x["seg"].cast("string")), ","), F.col("t").cast("string"), F.col("d").cast("string"))
    line.sort("obj", "chunk").select(value.alias("value")).write.mode("overwrite").text(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, pred); of several lines for one pair the first."""
    f = F.col("f")
    rows = _lines(spark, path).select("line", *[f[i].cast("int").alias(c) for i, c in enumerate(("src", "dst", "pred"))])
    return rows.groupBy("src", "dst").agg(F.min_by("pred", "line").alias("pred"))


def write_paths(paths: DataFrame, path: str) -> None:
    paths.where("pred is not null").select("src", "dst", "pred").write.mode("overwrite").csv(path)


def read_queries(spark: SparkSession, path: str, epoch_shift: bool = True) -> DataFrame:
    """(qid, obj, at) of lines obj,time."""
    f = F.col("f")
    return _lines(spark, path).select(F.col("line").alias("qid"), f[0].alias("obj"), _shifted(f[1].cast("long"), epoch_shift).alias("at"))


def write_results(found: DataFrame, path: str) -> None:
    """obj,query time,segment,time; a miss is written as 0,0."""
    found.select("obj", "at", F.coalesce("seg", F.lit(0)).alias("seg"), F.coalesce("time", F.lit(0)).alias("time")).write.mode("overwrite").csv(path)


def dump_trajectories(traj: DataFrame, segments: DataFrame, path: str) -> None:
    """segment name,time,id."""
    traj.join(segments.select("seg", "name"), "seg").sort("obj", "id").select("name", "time", "id").write.mode("overwrite").csv(path)


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """Lines of a key and a value, from wherever Spark reads."""
    lines = [r.value.split(None, 1) for r in spark.read.text(path).collect()]
    return {x[0]: x[1].strip() for x in lines if len(x) == 2}
