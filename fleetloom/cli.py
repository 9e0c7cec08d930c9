"""Command line: build a network, precompute paths, match, compress, store and ask."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .operators import graph, matching, registry, tooling
from .operators.store import SegmentStore, TrajectoryStore
from .sources import text


def options_of(spark: SparkSession, a: argparse.Namespace) -> registry.Options:
    segments, edges = text.read_network(spark, a.map)
    paths = text.read_paths(spark, a.paths) if a.paths else None
    return registry.Options(segments.select("seg", "length"), edges, a.order, a.longest, a.min_support, a.bound, a.error, a.delay, a.iterations, paths=paths)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fleetloom", description=__doc__)
    parser.add_argument("command", choices=["index", "paths", "match", "compress", "store", "where-at", "drop"])
    parser.add_argument("--map", help="raw map (index) or network file")
    parser.add_argument("--input", help="positions or trajectories")
    parser.add_argument("--train", help="trajectories to train with")
    parser.add_argument("--queries", help="lines of object and time")
    parser.add_argument("--output", help="file or folder of results")
    parser.add_argument("--paths", help="shortest paths file")
    parser.add_argument("--config", help="lines of a setting and its value")
    parser.add_argument("--algorithm", default="PPM", choices=sorted(registry.ALGORITHMS))
    parser.add_argument("--table", default="traj", help="table of the store")
    parser.add_argument("--raw", action="store_true", help="store all rows instead of compressed ones")
    parser.add_argument("--partial", action="store_true", help="ask compressed rows by partial decompression")
    parser.add_argument("--order", type=int, default=2)
    parser.add_argument("--longest", type=int, default=10, help="segments of a pattern at most")
    parser.add_argument("--min-support", type=int, default=1)
    parser.add_argument("--bound", type=float, default=DEFAULT.path_bound, help="metres of a shortest path at most")
    parser.add_argument("--error", type=float, default=60.0, help="seconds or metres of error")
    parser.add_argument("--delay", type=int, help="seconds that an update may wait")
    parser.add_argument("--iterations", type=int, default=1)
    parser.add_argument("--extend", action="store_true", help="fill in shortest paths between matched points")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("fleetloom").getOrCreate()
    config = Config.of(text.read_config(spark, a.config)) if a.config else DEFAULT
    if a.command == "index":
        segments = text.read_raw_map(spark, a.map)
        text.write_network(segments, graph.adjacency(segments), a.output)
        SegmentStore(spark, f"{a.table}_segments").create(segments)
    elif a.command == "paths":
        _, edges = text.read_network(spark, a.map)
        text.write_paths(graph.shortest_paths(edges, a.bound, strict=True), a.output)
    elif a.command == "match":
        segments, _ = text.read_network(spark, a.map)
        ends = segments.withColumns({"p_begin": F.struct("lat_b", "lon_b"), "p_end": F.struct("lat_e", "lon_e")})
        points = text.read_gps(spark, a.input, text.network_lat0(segments))
        text.write_trajectories(matching.map_match(points, ends, a.extend, config, a.bound), a.output)
    elif a.command == "compress":
        rows, train = text.read_trajectories(spark, a.input), text.read_trajectories(spark, a.train or a.input)
        kept, stats = registry.tested(a.algorithm, options_of(spark, a), train, rows)
        kept.write.mode("overwrite").parquet(a.output)
        stats.show(truncate=False)
    elif a.command == "store":
        rows, store = text.read_trajectories(spark, a.input), TrajectoryStore(spark, a.table)
        options = options_of(spark, a)
        store.drop()
        if a.raw:
            _, seconds = tooling.timed(lambda: store.insert_raw(options.measured(rows)))
        else:
            models = registry.algorithm("COMBINED", options)
            models.train(text.read_trajectories(spark, a.train or a.input))
            for name, model in (("contexts", models.model), ("times", models.times)):
                model.write.mode("overwrite").saveAsTable(f"{a.table}_{name}")
            _, seconds = tooling.timed(lambda: store.insert_compressed(options.measured(rows), models.model, models.times, a.order, a.error, options.edges))
        for name, value in tooling.store_stats(rows.count(), store.rows().count(), seconds).items():
            print(f"{name} = {value}")
    elif a.command == "drop":
        TrajectoryStore(spark, a.table).drop()
        SegmentStore(spark, f"{a.table}_segments").drop()
        for name in ("contexts", "times"):
            spark.sql(f"DROP TABLE IF EXISTS {a.table}_{name}")
    else:
        store, asked = TrajectoryStore(spark, a.table), text.read_queries(spark, a.queries)
        if spark.catalog.tableExists(f"{a.table}_contexts"):
            _, edges = text.read_network(spark, a.map)
            ask = store.where_at_part if a.partial else store.where_at_restored
            found = ask(asked, spark.table(f"{a.table}_contexts"), spark.table(f"{a.table}_times"), a.order, edges)
        else:
            found = store.where_at(asked)
        n, seconds = asked.count(), tooling.timed_queries(found, a.output)
        print(f"num_queries = {n}\nqueries_second = {n / max(seconds, 1e-9)}")


if __name__ == "__main__":
    main()
