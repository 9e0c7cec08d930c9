"""The segment graph: adjacency, hops, bounded shortest paths, PageRank, entropy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import settled

#: Edges that go to executors as arrays, 16 bytes each; larger maps relax by joins.
MOST_LOCAL_EDGES = 20_000_000


def adjacency(segments: DataFrame) -> DataFrame:
    """segments(seg, p_begin, p_end, length) -> edges (src, dst, weight): dst begins where src ends; weight is src's length."""
    a, b = segments.alias("a"), segments.alias("b")
    on = (F.col("a.p_end") == F.col("b.p_begin")) & (F.col("a.seg") != F.col("b.seg"))
    return a.join(b, on).select(F.col("a.seg").alias("src"), F.col("b.seg").alias("dst"), F.col("a.length").alias("weight"))


def adjacent(pairs: DataFrame, edges: DataFrame, apart: bool = False) -> DataFrame:
    """Of pairs(src, dst) those that an edge joins; apart: those that none does."""
    return pairs.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti" if apart else "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, degree, to): each segment's ways out, ascending."""
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("degree"), F.sort_array(F.collect_set("dst")).alias("to"))


def hops(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """(src, node, hops): what each source reaches in at most k steps, itself included."""
    seen = front = sources.select("src", F.col("src").alias("node"), F.lit(0).alias("hops")).distinct()
    step = edges.select(F.col("src").alias("node"), F.col("dst")).distinct()
    for i in range(1, k + 1):
        ahead = front.join(step, "node").select("src", F.col("dst").alias("node")).distinct()
        front = ahead.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("hops", F.lit(i))
        seen = seen.unionByName(front)
    return seen


def dijkstra(indptr: np.ndarray, heads: np.ndarray, weights: np.ndarray, source: int, bound: float, targets: set[int] | None = None) -> tuple[dict[int, float], dict[int, int]]:
    """Distances up to bound and predecessors; of equal ways the one over the smaller predecessor.

    targets: the search ends when all of them are reached; only what it has reached then is final.
    """
    dist, pred, done, queue = {source: 0.0}, {}, set(), [(0.0, source)]
    left = set(targets) if targets is not None else None
    while queue:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        if left is not None:
            left.discard(u)
            if not left:
                break
        for i in range(indptr[u], indptr[u + 1]):
            v, w = int(heads[i]), d + float(weights[i])
            if w > bound or v in done:
                continue
            if w < dist.get(v, np.inf) or (w == dist[v] and u < pred.get(v, u + 1)):
                dist[v], pred[v] = w, u
                heapq.heappush(queue, (w, v))
    return dist, pred


def _shared_graph(edges: DataFrame):
    """A map as arrays on all executors: node names, and each node's ways out. Its size is checked by the callers."""
    table = edges.select("src", "dst", "weight").toPandas()
    names = np.unique(np.concatenate([table["src"], table["dst"]])) if len(table) else np.zeros(0, np.int64)
    at = np.searchsorted(names, table["src"].to_numpy())
    order = np.argsort(at, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(names)))]).astype(int)
    heads, weights = np.searchsorted(names, table["dst"].to_numpy())[order], table["weight"].to_numpy()[order]
    return edges.sparkSession.sparkContext.broadcast((names, indptr, heads, weights))


def _is_local(edges: DataFrame) -> bool:
    return edges.limit(MOST_LOCAL_EDGES + 1).count() <= MOST_LOCAL_EDGES


def shortest_paths(edges: DataFrame, bound: float, sources: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(src, dst, d, pred) for every pair at most bound apart; a source itself has d 0 and no pred.

    strict: pairs less than bound apart, and no source itself. A map of up to MOST_LOCAL_EDGES goes to
    the executors as arrays, and sources are spread over tasks. A larger one is relaxed by joins until
    nothing changes.
    """
    spark = edges.sparkSession
    if strict:
        return shortest_paths(edges, bound, sources).where((F.col("d") < bound) & (F.col("src") != F.col("dst")))
    if not _is_local(edges):
        return _relaxed(edges, bound, sources)
    shared = _shared_graph(edges)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, indptr, heads, weights = shared.value
        for part in parts:
            rows = []
            for src in part["src"]:
                i = int(np.searchsorted(names, src))
                if i == len(names) or names[i] != src:
                    rows.append((src, src, 0.0, None))
                    continue
                dist, pred = dijkstra(indptr, heads, weights, i, bound)
                rows += [(src, int(names[v]), d, int(names[pred[v]]) if v in pred else None) for v, d in dist.items()]
            yield pd.DataFrame(rows, columns=["src", "dst", "d", "pred"]).astype({"pred": "Int64"})

    sources = sources if sources is not None else edges.select("src").union(edges.select("dst")).distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sources.select(F.col("src").cast("long")).repartition(n).mapInPandas(run, "src long, dst long, d double, pred long")


def routes(edges: DataFrame, pairs: DataFrame, bound: float = float("inf")) -> DataFrame:
    """(src, dst, d, via) of the pairs(src, dst) that are asked for: searches from a source end when its targets are reached.

    via has the segments between, both ends left out. No way within bound: no row. A map of more than
    MOST_LOCAL_EDGES is relaxed by joins from the sources instead.
    """
    asked = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()
    if not _is_local(edges):
        known = path_table(_relaxed(edges, bound, asked.select("src").distinct())).select("src", "dst", "d", F.col("via").cast("array<bigint>").alias("via"))
        return known.join(asked, ["src", "dst"])
    shared = _shared_graph(edges)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names, indptr, heads, weights = shared.value
        place = {int(x): int(i) for x, i in zip(part["dst"], np.searchsorted(names, part["dst"]), strict=True) if i < len(names) and names[i] == x}
        src = int(part["src"].iloc[0])
        i = int(np.searchsorted(names, src))
        if i == len(names) or names[i] != src:
            return pd.DataFrame({"src": [], "dst": [], "d": [], "via": []})
        dist, pred = dijkstra(indptr, heads, weights, i, bound, set(place.values()))
        rows = []
        for dst, j in place.items():
            if j in dist:
                via, at = [], j
                while pred.get(at, i) != i:
                    at = pred[at]
                    via.append(int(names[at]))
                rows.append((src, dst, dist[j], via[::-1]))
        return pd.DataFrame(rows, columns=["src", "dst", "d", "via"])

    return asked.groupBy("src").applyInPandas(run, "src long, dst long, d double, via array<bigint>")


def _relaxed(edges: DataFrame, bound: float, sources: DataFrame | None) -> DataFrame:
    """Shortest paths by joins, round by round, until no distance and no predecessor changes."""
    sources = sources if sources is not None else edges.select("src").union(edges.select("dst")).distinct()
    sources = sources.select(F.col("src").cast("long"))
    best = sources.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("pred"), F.lit(True).alias("new"))
    step = settled(edges.select(F.col("src").cast("long").alias("dst"), F.col("dst").cast("long").alias("to"), "weight"))
    while True:
        # Only what changed in the round before can shorten anything now.
        ahead = best.where("new").join(step, "dst").select("src", F.col("to").alias("dst"), (F.col("d") + F.col("weight")).alias("d"), F.col("dst").alias("pred")).where(F.col("d") <= bound)
        both = best.select("src", "dst", "d", "pred", F.lit(True).alias("old")).unionByName(ahead.withColumn("old", F.lit(False)))
        way = F.struct("d", "pred")
        found = both.groupBy("src", "dst").agg(F.min(way).alias("b"), F.min(F.when(F.col("old"), way)).alias("o"))
        changed = F.col("o").isNull() | (F.col("o.d") != F.col("b.d")) | ~F.col("o.pred").eqNullSafe(F.col("b.pred"))
        best = settled(found.select("src", "dst", "b.d", "b.pred", changed.alias("new")))
        if best.where("new").isEmpty():
            return best.drop("new")


def path_table(paths: DataFrame) -> DataFrame:
    """(src, dst, via, path_length, d): the segments between, both ends left out, and their length.

    All paths from a source are walked together, the nearest ends first, each from that of its
    predecessor. What one source reaches is bounded by the bound of paths.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        src, via, rows = int(part["src"].iloc[0]), {}, []
        part = part[part["pred"].notna()].sort_values(["d", "dst"], kind="stable")
        own = float(part.loc[part["pred"] == src, "d"].min())
        open_ = [(int(t), float(d), int(p)) for t, d, p in zip(part["dst"], part["d"], part["pred"], strict=True)]
        while open_:  # once more only for predecessors as far away as their ends
            later = []
            for dst, d, p in open_:
                if p == src or p in via:
                    via[dst] = [] if p == src else [*via[p], p]
                    rows.append((src, dst, via[dst], d - own, d))
                else:
                    later.append((dst, d, p))
            if len(later) == len(open_):
                raise ValueError(f"paths from {src} have a predecessor without a path")
            open_ = later
        return pd.DataFrame(rows, columns=["src", "dst", "via", "path_length", "d"])

    known = paths.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("d").cast("double"), F.col("pred").cast("long"))
    return known.groupBy("src").applyInPandas(run, "src long, dst long, via array<int>, path_length double, d double")


def point_distance(pairs: DataFrame, paths: DataFrame, segments: DataFrame) -> DataFrame:
    """Distance on the road for pairs(pid, s1, o1, s2, o2) of segments and offsets: (pid, distance).

    On one segment the difference of offsets; else the way from begin to begin, less o1, plus o2. No way: null.
    """
    known = pairs.join(paths.select(F.col("src").alias("s1"), F.col("dst").alias("s2"), "d"), ["s1", "s2"], "left")
    way = F.when(F.col("s1") == F.col("s2"), F.abs(F.col("o2") - F.col("o1"))).otherwise(F.col("d") - F.col("o1") + F.col("o2"))
    return known.select("pid", way.alias("distance"))


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds from equal ranks; what ends have goes to all alike."""
    links = settled(edges.select("src", "dst").distinct())
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    n = nodes.count()
    out = links.groupBy("src").agg(F.count("*").alias("deg"))
    shares = links.join(out, "src")
    stuck = nodes.join(out, nodes.node == out.src, "left_anti")
    loose = stuck.count() > 0
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(iterations):
        given = shares.join(ranks, shares.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        ends = ranks.join(stuck, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if loose else 0.0
        got = nodes.join(given, nodes.node == given.dst, "left")
        ranks = got.select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + ends / n)).alias("rank"))
        if i % 8 == 7:
            ranks = settled(ranks)
    return ranks


def network_entropy(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """1 less the mean over ranks of one over the number of ways out."""
    out = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("deg"))
    return ranks.join(out, ranks.node == out.src).agg((1 - F.sum(F.col("rank") / F.col("deg"))).alias("entropy"))
