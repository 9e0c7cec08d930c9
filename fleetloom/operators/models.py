"""Models of segment sequences: frequent subsequences, entropy, prediction by context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import fold_by_object, object_type
from .sequence import along, delay_chunks

#: Contexts or patterns that go to every task as a table, some hundred bytes each; a larger model is an error.
MOST_LOCAL_ROWS = 5_000_000


def _local(rows: DataFrame, what: str) -> pd.DataFrame:
    """A model as a table for every task, after a look at its size."""
    if rows.limit(MOST_LOCAL_ROWS + 1).count() > MOST_LOCAL_ROWS:
        raise ValueError(f"over {MOST_LOCAL_ROWS} {what}: choose a smaller order or length, or a larger support")
    return rows.toPandas()


def grams(traj: DataFrame, n: int) -> DataFrame:
    """traj with pattern, the n segments that begin at a row; none near the end."""
    cols = [F.lead("seg", i).over(along()) for i in range(n)]
    return traj.withColumn("pattern", F.array(*cols)).withColumn("_last", cols[-1]).where("_last is not null").drop("_last")


def frequent(traj: DataFrame, longest: int, min_support: int) -> DataFrame:
    """(pattern, freq, depth): contiguous subsequences of up to `longest`; single segments always, others from min_support on.

    All lengths are counted in one pass: each row's segments ahead, then all their beginnings.
    """
    ahead = F.filter(F.array(*[F.lead("seg", i).over(along()) for i in range(longest)]), lambda x: x.isNotNull())
    each = traj.select(ahead.alias("a")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("a")), lambda n: F.slice(F.col("a"), F.lit(1), n))).alias("pattern"))
    counts = each.groupBy("pattern").agg(F.count("*").alias("freq")).withColumn("depth", F.size("pattern"))
    return counts.where((F.col("depth") == 1) | (F.col("freq") >= min_support))


def pattern_tree(patterns: DataFrame) -> DataFrame:
    """(pattern, line): patterns below their beginnings, as lines of a tree with indents, in order of pattern."""
    line = F.concat(F.repeat(F.lit("  "), F.size("pattern") - 1), F.element_at("pattern", -1).cast("string"), F.lit(" "), F.col("freq").cast("string"))
    return patterns.select("pattern", line.alias("line")).orderBy("pattern")


def patterns_with(patterns: DataFrame, last_only: bool = False) -> DataFrame:
    """(seg, pattern, freq): longer patterns by each segment they hold, or by their last one only."""
    longer = patterns.where("depth >= 2")
    if last_only:
        return longer.select(F.element_at("pattern", -1).alias("seg"), "pattern", "freq")
    return longer.select(F.explode(F.array_distinct("pattern")).alias("seg"), "pattern", "freq")


def conditional_entropy(traj: DataFrame, order: int) -> DataFrame:
    """(entropy, contexts): 1 less the share of steps that the most frequent next segment after `order` ones gets right."""
    counts = grams(traj, order + 1).groupBy(F.slice("pattern", 1, order).alias("ctx"), F.element_at("pattern", -1).alias("next")).agg(F.count("*").alias("n"))
    per = counts.groupBy("ctx").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg((1 - F.sum("top") / F.sum("n")).alias("entropy"), F.count("*").alias("contexts"))


def context_model(traj: DataFrame, order: int) -> DataFrame:
    """(ctx, k, next, freq, total): after each context of k <= order segments, oldest first, the most frequent next one.

    Of equals the smallest segment: the first to get there, as a single reader would have it, is no
    property of the data.
    """
    past = F.filter(F.array(*[F.lag("seg", i).over(along()) for i in range(order, 0, -1)]), lambda x: x.isNotNull())
    rows = traj.select(F.col("seg").alias("next"), past.alias("past")).where(F.size("past") > 0)
    each = rows.select("next", F.explode(F.transform(F.sequence(F.lit(1), F.size("past")), lambda k: F.slice(F.col("past"), -k, k))).alias("ctx"))
    counts = each.groupBy("ctx", "next").agg(F.count("*").alias("freq")).withColumn("k", F.size("ctx"))
    best = F.max(F.struct("freq", (-F.col("next")).alias("m"))).alias("b")
    return counts.groupBy("ctx", "k").agg(best, F.sum("freq").alias("total")).select("ctx", "k", (-F.col("b.m")).alias("next"), F.col("b.freq").alias("freq"), "total")


def predicted(traj: DataFrame, model: DataFrame, order: int, neighbours: DataFrame | None = None) -> DataFrame:
    """traj with pred, the next segment by the longest known context; else the first neighbour, else 0."""
    for k in range(1, order + 1):
        past = F.array(*[F.lag("seg", i).over(along()) for i in range(k, 0, -1)])
        known = model.where(F.col("k") == k).select(F.col("ctx").alias(f"_c{k}"), F.col("next").alias(f"_n{k}"))
        traj = traj.withColumn(f"_p{k}", past)
        traj = traj.join(known, traj[f"_p{k}"] == known[f"_c{k}"], "left").drop(f"_p{k}", f"_c{k}")
    fallback = F.lit(0)
    if neighbours is not None:
        first = neighbours.groupBy("src").agg(F.min("dst").alias("_first"))
        traj = traj.withColumn("_before", F.lag("seg").over(along()))
        traj = traj.join(first, traj["_before"] == first["src"], "left").drop("src", "_before")
        fallback = F.coalesce("_first", F.lit(0))
    pred = F.coalesce(*[F.col(f"_n{k}") for k in range(order, 0, -1)], fallback)
    return traj.withColumn("pred", pred).drop(*[f"_n{k}" for k in range(1, order + 1)], "_first")


def context_compress(traj: DataFrame, model: DataFrame, order: int, neighbours: DataFrame | None = None, keep_last: bool = True) -> DataFrame:
    """The rows that the model doesn't predict, with the first and, to be able to go back, the last."""
    rows = predicted(traj, model, order, neighbours)
    last = F.max("id").over(Window.partitionBy("obj"))
    keep = (F.col("id") == 0) | (F.col("seg") != F.col("pred"))
    if keep_last:
        keep = keep | (F.col("id") == last)
    return rows.withColumn("_keep", keep).where("_keep").drop("_keep", "pred")


def _predictor(model: pd.DataFrame, order: int, first: dict[int, int]):
    known = {tuple(c): int(n) for c, n in zip(model["ctx"], model["next"], strict=True)}

    def run(history: list[int]) -> int:
        for k in range(min(order, len(history)), 0, -1):
            found = known.get(tuple(history[-k:]))
            if found is not None:
                return found
        return first.get(history[-1], 0) if history else 0

    return run


def decompressor(model: DataFrame, order: int, neighbours: DataFrame | None):
    """A function of (ids, segments) of rows of one object in order: the ids from the first to the last, and all segments."""
    table = _local(model.select("ctx", "next"), "contexts")
    first = {r.src: r.dst for r in neighbours.groupBy("src").agg(F.min("dst").alias("dst")).collect()} if neighbours is not None else {}

    def run(ids: list[int], segs: list[int]) -> tuple[list[int], list[int]]:
        predict, history, begin = _predictor(table, order, first), [], ids[0]
        for i, seg in zip(ids, segs, strict=True):
            while begin + len(history) < i:
                history.append(predict(history))
            history.append(int(seg))
        return list(range(begin, begin + len(history))), history

    return run


def context_decompress(kept: DataFrame, model: DataFrame, order: int, neighbours: DataFrame | None = None) -> DataFrame:
    """(obj, id, seg): gaps in ids filled with what the model predicts. The model goes to the tasks, after a look at its size."""
    run = decompressor(model, order, neighbours)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        ids, segs = run(rows["id"].tolist(), rows["seg"].tolist())
        return pd.DataFrame({"obj": rows["obj"].iloc[0], "id": ids, "seg": segs})

    return fold_by_object(kept, kernel, "id int, seg int")


def _contexts(column: str, order: int):
    """All endings of a history, of up to `order` segments."""
    n = F.least(F.size(column), F.lit(order))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.slice(F.col(column), -k, k))


def extend(traj: DataFrame, model: DataFrame, times: DataFrame, order: int, neighbours: DataFrame | None = None) -> DataFrame:
    """traj with one more row an object: the segment that the model predicts, later by its mean time of times(seg, mu)."""
    w = Window.partitionBy("obj").orderBy(F.desc("id"))
    tail = traj.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= order)
    ends = tail.groupBy("obj").agg(F.max("id").alias("id"), F.max_by("time", "id").alias("time"), F.transform(F.sort_array(F.collect_list(F.struct("id", "seg"))), lambda x: x["seg"]).alias("past"))
    asked = ends.select("obj", F.explode(_contexts("past", order)).alias("ctx"))
    found = asked.join(model.select("ctx", "k", "next"), "ctx").groupBy("obj").agg(F.max_by("next", "k").alias("next"))
    rows = ends.join(found, "obj", "left")
    fallback = F.lit(0)
    if neighbours is not None:
        first = neighbours.groupBy(F.col("src").alias("_src")).agg(F.min("dst").alias("_first"))
        rows = rows.join(first, F.element_at("past", -1) == F.col("_src"), "left")
        fallback = F.coalesce("_first", F.lit(0))
    rows = rows.withColumn("seg", F.coalesce("next", fallback).cast("int")).join(times.select("seg", "mu"), "seg", "left")
    more = rows.select("obj", (F.col("id") + 1).cast("int").alias("id"), "seg", (F.col("time") + F.col("mu")).cast("double").alias("time"))
    return traj.select("obj", "id", "seg", F.col("time").cast("double").alias("time")).unionByName(more)


def next_segments(asked: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(pid, next): all next segments that the model has for any ending of the history in asked(pid, history)."""
    each = asked.select("pid", F.explode(_contexts("history", order)).alias("ctx"))
    return each.join(model.select("ctx", "next"), "ctx").select("pid", "next").distinct()


def count_paths(asked: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(pid, paths): how many predicted ways of `hops` segments from a history end at target; asked(pid, history, hops, target).

    A round a hop; ways that have their last `order` segments in common are counted as one from then on.
    """
    most = asked.agg(F.max("hops")).first()[0] or 0
    cut = F.slice(F.col("history"), -F.least(F.size("history"), F.lit(order)), F.least(F.size("history"), F.lit(order)))
    state = asked.select("pid", cut.alias("history"), "hops", "target", F.lit(1).cast("long").alias("n"))
    done = None
    for h in range(most + 1):
        there = state.where((F.col("hops") == h) & (F.element_at("history", -1) == F.col("target"))).select("pid", "n")
        done = there if done is None else done.unionByName(there)
        if h == most:
            break
        state = state.where(F.col("hops") > h).withColumn("_s", F.struct("pid", "history"))
        nexts = next_segments(state.select(F.col("_s").alias("pid"), "history").distinct(), model, order).withColumnRenamed("pid", "_s")
        ahead = F.concat("history", F.array("next"))
        ahead = F.slice(ahead, -F.least(F.size(ahead), F.lit(order)), F.least(F.size(ahead), F.lit(order)))
        state = state.join(nexts, "_s").select("pid", ahead.alias("history"), "hops", "target", "n").groupBy("pid", "history", "hops", "target").agg(F.sum("n").alias("n"))
    found = done.groupBy("pid").agg(F.sum("n").alias("paths"))
    return asked.select("pid").join(found, "pid", "left").select("pid", F.coalesce("paths", F.lit(0)).cast("long").alias("paths"))


def pattern_parse(segments: list[int], patterns: set[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Segments as patterns: from the end, the longest pattern that ends there, then on before it.

    Going forward, the state at each place is the longest known suffix, one longer than before at most.
    """
    states: list[tuple[int, ...]] = []
    state: tuple[int, ...] = ()
    for seg in segments:
        state = (*state, seg)
        while len(state) > 1 and state not in patterns:
            state = state[1:]
        states.append(state)
    out, i = [], len(segments) - 1
    while i >= 0:
        out.append(states[i])
        i -= len(states[i])
    return out[::-1]


def pattern_compress(traj: DataFrame, patterns: DataFrame, chunk: str | None = None) -> DataFrame:
    """(obj, place, pattern): each object's segments as frequent patterns, which min_support bounds.

    chunk: a column whose stretches are parsed each by itself.
    """
    known = {tuple(p) for p in _local(patterns.select("pattern"), "patterns")["pattern"]}

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [g for _, g in rows.groupby(chunk, sort=True)] if chunk else [rows]
        parsed = [p for g in parts for p in pattern_parse([int(s) for s in g["seg"]], known)]
        return pd.DataFrame({"obj": rows["obj"].iloc[0], "place": range(len(parsed)), "pattern": [list(p) for p in parsed]})

    return fold_by_object(traj, kernel, "place int, pattern array<int>")


def path_kept(segs: list[int], way: dict[tuple[int, int], int]) -> list[int]:
    """Places to keep: the first, the last, and where a segment is not the predecessor of the next on the way from the one kept last."""
    kept, start = [0], segs[0]
    for i in range(1, len(segs) - 1):
        if way.get((start, segs[i + 1])) != segs[i]:
            kept.append(i)
            start = segs[i]
    return [*kept, len(segs) - 1] if len(segs) > 1 else kept


def path_compress(traj: DataFrame, preds: DataFrame, chunk: str | None = None) -> DataFrame:
    """Rows that shortest paths don't give: the first, the last, and where the way leaves them.

    preds(src, dst, pred): from the row kept last, a row goes if it is the predecessor of the next one.
    Each object gets those pairs only whose ends it has, so no task has the whole table. chunk: a
    column whose stretches are compressed each by itself.
    """
    mine = traj.select("obj", F.col("seg").cast("long").alias("src")).distinct()
    ends = mine.select(F.col("obj").alias("o2"), F.col("src").alias("dst"))
    known = preds.where("pred is not null").select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("pred").cast("long"))
    near = mine.join(known, "src").join(ends, (F.col("obj") == F.col("o2")) & (known["dst"] == ends["dst"])).select(F.col("obj").alias("o"), "src", known["dst"], "pred")

    def run(rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in names})
        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        way = {(int(s), int(d)): int(p) for s, d, p in zip(ways["src"], ways["dst"], ways["pred"], strict=True)}
        kept, parts = [], [g for _, g in rows.groupby(chunk, sort=True)] if chunk else [rows]
        for g in parts:
            kept += [g.index[i] for i in path_kept([int(s) for s in g["seg"]], way)]
        return rows.loc[kept][names]

    names = ["obj", "id", "seg", *([chunk] if chunk else [])]
    kinds = ", ".join(f"{c} {object_type(traj, c) if c in ('obj', chunk) else 'int'}" for c in names)
    return traj.select(*names).groupBy("obj").cogroup(near.groupBy("o")).applyInPandas(run, kinds)


def path_decompress(kept: DataFrame, paths: DataFrame) -> DataFrame:
    """(obj, id, seg): the segments of shortest paths between kept rows whose ids have a gap. paths(src, dst, via).

    A gap whose ends have no path is an error.
    """
    rows = kept.withColumn("_seg", F.lead("seg").over(along())).withColumn("_id", F.lead("id").over(along()))
    ways = paths.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("via").cast("array<int>").alias("_via"))
    known = rows.join(ways, (F.col("seg") == F.col("_src")) & (F.col("_seg") == F.col("_dst")) & (F.col("_id") > F.col("id") + 1), "left")
    gap = F.coalesce(F.col("_id") - F.col("id") - 1, F.lit(0))
    via = F.when(gap == 0, F.array().cast("array<int>")).when(F.size("_via") == gap, F.col("_via")).otherwise(F.raise_error(F.lit("no path between rows that are kept")).cast("array<int>"))
    each = known.select("obj", "id", F.posexplode(F.concat(F.array(F.col("seg").cast("int")), via)).alias("_k", "seg"))
    return each.select("obj", (F.col("id") + F.col("_k")).cast("int").alias("id"), "seg")


def path_pattern_compress(traj: DataFrame, preds: DataFrame, train: DataFrame, longest: int, min_support: int, delay: int | None = None) -> DataFrame:
    """(obj, place, pattern): shortest paths first, then frequent patterns of what is left, both within chunks of `delay`.

    Patterns are those of train after its own shortest paths. delay None: an object is one chunk.
    """
    patterns = frequent(path_compress(train, preds), longest, min_support)
    rows = delay_chunks(traj, delay) if delay is not None else traj.select("obj", "id", "seg", F.lit(0).alias("chunk"))
    return pattern_compress(path_compress(rows, preds, "chunk"), patterns, "chunk")
