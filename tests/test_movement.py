"""Small networks and sequences with known answers."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetloom.functions.geometry import line_probability
from fleetloom.operators import angular, graph, joins, matching, models, sequence, tooling, travel_time

SEGMENTS = [(0, "A", "B", 0.0, 0.0, 100.0, 0.0, 100.0), (1, "B", "C", 100.0, 0.0, 200.0, 0.0, 100.0), (2, "B", "D", 100.0, 0.0, 100.0, 100.0, 100.0), (3, "D", "C", 100.0, 100.0, 200.0, 0.0, 141.421356), (4, "C", "A", 200.0, 0.0, 0.0, 0.0, 200.0)]


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(SEGMENTS, "seg int, p_begin string, p_end string, ax double, ay double, bx double, by double, length double").cache()


@pytest.fixture(scope="module")
def edges(segments):
    return graph.adjacency(segments).cache()


def rows_of(spark, seqs):
    return spark.createDataFrame([(o, i, s, 1000 + 10 * i, 0.0, 1.0) for o, seq in enumerate(seqs) for i, s in enumerate(seq)], "obj long, id int, seg int, time long, dist double, length double")


def test_network(edges, spark):
    assert {(r.src, r.dst) for r in edges.collect()} == {(0, 1), (0, 2), (1, 4), (2, 3), (3, 4), (4, 0)}
    one = spark.createDataFrame([(0,)], "src int")
    paths = graph.shortest_paths(edges, 1000.0, one)
    found = {r.dst: (r.d, r.pred) for r in paths.collect()}
    assert found == {0: (0.0, None), 1: (100.0, 0), 2: (100.0, 0), 3: (200.0, 2), 4: (200.0, 1)}
    relaxed = {r.dst: (r.d, r.pred) for r in graph._relaxed(edges, 1000.0, one).collect()}
    assert relaxed == found
    via = {r.dst: (r.via, r.path_length) for r in graph.path_table(paths).collect()}
    assert via[4] == ([1], 100.0)
    assert {r.node: r.hops for r in graph.hops(edges, one, 2).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    pairs = spark.createDataFrame([(1, 0, 30.0, 4, 50.0), (2, 1, 20.0, 1, 70.0)], "pid int, s1 int, o1 double, s2 int, o2 double")
    assert {r.pid: r.distance for r in graph.point_distance(pairs, paths, None).collect()} == {1: 220.0, 2: 50.0}
    entropy = graph.network_entropy(edges, graph.pagerank(edges, 64)).first()[0]
    assert entropy == pytest.approx(0.135754, abs=1e-6)


def test_sequences(spark):
    t1, t2, t3 = [0, 1, 4], [0, 1, 4, 0], [0, 2, 3, 4]
    two = rows_of(spark, [t1, t2])
    got = {tuple(r.pattern): r.freq for r in models.frequent(two, 2, 2).collect()}
    assert got == {(0,): 3, (1,): 2, (4,): 2, (0, 1): 2, (1, 4): 2}
    assert models.pattern_parse(t1, set(got)) == [(0,), (1, 4)]
    model = models.context_model(two, 2)
    kept = models.context_compress(two.where("obj = 1"), model, 2)
    assert [r.id for r in kept.orderBy("id").collect()] == [0, 3]
    back = models.context_decompress(kept.select("obj", "id", "seg"), model, 2)
    assert [r.seg for r in back.orderBy("id").collect()] == t2
    entropy = models.conditional_entropy(rows_of(spark, [t1, t2, t3]), 1).first()
    assert (round(entropy.entropy, 6), entropy.contexts) == (0.125, 5)
    runs = rows_of(spark, [[0, 0, 1, 1, 1]])
    assert [r.id for r in sequence.dedup_runs(runs).orderBy("id").collect()] == [1, 4]


def test_path_compression(spark, edges):
    paths = graph.shortest_paths(edges, 1000.0)
    t = rows_of(spark, [[0, 2, 3, 4], [0, 1, 4, 0]])
    kept = models.path_compress(t, paths)
    assert [[r.seg for r in kept.where(f"obj = {o}").orderBy("id").collect()] for o in (0, 1)] == [[0, 3, 4], [0, 4, 0]]
    back = models.path_decompress(kept, graph.path_table(paths))
    assert [[r.seg for r in back.where(f"obj = {o}").orderBy("id").collect()] for o in (0, 1)] == [[0, 2, 3, 4], [0, 1, 4, 0]]


def test_uniform_times(spark):
    rows = [(0, 0, 0, 1), (0, 1, 1, None), (0, 2, 4, 11), (0, 3, 0, None), (0, 4, 1, 21)]
    t = spark.createDataFrame([(o, i, s, x, 0.0, 1.0) for o, i, s, x in rows], "obj long, id int, seg int, time long, dist double, length double")
    assert [r.chunk for r in sequence.online_chunks(t).orderBy("id").collect()] == [0, 1, 1, 2, 2]
    times = [r.t for r in sequence.uniform_times(t).orderBy("id").collect()]
    assert times == [1, 6, 11, 16, 21]
    assert [r["run"] for r in sequence.uniform_times(t).orderBy("id").collect()] == [1, 2, 3, 4, 5]


def test_em_window(spark):
    rows = [(0, 0, 0, 1000, 100.0), (0, 1, 1, None, 200.0), (0, 2, 4, 1040, 200.0)]
    t = spark.createDataFrame([(o, i, s, x, 0.0, length) for o, i, s, x, length in rows], "obj long, id int, seg int, time long, dist double, length double")
    w = sequence.em_windows(t).first()
    assert (w.dist, w.dt, w.sigma, w.total_dist) == (400.0, 40, 1.0, 400.0)


def test_maximise(spark, segments):
    times = spark.createDataFrame([(0, 10.0), (0, 14.0)], "seg int, x double")
    got = {r.seg: (r.mu, r.sigma) for r in travel_time.maximise(times, segments, 10.0).collect()}
    assert got[0] == (12.0, 3.0) and got[1] == (10.0, 20.0)


def test_solve():
    x = travel_time.solve(np.array([10.0, 20.0]), np.array([2.0, 2.0]), np.array([100.0, 100.0]), 1.0, [(0, 2, 36.0, 1.0)])
    assert x == pytest.approx([12.670663, 22.662670], abs=1e-3)
    x = travel_time.solve(np.array([1.0, 30.0]), np.array([3.0, 1.0]), np.array([1.0, 1.0]), 0.0, [(0, 2, 5.0, 0.1)])
    assert (x >= 0).all() and x[0] == 0


def test_curves():
    c = [(0, 0), (0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (3, 6), (3, 7)]
    assert [c[i] for i in angular.thinned(c, 0, by_time=False)] == [(0, 0), (0, 2), (3, 5), (3, 7)]
    for by_time in (False, True):
        assert angular.thinned([(0, 0), (10, 10), (20, 20), (30, 30)], 1, by_time) == [0, 3]
        assert angular.thinned([(0, 0), (10, 10), (20, 20), (30, 50)], 1, by_time) == [0, 2, 3]
    assert angular.thinned([], 1, True) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 30)), min_size=2, max_size=25))
def test_time_error_is_bounded(steps):
    d = list(itertools.accumulate(a for a, _ in steps))
    t = list(itertools.accumulate(b for _, b in steps))
    points, error = list(zip(map(float, d), map(float, t), strict=True)), 5.0
    kept = angular.thinned(points, error, by_time=True)
    at = np.interp([p[0] for p in points], [points[i][0] for i in kept], [points[i][1] for i in kept])
    assert np.abs(at - np.array(t)).max() <= error + 1e-6


def test_probabilities():
    assert line_probability(50, 0, 0, 0, 100, 0, 4.07) == pytest.approx(1)
    assert line_probability(50, 4.07, 0, 0, 100, 0, 4.07) == pytest.approx(math.exp(-0.5), abs=1e-6)


def test_store_questions(spark):
    rows = spark.createDataFrame([("a", 0, 0, 100000), ("a", 1, 1, 100010), ("a", 2, 4, 100030)], "obj string, id long, seg int, time long")
    asked = spark.createDataFrame([(1, "a", 100020), (2, "a", 100030), (3, "a", 99999), (4, "b", 5)], "qid long, obj string, at long")
    got = {r.qid: (r.seg, r.time) for r in joins.as_of(rows, asked, "time", "id").collect()}
    assert got == {1: (1, 100010), 2: (4, 100030), 3: (None, None), 4: (None, None)}


def test_nearest_and_within(spark, segments):
    points = spark.createDataFrame([(1, 50.0, 3.0), (2, 300.0, 300.0)], "pid int, x double, y double")
    assert {(r.pid, r.seg) for r in joins.within_distance(points, segments, 10.0).collect()} == {(1, 0), (1, 4)}
    near = {(r.pid, r.rank): r.seg for r in joins.nearest(points, segments, 1, 10.0).collect()}
    assert near == {(1, 1): 0, (2, 1): 2}


def test_map_matching(spark, segments):
    gps = spark.createDataFrame([(1, 0, 0, 50.0, 1.0), (1, 1, 20, 98.0, 60.0), (1, 2, 40, 150.0, 51.0)], "obj long, id int, time long, x double, y double")
    assert [r.seg for r in matching.map_match(gps, segments).orderBy("id").collect()] == [0, 2, 3]
    way = [2, 0, 1]
    emission = [[0.5, 0.5, 0.1], [0.2, 0.9, 0.1]]
    moves = [{}, {(a, b): 0.1 + 0.2 * ((a + b) % 3) for a in way for b in way}]
    cost = lambda s: -math.log(emission[0][way.index(s[0])]) - math.log(moves[1][s]) - math.log(emission[1][way.index(s[1])])
    best = min(cost(s) for s in itertools.product(way, way))
    assert cost(tuple(matching.viterbi([way, way], emission, moves))) == pytest.approx(best)


def test_combined_round_trip(spark, segments, edges):
    t = tooling.synthetic(segments, edges, 5, 20, steps=30).join(segments.select("seg", "length"), "seg").cache()
    model = models.context_model(t, 2)
    flags = models.predicted(t, model, 2).select("obj", "id", (F.col("seg") == F.col("pred")).alias("hit"))
    times = segments.select("seg", (F.col("length") / 15).alias("mu"), F.lit(2.0).alias("sigma"))
    kept = travel_time.combined_compress(t, flags, times, 15.0).cache()
    assert 0 < kept.count() < t.count()
    back = models.context_decompress(kept.select("obj", "id", "seg"), model, 2)
    assert back.select("obj", "id", "seg").exceptAll(t.select("obj", "id", "seg")).count() == 0 and back.count() == t.count()


def test_delay_and_speed(spark):
    t = rows_of(spark, [[0, 1, 2, 3, 4]])
    assert [r.chunk for r in sequence.delay_chunks(t, 15).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    # Observations at 0, 10 and 20 s; 100 m of fills in the first gap, 1 m in the second.
    rows = [(0, 0, 0, 0, 1.0), (0, 1, 1, None, 100.0), (0, 2, 2, 10, 1.0), (0, 3, 3, None, 1.0), (0, 4, 4, 20, 1.0), (0, 5, 5, 30, 1.0)]
    t = spark.createDataFrame([(o, i, s, x, 0.0, n) for o, i, s, x, n in rows], "obj long, id int, seg int, time long, dist double, length double")
    got = [(r.id, r.piece) for r in sequence.break_by_speed(t, 5, 40).orderBy("id").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (4, 1), (5, 1)]
    short = [(r.id, r.piece) for r in sequence.break_by_speed(t, 5, 40, most=3).orderBy("id").collect()]
    assert short == [(4, 0), (5, 0)]
    assert sequence.break_by_speed(t, 5, 40, most=None).count() == 5


def test_ids_of_any_type(spark, segments, edges, tmp_path):
    t = rows_of(spark, [[0, 1, 4, 0, 1, 4], [0, 2, 3, 4]]).withColumn("obj", F.concat(F.lit("car-"), F.col("obj").cast("string")))
    model = models.context_model(t, 2)
    paths = graph.shortest_paths(edges, 1000.0)
    times = segments.select("seg", (F.col("length") / 15).alias("mu"), F.lit(2.0).alias("sigma"))
    flags = models.predicted(t, model, 2).select("obj", "id", (F.col("seg") == F.col("pred")).alias("hit"))
    curves = t.select("obj", "id", (F.col("id") * 1.0).alias("dist"), F.col("time").cast("double").alias("time"))
    made = [
        sequence.delay_chunks(t, 15),
        sequence.break_by_speed(t, 0, 1),
        models.context_decompress(models.context_compress(t, model, 2).select("obj", "id", "seg"), model, 2),
        models.pattern_compress(t, models.frequent(t, 2, 1)),
        models.path_compress(t, paths),
        models.path_decompress(models.path_compress(t, paths), graph.path_table(paths)),
        angular.angular_compress(curves, 1.0, True),
        travel_time.time_compress(t, times, 1.0),
        travel_time.combined_compress(t, flags, times, 1.0),
        travel_time.expect(t, times, 1.0),
        models.extend(t, model, times, 2),
    ]
    for df in made:
        assert {r.obj for r in df.select("obj").collect()} == {"car-0", "car-1"}


def test_store(spark, segments, edges):
    from fleetloom.operators.store import SegmentStore, TrajectoryStore, restored

    rows = spark.createDataFrame([("a", 0, 0, 100000.0), ("a", 1, 1, 100010.0), ("a", 2, 4, 100030.0)], "obj string, id int, seg int, time double")
    store = TrajectoryStore(spark, "kept_rows", 4)
    store.drop()
    store.create(rows)
    asked = spark.createDataFrame([(1, "a", 100020.0), (2, "a", 100030.0), (3, "a", 99999.0), (4, "b", 100020.0)], "qid long, obj string, at double")
    assert {r.qid: (r.seg, r.time) for r in store.where_at(asked).collect()} == {1: (1, 100010.0), 2: (4, 100030.0), 3: (None, None), 4: (None, None)}
    by_id = spark.createDataFrame([(1, "a", 1), (2, "a", 9)], "qid long, obj string, at int")
    assert {r.qid: r.seg for r in store.where_at_id(by_id).collect()} == {1: 1, 2: 4}
    span = spark.createDataFrame([(1, "a", 0.0, 100010.0)], "qid long, obj string, since double, until double")
    assert sorted(r.id for r in store.trajectory(span).collect()) == [0, 1]
    assert [r.obj for r in store.objects_on(1, 100000, 100020).collect()] == ["a"]
    centre = spark.createDataFrame([(1, 150.0, 5.0)], "pid int, x double, y double")
    assert [r.obj for r in store.objects_near(centre, segments, 10.0, 100000, 100020).collect()] == ["a"]
    store.insert(rows.withColumn("obj", F.lit("b")))
    assert store.rows().count() == 6
    place = SegmentStore(spark, "kept_segments")
    place.drop()
    place.create(segments)
    assert sorted(r.seg for r in place.near(centre, 10.0).collect()) == [1, 4]
    assert [r.seg for r in place.closest(centre).collect()] == [1]
    # Compressed rows: answers by partial decompression are those by the whole, and times keep the error.
    t = tooling.synthetic(segments, edges, 6, 30, steps=60).join(segments.select("seg", "length"), "seg").cache()
    model, times = travel_time.train_combined(t, segments, 2, 15.0, 1.0, 1)
    store.drop()
    store.create(rows.limit(0).withColumn("obj", F.lit(0).cast("long")))
    store.insert_compressed(t, model, times, 2, 20.0)
    assert 0 < store.rows().count() < t.count()
    back = restored(store.rows(), model, times, 2)
    assert back.select("obj", "id", "seg").exceptAll(t.select("obj", "id", "seg")).count() == 0 and back.count() == t.count()
    seen = t.where("time is not null").select("obj", "id", F.col("time").alias("true_time"))
    worst = back.join(seen, ["obj", "id"]).agg(F.max(F.abs(F.col("time") - F.col("true_time")))).first()[0]
    assert worst < 60
    when = spark.range(300).select(F.col("id").alias("qid"), (F.col("id") % 6).alias("obj"), (F.col("id") * 1.7).alias("at"))
    whole = {r.qid: (r.seg, r.time and round(r.time, 6)) for r in store.where_at_restored(when, model, times, 2).collect()}
    assert {r.qid: (r.seg, r.time and round(r.time, 6)) for r in store.where_at_part(when, model, times, 2).collect()} == whole
    store.drop()
    store.create(rows.limit(0).withColumn("obj", F.lit(0).cast("long")))
    store.insert_raw(t)
    assert store.rows().where("time is null").count() == 0
    store.drop()
    place.drop()


def test_as_of_by_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(int(o), i, int(s), int(x)) for i, (o, s, x) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 9, 400), rng.integers(0, 1000, 400), strict=True))]
    asked = [(i, int(o), int(x)) for i, (o, x) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(-50, 1100, 300), strict=True))]
    df = spark.createDataFrame(rows, "obj long, id int, seg int, time long")
    q = spark.createDataFrame([*asked, (999, None, 5), (998, 1, None)], "qid long, obj long, at long")
    want = {i: max(((x, k, s) for o, k, s, x in rows if o == obj and x <= at), default=None) for i, obj, at in asked} | {998: None, 999: None}
    for buckets in (1, 16):
        got = {r.qid: None if r.id is None else (r.time, r.id, r.seg) for r in joins.as_of(df, q, "time", "id", buckets).collect()}
        assert got == want
    spans = spark.createDataFrame([(i, o, x, x + 40) for i, o, x in asked], "qid long, obj long, since long, until long")
    pairs = sorted((i, k) for i, obj, at in asked for o, k, _, x in rows if o == obj and at <= x <= at + 40)
    assert sorted((r.qid, r.id) for r in joins.in_range(df, spans).collect()) == pairs
    assert joins.as_of(df.limit(0), q, "time", "id").where("id is not null").count() == 0


def test_map_matching_with_paths(spark, segments):
    gps = spark.createDataFrame([("x", 0, 0, 20.0, 3.0), ("x", 1, 20, 120.0, 60.0), ("x", 2, 60, 150.0, 52.0)], "obj string, id int, time long, x double, y double")
    plain = matching.map_match(gps, segments)
    assert [(r.obj, r.id, r.seg) for r in plain.orderBy("id").collect()][0] == ("x", 0, 0) and plain.count() == 3
    far = spark.createDataFrame([("x", 0, 0, 20.0, 3.0), ("x", 1, 600, 170.0, 32.0)], "obj string, id int, time long, x double, y double")
    longer = matching.map_match(far, segments, extend=True).orderBy("id").collect()
    assert [(r.id, r.seg, r.time) for r in longer] == [(0, 0, 0), (1, 2, None), (2, 3, 600)]
    short = matching.map_match(far, segments, extend=True, bound=50.0).orderBy("id").collect()
    assert [(r.id, r.seg) for r in short] == [(0, 4)]  # no way from 0 to 3 within 50 m


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(20):
        steps = [list(range(int(rng.integers(1, 4)))) for _ in range(4)]
        emission = [[float(x) for x in rng.uniform(0.1, 1, len(s))] for s in steps]
        moves = [{}] + [{(a, b): float(rng.uniform(0.05, 1)) for a in steps[t - 1] for b in steps[t]} for t in range(1, 4)]
        cost = lambda w: -math.log(emission[0][w[0]]) - sum(math.log(moves[t][w[t - 1], w[t]]) + math.log(emission[t][w[t]]) for t in range(1, 4))  # noqa: B023, E731
        assert cost(matching.viterbi(steps, emission, moves)) == pytest.approx(min(cost(w) for w in itertools.product(*steps)))


def test_solve_by_blocks():
    """The banded solution is that of the whole matrix, with coordinates held at zero where they must be."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(2, 14))
        mu, sigma, lengths = rng.uniform(1, 30, n), rng.uniform(0.5, 5, n), rng.uniform(1, 100, n)
        cuts = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
        windows = [(a, b, float(rng.uniform(0, 60)), float(rng.uniform(0.3, 3))) for a, b in zip(cuts, cuts[1:], strict=False)]
        x = travel_time.solve(mu, sigma, lengths, 0.2, windows)
        h, g = np.diag(1 / sigma**2), mu / sigma**2
        for i in range(1, n):
            v = np.zeros(n)
            v[i], v[i - 1] = 1 / lengths[i], -1 / lengths[i - 1]
            h += np.outer(v, v) / 0.04
        for a, b, seconds, noise in windows:
            h[a:b, a:b] += 1 / noise**2
            g[a:b] += seconds / noise**2
        slope = h @ x - g
        assert (x >= 0).all() and np.allclose(slope[x > 0], 0, atol=1e-6) and (slope[x == 0] > -1e-6).all()


def test_travel_times(spark, segments):
    times = segments.select("seg", F.lit(10.0).alias("mu"), F.lit(1.0).alias("sigma"))
    rows = [(0, 0, 0, 100), (0, 1, 1, None), (0, 2, 4, None), (0, 3, 0, 130)]
    t = spark.createDataFrame(rows, "obj long, id int, seg int, time long")
    assert [r.time for r in travel_time.time_restore(t, times).orderBy("id").collect()] == [100, 110, 120, 130]
    t = t.withColumn("length", F.lit(100.0))
    start = [r.x for r in travel_time.start_times(t).orderBy("id").collect()]
    assert start == [10.0, 10.0, 10.0]
    value = travel_time.objective(t, travel_time.start_times(t), times, 1.0).first()
    assert value.n == 3 and value.value == pytest.approx(0.0)
    # Leading fills and objects without observations.
    odd = spark.createDataFrame([(0, 0, 1, None), (0, 1, 0, 100), (1, 0, 2, None), (1, 1, 3, None)], "obj long, id int, seg int, time long").withColumn("length", F.lit(1.0))
    flags = odd.select("obj", "id", F.lit(False).alias("hit"))
    kept = {(r.obj, r.id): r.time for r in travel_time.combined_compress(odd, flags, times, 1.0).collect()}
    assert kept == {(0, 0): None, (0, 1): 100.0, (1, 0): None, (1, 1): None}
    assert [(r.obj, r.id) for r in travel_time.time_compress(odd, times, 1.0).collect()] == [(0, 1)]


def test_uniform_times_shifted(spark):
    rows = [(0, 0, 0, 1), (0, 1, 1, None), (0, 2, 4, 11), (0, 3, 0, None), (0, 4, 1, 21)]
    t = spark.createDataFrame([(o, i, s, x, 0.0, 1.0) for o, i, s, x in rows], "obj long, id int, seg int, time long, dist double, length double")
    assert [r.t for r in sequence.uniform_times(t, shifted=True).orderBy("id").collect()] == [1, 16, 21, 26, 31]
    assert [r.time for r in sequence.set_times_uniform(t).orderBy("id").collect()] == [1, 6, 11, 16, 21]


def test_predictions(spark, edges):
    t = rows_of(spark, [[0, 1, 4, 0], [0, 1, 4]])
    model = models.context_model(t, 2)
    untrained = models.predicted(rows_of(spark, [[3, 4]]), model.where("k > 9"), 2, edges)
    assert [r.pred for r in untrained.orderBy("id").collect()] == [0, 4]  # the first neighbour of 3
    times = spark.createDataFrame([(0, 7.0)], "seg int, mu double")
    longer = models.extend(t, model, times, 2, edges)
    assert sorted((r.obj, r.id, r.seg, r.time) for r in longer.where("id >= 3").collect()) == [(0, 3, 0, 1030.0), (0, 4, 1, None), (1, 3, 0, 1027.0)]
    asked = spark.createDataFrame([(1, [0, 1], 2, 0), (2, [0, 1], 1, 0), (3, [1, 4], 0, 4)], "pid int, history array<int>, hops int, target int")
    assert sorted((r.pid, r.next) for r in models.next_segments(asked, model, 2).collect()) == [(1, 4), (2, 4), (3, 0)]
    assert {r.pid: r.paths for r in models.count_paths(asked, model, 2).collect()} == {1: 1, 2: 0, 3: 1}
    assert [r.line for r in models.pattern_tree(models.frequent(t, 2, 2)).collect()] == ["0 3", "  1 2", "1 2", "  4 2", "4 2"]


def test_routes_and_relaxed(spark, edges, monkeypatch):
    pairs = spark.createDataFrame([(0, 4), (0, 3), (3, 0), (0, 99)], "src int, dst int")
    want = {(0, 4): (200.0, [1]), (0, 3): (200.0, [2]), (3, 0): (341.421356, [4])}
    assert {(r.src, r.dst): (round(r.d, 6), r.via) for r in graph.routes(edges, pairs).collect()} == want
    monkeypatch.setattr(graph, "MOST_LOCAL_EDGES", 1)
    assert {(r.src, r.dst): (round(r.d, 6), r.via) for r in graph.routes(edges, pairs, 1000.0).collect()} == want
    strict = graph.shortest_paths(edges, 200.0, spark.createDataFrame([(0,)], "src int"), strict=True)
    assert sorted(r.dst for r in strict.collect()) == [1, 2]


def test_erf_and_geometry(spark):
    from fleetloom.functions import geometry as geo

    x = np.linspace(-7, 7, 701)
    assert np.allclose(geo.erf(x), [math.erf(v) for v in x], atol=1e-14)
    p = geo.line_probabilities(np.array([50.0, 50.0]), np.array([0.0, 4.07]), np.zeros(2), np.zeros(2), np.full(2, 100.0), np.zeros(2), 4.07)
    assert p == pytest.approx([1.0, math.exp(-0.5)], abs=1e-6)
    row = spark.range(1).select(geo.distance_points(F.lit(37.0), F.lit(0.0), F.lit(37.0), F.lit(1.0)).alias("d"), geo.distance_points(F.lit(37.0), F.lit(0.0), F.lit(38.0), F.lit(0.0)).alias("n")).first()
    assert row.d == pytest.approx(88_804, rel=1e-3) and row.n == pytest.approx(111_195, rel=1e-3)


def test_algorithms_by_name(spark, segments, edges):
    from fleetloom.operators import registry

    t = tooling.synthetic(segments, edges, 5, 20, steps=30).cache()
    options = registry.Options(segments.select("seg", "length"), edges, error=15.0, longest=3)
    for name in registry.ALGORITHMS:
        kept, stats = registry.tested(name, options, t, t)
        values = {r.name: r.value for r in stats.collect()}
        assert 0 < values["num_updates_comp"] and values["num_updates_orig"] == t.count(), name
    with pytest.raises(ValueError):
        registry.algorithm("none", options)


def test_command_line(spark, tmp_path, capsys):
    """A map at latitude 37, string ids: index, paths, match, compress, store, ask."""
    from fleetloom import cli
    from fleetloom.sources import text

    raw = tmp_path / "map.csv"
    raw.write_text("4,4\na,37,-122\nb,37,-121.99\nc,37.01,-121.99\nd,37.01,-122\nab,a,b,0\nbc,b,c,0\ncd,c,d,0\nda,d,a,0\n")
    cli.main(["index", "--map", str(raw), "--output", str(tmp_path / "net"), "--table", "city"])
    net = str(tmp_path / "net")
    segments, _ = text.read_network(spark, net)
    assert text.network_lat0(segments) == pytest.approx(37.005, abs=1e-6)
    assert {round(r.length, -1) for r in segments.select("length").collect()} == {890.0, 1110.0}
    assert text.read_graph(spark, net).count() == 16 and text.read_lengths(spark, net).count() == 8
    cli.main(["paths", "--map", net, "--bound", "2500", "--output", str(tmp_path / "sp")])
    assert text.read_paths(spark, str(tmp_path / "sp")).count() > 0
    gps = tmp_path / "gps.csv"
    gps.write_text("".join(f"cab-1,37,{-122 + 0.002 * i:.6f},0,{100000 + 30 * i}\n" for i in range(5)) + "".join(f"cab-1,{37 + 0.002 * i:.6f},-121.99,0,{100200 + 30 * i}\n" for i in range(1, 5)))
    cli.main(["match", "--map", net, "--input", str(gps), "--output", str(tmp_path / "matched"), "--extend"])
    rows = text.read_trajectories(spark, str(tmp_path / "matched"))
    assert {r.obj for r in rows.collect()} == {"cab-1"} and 2 <= rows.count() <= 4
    trips = tmp_path / "trips.csv"
    trips.write_text("cab-1,0,100000,1\ncab-1,2,100100,1\ncab-1,4,6,100300,1\ncab-2,0,100000,1\ncab-2,2,4,100250,1\n")
    for name in ("PPM", "SPFS", "COMBINED"):
        cli.main(["compress", "--map", net, "--input", str(trips), "--algorithm", name, "--output", str(tmp_path / name)])
    (tmp_path / "asked.csv").write_text("cab-1,100150\ncab-2,99000\n")
    for how in (["--raw"], []):
        cli.main(["store", "--map", net, "--input", str(trips), "--table", "city", *how])
        for more in ([], ["--partial"]):
            cli.main(["where-at", "--map", net, "--queries", str(tmp_path / "asked.csv"), "--table", "city", "--output", str(tmp_path / "found"), *more])
            found = sorted(line for f in (tmp_path / "found").glob("part-*") for line in f.read_text().split())
            assert found[0].startswith("cab-1,100150") and found[1].startswith("cab-2,99000") and found[1].split(",")[2] == "0"
    cli.main(["drop", "--table", "city", "--output", "-"])
    assert "queries_second" in capsys.readouterr().out


def test_figures_of_drives(spark, segments, edges, tmp_path):
    drives = tooling.synthetic(segments, edges, 4, 20, walk=False, rate=0.005, width=2, times=2, drives=True).cache()
    stats = tooling.drive_stats(drives).first()
    rows = drives.toPandas()
    assert stats.avg_speed == pytest.approx(rows["speed"].mean()) and stats.sigma_speed == pytest.approx(rows["speed"].std(ddof=0))
    times = tooling.segment_times(tooling.travel_times(drives), segments)
    assert times.count() == 5 and times.where("sigma <= 0").count() == 0
    t = tooling.synthetic(segments, edges, 2, 20, steps=10).cache()
    named = segments.select("seg", F.concat(F.lit("s"), F.col("seg").cast("string")).alias("name"), "length")
    tooling.write_updates(t, named, str(tmp_path / "updates"))
    from fleetloom.sources import text

    back = text.read_trajectories(spark, str(tmp_path / "updates"), named, epoch_shift=False)
    assert back.count() == sequence.online_chunks(t).count()
    with pytest.raises(Exception, match="no segment is named"):
        text.read_trajectories(spark, str(tmp_path / "updates"), named.where("seg > 0"), epoch_shift=False).collect()
    text.dump_trajectories(t, named, str(tmp_path / "dump"))
    assert sum(len(f.read_text().split()) for f in (tmp_path / "dump").glob("part-*")) == t.count()
    (tmp_path / "conf").write_text("sigma 3.5\nmax_candidates 4\n")
    from fleetloom.config import Config

    config = Config.of(text.read_config(spark, str(tmp_path / "conf")))
    assert config.sigma == 3.5 and config.max_candidates == 4
    assert tooling.store_stats(10, 5, 2.0, 4, 1.0)["compression_ratio"] == 2.0


def test_folds_and_queries(spark):
    t = rows_of(spark, [[0, 1], [1, 2], [2, 3]])
    assert {r.fold for r in tooling.folds(t, "obj", 2).collect()} == {0, 1}
    assert tooling.sample_queries(t, 20).count() == 20


def test_text_round_trips(spark, tmp_path):
    from fleetloom.sources import text

    raw = tmp_path / "map.csv"
    raw.write_text("3,3\na,0,0\nb,0,0.001\nc,0.001,0.001\nx,a,b,0\ny,b,c,1\nz,b,b,1")
    segs = text.read_raw_map(spark, str(raw)).cache()
    assert [(r.seg, r.name) for r in segs.orderBy("seg").collect()] == [(0, "x"), (1, "-1x"), (2, "y")]
    net = graph.adjacency(segs)
    text.write_network(segs, net, str(tmp_path / "net"))
    again, edges2 = text.read_network(spark, str(next((tmp_path / "net").glob("part-*"))))
    assert again.count() == 3 and {(r.src, r.dst) for r in edges2.collect()} == {(r.src, r.dst) for r in net.collect()}
    trips = tmp_path / "traj.csv"
    trips.write_text("o,1,500,0.5\no,2,3,100000,7.5")
    t = text.read_trajectories(spark, str(trips)).cache()
    assert [(r.id, r.seg, r.time, r.dist) for r in t.orderBy("id").collect()] == [(0, 1, 86900, 0.5), (1, 2, None, None), (2, 3, 100000, 7.5)]
    text.write_trajectories(t, str(tmp_path / "out"))
    assert text.read_trajectories(spark, str(tmp_path / "out"), epoch_shift=False).count() == 3


def test_online_is_batch(spark, tmp_path):
    from fleetloom.streaming.online import online_compress

    t = rows_of(spark, [[0, 1, 4, 0, 1, 4], [0, 2, 3, 4]])
    model = models.context_model(t, 2)
    table = {tuple(r.ctx): r.next for r in model.collect()}
    t.select("obj", "id", "seg", "time").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("obj long, id int, seg int, time long").parquet(str(tmp_path / "in"))
    q = online_compress(stream, table, 2).writeStream.format("memory").queryName("online").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.obj, r.id) for r in models.context_compress(t, model, 2, keep_last=False).collect()}
    assert {(r.obj, r.id) for r in spark.table("online").collect()} == want


def test_stream_with_watermark(spark, tmp_path):
    """Late rows go, a silent object's last row is sent, and times that the model has are not."""
    from fleetloom.streaming.online import latest, online_compress

    kinds = "obj string, id int, seg int, time long, ts timestamp"
    put = lambda rows, n: spark.createDataFrame([(o, i, s, t) for o, i, s, t in rows], "obj string, id int, seg int, time long").withColumn("ts", F.timestamp_seconds("time")).select(*[c.split()[0] for c in kinds.split(", ")]).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    put([("a", 0, 0, 1000), ("a", 1, 1, 1010), ("a", 2, 4, 1020)], "1")
    source = spark.readStream.schema(kinds).parquet(str(tmp_path / "in" / "*"))
    model = {(0,): 1, (1,): 4, (0, 1): 4}
    times = {1: (10.0, 2.0), 4: (10.0, 2.0)}
    q = online_compress(source, model, 2, "60 seconds", times, 5.0).writeStream.format("memory").queryName("silent").outputMode("append").start()
    w = latest(source, "60 seconds", "1 minute").writeStream.format("memory").queryName("places").outputMode("append").start()
    for n, rows in (("2", [("b", 0, 2, 5000)]), ("3", [("b", 1, 3, 9000), ("c", 0, 1, 1500)]), ("4", [("b", 2, 3, 12000)])):
        for x in (q, w):
            x.processAllAvailable()
        put(rows, n)
    for x in (q, w):
        x.processAllAvailable()
        x.stop()
    got = {(r.obj, r.id) for r in spark.table("silent").collect()}
    assert {("a", 0), ("a", 2), ("b", 0)} <= got and ("a", 1) not in got and ("c", 0) not in got
    assert ("a", 4) in {(r.obj, r.seg) for r in spark.table("places").collect()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert pd.Series(list(entry.queries())).is_unique


def test_path_of_many_hops(spark):
    n = 80
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, weight double")
    paths = graph.shortest_paths(edges, 1000.0, spark.createDataFrame([(0,)], "src long"))
    via = {r.dst: (r.via, r.path_length) for r in graph.path_table(paths).collect()}
    assert via == {d: (list(range(1, d)), d - 1.0) for d in range(1, n + 1)}


def test_partial_restore_where_stored_times_go_back(spark):
    from fleetloom.operators.store import restored, where_at_part

    whole = spark.createDataFrame([(o, i, (i * (o + 1)) % 4) for o in (1, 2) for i in range(21)], "obj long, id int, seg int")
    model = models.context_model(whole, 1).cache()
    times = spark.createDataFrame([(s, 5.0 + s, 1.0) for s in range(4)], "seg int, mu double, sigma double")
    stored = {1: {0: 0.0, 4: 100.0, 8: 60.0, 12: 400.0, 16: 400.0, 20: 500.0}, 2: {0: 90.0, 5: 40.0, 10: 900.0, 11: 890.0, 20: 950.0}}
    kept = whole.join(spark.createDataFrame([(o, i, t) for o, ts in stored.items() for i, t in ts.items()], "obj long, id int, time double"), ["obj", "id"])
    asked = spark.createDataFrame([(1, 1, 95.0), (2, 2, 85.0), (3, 2, 895.0), (4, 1, 400.0), (5, 2, 30.0), (6, 3, 5.0)], "qid long, obj long, at double")
    row = lambda r: (r.id, r.seg, r.time and round(r.time, 6))
    want = {r.qid: row(r) for r in joins.as_of(restored(kept, model, times, 1), asked, "time", "id").collect()}
    assert {r.qid: row(r) for r in where_at_part(kept, asked, model, times, 1).collect()} == want
    assert {q: i for q, (i, *_) in want.items() if q not in (3, 4)} == {1: 5, 2: 1, 5: None, 6: None}


def test_nearest_begins_by_density(spark, monkeypatch):
    rng = np.random.default_rng(5)
    at = rng.normal(0, 0.13, (600, 2))
    at[-1] = (9.0, -7.0)  # far off
    lines = [(i, *map(float, (*at[i], *at[i + 1]))) for i in range(598)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "pid int, x double, y double")
    shape = spark.createDataFrame(lines, "seg int, ax double, ay double, bx double, by double").cache()
    asked, met = joins.within_distance, []

    def counted(*a):
        out = asked(*a)
        met.append(out.count())
        return out

    monkeypatch.setattr(joins, "within_distance", counted)
    got = {(r.pid, r.rank): (r.seg, r.d) for r in joins.nearest(points, shape, 3, 0.5).collect()}
    assert sum(met) < 600 * 598 / 5  # half a unit around a point is nearly all of them
    monkeypatch.undo()
    ax, ay, bx, by = (np.array(c) for c in list(zip(*lines, strict=True))[1:])
    for i, (x, y) in enumerate(at):
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        d = np.hypot(x - np.where(t >= 1, bx, ax + t * (bx - ax)), y - np.where(t >= 1, by, ay + t * (by - ay)))
        want = sorted(zip(d.tolist(), range(598), strict=True))[:3]
        assert [got[i, r][0] for r in (1, 2, 3)] == [s for _, s in want] and all(abs(got[i, r + 1][1] - want[r][0]) < 1e-12 for r in range(3))
    assert len(got) == 1800
    near = {(r.pid, r.seg) for r in joins.within_distance(points, shape, 0.02).collect()}
    assert near == {(i, s) for i, (x, y) in enumerate(at) for s in range(598) if (lambda t: math.dist((x, y), (ax[s] + t * (bx[s] - ax[s]), ay[s] + t * (by[s] - ay[s]))))(min(1, max(0, ((x - ax[s]) * (bx[s] - ax[s]) + (y - ay[s]) * (by[s] - ay[s])) / ((bx[s] - ax[s]) ** 2 + (by[s] - ay[s]) ** 2)))) <= 0.02}


def test_pairs_are_measured_after_they_meet(spark, segments):
    points = spark.createDataFrame([(1, 50.0, 3.0)], "pid int, x double, y double")
    plan = joins.within_distance(points, segments, 10.0)._jdf.queryExecution().optimizedPlan().toString()
    (join,) = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(join) < 1000 and "least(" not in join  # a longer condition is a method that the JVM does not compile


def test_candidates_and_those_without_any(spark, segments):
    config = matching.Config(sigma=2.0, radius_sigmas=5.0, max_candidates=2)
    points = spark.createDataFrame([(1, 99.0, 1.0), (2, 500.0, 500.0), (3, 50.0, 9.9)], "pid int, x double, y double")
    got = {(r.pid, r.seg): (r.p, r.offset) for r in matching.candidates(points, segments, config).collect()}
    assert {k for k in got if k[0] != 1} == {(2, 2), (3, 0), (3, 4)} and got[2, 2][0] == 1.0 and len(got) == 5
    near = {s: line_probability(99.0, 1.0, ax, ay, bx, by, 2.0) for s, _, _, ax, ay, bx, by, _ in SEGMENTS if s != 3}
    best = sorted(near, key=lambda s: (-near[s], s))[:2]
    assert {k[1] for k in got if k[0] == 1} == set(best)
    for s in best:
        assert abs(got[1, s][0] - near[s] / sum(near.values())) < 1e-12


def test_best_candidates_leave_the_cells_not_the_pairs(spark, segments, monkeypatch):
    kept, plans = matching.settled, []
    monkeypatch.setattr(matching, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    points = spark.createDataFrame([(1, 99.0, 1.0)], "pid int, x double, y double")
    matching.candidates(points, segments, matching.Config(sigma=2.0, radius_sigmas=5.0)).collect()
    assert "Window" not in plans[0]  # a window over all pairs would sort them on disk


def test_candidates_of_points_that_are_never_null(spark, segments):
    points = spark.range(1).select(F.struct(F.lit(5).alias("obj"), F.lit("a").alias("id")).alias("pid"), F.lit(99.0).alias("x"), F.lit(1.0).alias("y"))
    assert {tuple(r.pid) for r in matching.candidates(points, segments, matching.Config(sigma=2.0, radius_sigmas=5.0)).collect()} == {(5, "a")}


@pytest.mark.parametrize("pairs", [64, 1 << 17])
def test_best_candidates_by_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(matching, "MOST_PAIRS", pairs)
    rng = np.random.default_rng(7)
    px, py, ax, ay = (rng.uniform(0, 60, n) for n in (25, 25, 80, 80))
    bx, by = ax + rng.normal(0, 15, 80), ay + rng.normal(0, 15, 80)
    bx[:5], by[:5] = ax[:5], ay[:5]
    ax[9:12], ay[9:12], bx[9:12], by[9:12] = ax[9], ay[9], bx[9], by[9]  # equals
    px[0], py[0] = 90.0, 90.0  # has only far ones, or none
    k, sigma, radius = 7, 0.8, 24.0
    got = {}
    for i, j, p, t in zip(*matching.best_of(px, py, ax, ay, bx, by, radius, sigma, k), strict=True):
        got.setdefault(int(i), []).append((int(j), p, t))
    for i in range(25):
        raw = {}
        for j in range(80):
            dx, dy = bx[j] - ax[j], by[j] - ay[j]
            t = min(1.0, max(0.0, ((px[i] - ax[j]) * dx + (py[i] - ay[j]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            if np.hypot(px[i] - ax[j] - t * dx, py[i] - ay[j] - t * dy) <= radius:
                raw[j] = line_probability(px[i], py[i], ax[j], ay[j], bx[j], by[j], sigma), t
        best = sorted(raw, key=lambda j: (-raw[j][0], j))[:k]
        mine = sorted(got.get(i, []), key=lambda x: (-x[1], x[0]))
        assert [p for _, p, _ in mine] == pytest.approx([raw[j][0] / sum(p for p, _ in raw.values()) for j in best], rel=1e-9)
        assert all(t == pytest.approx(raw[j][1], abs=1e-9) for j, _, t in mine)
        if all(abs(raw[a][0] - raw[b][0]) > 1e-12 for a, b in zip(best, best[1:])):
            assert [j for j, _, _ in mine] == best


def test_distances_are_rounded_as_in_sql_and_without_decimals(spark, tmp_path):
    import duckdb

    from fleetloom.functions.geometry import rounded
    from fleetloom.plans import proxies

    rng = np.random.default_rng(9)
    halves = [float(f"{k}.5e-9") for k in rng.integers(0, 10**7, 3000)]  # where the text of a number and the number part
    at = pd.DataFrame({"d": [0.0, 0.01, 5e-10, 4.9999999999999996e-10, *halves, *(rng.random(3000) * 0.01)]})
    want = duckdb.sql('SELECT d, round(d, 9) AS r FROM "at"').fetchall()
    assert sorted(map(tuple, spark.createDataFrame(at).select("d", rounded(F.col("d"), 9)).collect())) == sorted(want)
    vectors = [(i, [float(x), float(y)], i % 3) for i, (x, y) in enumerate(rng.normal(0, 0.05, (300, 2)))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    near = proxies.within_distance(spark, str(tmp_path))
    assert "round(" not in near._jdf.queryExecution().optimizedPlan().toString()  # a decimal for each of the pairs
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(map(tuple, near.collect())) == sorted(c.execute(proxies.SQL["within_distance"]).fetchall())
