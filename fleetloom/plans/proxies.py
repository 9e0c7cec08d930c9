"""Every operator as a query on the driver's tables, and the same in SQL.

events is a set of trajectories: obj user_id, seg the event type's number, time ts in microseconds, dist
value; `view` rows stand for fills where an operator needs some. A segment's length is 1 and its number.
The first two dimensions of embeddings are points, consecutive ones of a label segments. Nations joined
by order volume, three strongest ways out of each, are a road graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import angular, graph, joins, kernels, models, sequence, store, tooling, travel_time

TYPES = ("click", "error", "purchase", "signup", "view")


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def traj(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    seg = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")).cast("int") - 1
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    rows = e.select(F.col("user_id").alias("obj"), "event_id", "ts", seg.alias("seg"), us.alias("time"), F.col("value").alias("dist"))
    return sequence.positions(rows, "ts", "event_id").select("obj", "id", "seg", "time", "dist")


def filled(spark: SparkSession, d: str) -> DataFrame:
    """traj with views as fills, lengths, and whole seconds."""
    t = traj(spark, d)
    return t.select("obj", "id", "seg", F.when(F.col("seg") != 4, F.floor(F.col("time") / 1_000_000)).alias("time"), "dist", (F.col("seg") + 1.0).alias("length"))


TRAJ = """traj AS (
  SELECT user_id AS obj, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS id,
         list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS seg, epoch_us(ts) AS time, value AS dist
  FROM events)"""
FILLED = TRAJ + """, filled AS (
  SELECT obj, id, seg, CASE WHEN seg <> 4 THEN time // 1000000 END AS time, dist, seg + 1.0::DOUBLE AS length FROM traj
), chunked AS (
  SELECT *, max(time) OVER c AS t_end, sum(length) OVER c AS whole, sum(length) OVER (PARTITION BY obj, chunk ORDER BY id) AS own, sum(length) OVER (PARTITION BY obj ORDER BY id) AS run
  FROM (SELECT *, coalesce(count(time) OVER (PARTITION BY obj ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk,
               last_value(time IGNORE NULLS) OVER (PARTITION BY obj ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t_start,
               count(time) OVER (PARTITION BY obj) AS n FROM filled)
  WHERE chunk < n WINDOW c AS (PARTITION BY obj, chunk))"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(spark, d):
    """A question from every event: where its object was some hours before."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return _read(spark, d, "events").select(F.col("event_id").alias("qid"), F.col("user_id").alias("obj"), (us - F.col("event_id") % 7 * 3_600_000_000).alias("at"))


ASKED = "asked AS (SELECT event_id AS qid, user_id AS obj, epoch_us(ts) - event_id % 7 * 3600000000 AS at FROM events)"


@query(f"WITH {TRAJ}, {ASKED} SELECT qid, a.obj, a.at, t.seg, t.time FROM asked a ASOF LEFT JOIN traj t ON a.obj = t.obj AND a.at >= t.time")
def where_at_asof(spark, d):
    return joins.as_of(traj(spark, d).select("obj", "id", "seg", "time"), _asked(spark, d), "time", "id").select("qid", "obj", "at", "seg", "time")


@query(f"WITH {TRAJ}, {ASKED} SELECT qid, a.obj, qid % 80 AS at, seg, time FROM asked a ASOF LEFT JOIN traj t ON a.obj = t.obj AND a.qid % 80 >= t.id")
def where_at_id(spark, d):
    asked = _asked(spark, d).withColumn("at", F.col("qid") % 80)
    return joins.as_of(traj(spark, d).select("obj", F.col("id").cast("long").alias("id"), "seg", "time"), asked, "id", "time").select("qid", "obj", "at", "seg", "time")


@query(f"WITH {TRAJ}, {ASKED} SELECT qid, t.obj, id, seg, time FROM asked a JOIN traj t ON a.obj = t.obj AND t.time BETWEEN a.at - 3600000000 AND a.at")
def get_traj_range(spark, d):
    ranges = _asked(spark, d).select("qid", "obj", (F.col("at") - 3_600_000_000).alias("since"), F.col("at").alias("until"))
    return joins.in_range(traj(spark, d), ranges).select("qid", "obj", "id", "seg", "time")


@query(f"WITH {TRAJ} SELECT DISTINCT obj FROM traj WHERE seg = 2 AND time BETWEEN 1704500000000000 AND 1705500000000000")
def objects_on_segment_time(spark, d):
    return joins.objects_on_segment(traj(spark, d), 2, 1_704_500_000_000_000, 1_705_500_000_000_000)


@query(f"WITH {TRAJ} SELECT obj, id, seg, time, round(dist, 6) AS dist FROM traj")
def traj_positions(spark, d):
    return traj(spark, d).withColumn("dist", F.round("dist", 6))


@query(f"WITH {TRAJ} SELECT obj, id, seg, time FROM (SELECT *, lead(seg) OVER (PARTITION BY obj ORDER BY id) AS nxt FROM traj) WHERE nxt IS DISTINCT FROM seg")
def dedup_runs(spark, d):
    return sequence.dedup_runs(traj(spark, d)).select("obj", "id", "seg", "time")


@query(f"WITH {FILLED} SELECT obj, id, seg, chunk FROM chunked")
def online_chunks(spark, d):
    return sequence.online_chunks(filled(spark, d)).select("obj", "id", "seg", "chunk")


@query(f"""WITH {FILLED} SELECT obj, id, seg, run, round(CASE WHEN t_start IS NULL THEN t_end ELSE t_start + (t_end - t_start) * own / whole END, 4) AS t FROM chunked""")
def uniform_times(spark, d):
    return sequence.uniform_times(filled(spark, d)).withColumn("t", F.round("t", 4))


EM = """em AS (
  SELECT obj, max(id) AS id, sum(length) AS dist, max(t_end) - max(t_start) AS dt FROM chunked WHERE chunk > 0 GROUP BY obj, chunk)"""


@query(f"""WITH {FILLED}, {EM} SELECT obj, id, dist, dt, sum(dist) OVER w AS total_dist, CAST(sum(dt) OVER w AS BIGINT) AS total_time,
  round(10 / CASE WHEN dt > 0 AND dist / dt > 0 THEN dist / dt ELSE 40 END, 6) AS sigma FROM em WINDOW w AS (PARTITION BY obj ORDER BY id)""")
def em_windows(spark, d):
    return sequence.em_windows(filled(spark, d)).withColumn("sigma", F.round("sigma", 6))


@query(f"""WITH {FILLED}, {EM}, s AS (SELECT *, dt / dist AS r FROM em WHERE dist > 0 AND dt > 0),
  r AS (SELECT dist / dt AS speed, r - coalesce(lag(r) OVER (PARTITION BY obj ORDER BY id), 0) AS d FROM s)
  SELECT round(avg(speed), 9) AS avg_speed, round(sqrt(avg(d * d)), 3) AS sigma_trans, count(*) AS n FROM r""")
def speed_stats(spark, d):
    return sequence.speed_stats(sequence.em_windows(filled(spark, d))).select(F.round("avg_speed", 9).alias("avg_speed"), F.round("sigma_trans", 3).alias("sigma_trans"), "n")


@query(f"WITH {TRAJ} SELECT obj, id, round(avg(dist) OVER (PARTITION BY obj ORDER BY id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS dist FROM traj")
def smooth_moving_avg(spark, d):
    return sequence.smooth(traj(spark, d), "dist", 3).select("obj", "id", F.round("dist", 6).alias("dist"))


def _as_text(df, column="pattern"):
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), "-"))


GRAMS = """grams AS (
  SELECT 1 AS depth, CAST(seg AS VARCHAR) AS pattern, seg AS a, NULL AS b, NULL AS c FROM traj
  UNION ALL SELECT 2, seg || '-' || s1, seg, s1, NULL FROM l WHERE s1 IS NOT NULL
  UNION ALL SELECT 3, seg || '-' || s1 || '-' || s2, seg, s1, s2 FROM l WHERE s2 IS NOT NULL)"""
LEADS = "l AS (SELECT *, lead(seg) OVER w AS s1, lead(seg, 2) OVER w AS s2 FROM traj WINDOW w AS (PARTITION BY obj ORDER BY id))"


@query(f"WITH {TRAJ}, {LEADS}, {GRAMS} SELECT pattern, depth, count(*) AS freq FROM grams GROUP BY pattern, depth HAVING depth = 1 OR count(*) >= 50")
def freq_subtraj(spark, d):
    return _as_text(models.frequent(traj(spark, d), 3, 50)).select("pattern", "depth", "freq")


@query(f"""WITH {TRAJ}, {LEADS}, {GRAMS}, f AS (SELECT pattern, a, b, c, count(*) AS freq FROM grams WHERE depth >= 2 GROUP BY ALL HAVING count(*) >= 50)
  SELECT DISTINCT seg, pattern, freq FROM (SELECT unnest([a, b, c]) AS seg, pattern, freq FROM f) WHERE seg IS NOT NULL""")
def subtraj_by_segment(spark, d):
    return _as_text(models.patterns_with(models.frequent(traj(spark, d), 3, 50))).select("seg", "pattern", "freq")


@query(f"""WITH {TRAJ}, {LEADS}, {GRAMS}, f AS (SELECT pattern, coalesce(c, b) AS seg, count(*) AS freq FROM grams WHERE depth >= 2 GROUP BY ALL HAVING count(*) >= 50)
  SELECT seg, pattern, freq FROM f""")
def subtraj_by_last_segment(spark, d):
    return _as_text(models.patterns_with(models.frequent(traj(spark, d), 3, 50), last_only=True)).select("seg", "pattern", "freq")


def _model_sql(order: int) -> str:
    lags = ", ".join(f"lag(seg, {k}) OVER w AS p{k}" for k in range(1, order + 1))
    parts = " UNION ALL ".join(
        f"SELECT {k} AS k, {' || chr(45) || '.join(f'p{j}' for j in range(k, 0, -1))}{'' if k > 1 else '::VARCHAR'} AS ctx, seg AS nxt, count(*) AS freq FROM g WHERE p{k} IS NOT NULL GROUP BY ALL" for k in range(1, order + 1)
    )
    return f"""g AS (SELECT *, {lags} FROM traj WINDOW w AS (PARTITION BY obj ORDER BY id)), cnt AS ({parts}),
  model AS (SELECT k, ctx, arg_max(nxt, freq * 100 - nxt) AS nxt, max(freq) AS freq, CAST(sum(freq) AS BIGINT) AS total FROM cnt GROUP BY k, ctx)"""


def _ppm_model(order):
    @query(f"WITH {TRAJ}, {_model_sql(order)} SELECT k, ctx, nxt AS next, freq, total FROM model")
    def run(spark, d):
        return _as_text(models.context_model(traj(spark, d), order), "ctx").select("k", "ctx", "next", "freq", "total")

    QUERIES[f"ppm_model_o{order}"], SQL[f"ppm_model_o{order}"] = QUERIES.pop("run"), SQL.pop("run")


for _order in (1, 2, 3):
    _ppm_model(_order)

KEPT = f"""{TRAJ}, {_model_sql(2)}, hits AS (
  SELECT g.obj, g.id, g.seg, coalesce(m2.nxt, m1.nxt, 0) AS pred, max(g.id) OVER (PARTITION BY g.obj) AS last
  FROM g LEFT JOIN model m1 ON m1.k = 1 AND m1.ctx = g.p1::VARCHAR LEFT JOIN model m2 ON m2.k = 2 AND m2.ctx = g.p2 || '-' || g.p1),
  kept AS (SELECT obj, id, seg FROM hits WHERE id = 0 OR id = last OR seg <> pred)"""


def _kept(spark, d):
    t = traj(spark, d)
    model = kernels.settled(models.context_model(t, 2))
    return t, model, models.context_compress(t, model, 2)


@query(f"WITH {KEPT} SELECT obj, id, seg FROM kept")
def ppm_compress_o2(spark, d):
    return _kept(spark, d)[2].select("obj", "id", "seg")


@query(f"WITH {TRAJ} SELECT obj, id, seg FROM traj")
def ppm_roundtrip_o2(spark, d):
    _, model, kept = _kept(spark, d)
    return models.context_decompress(kept.select("obj", "id", "seg"), model, 2)


@query(f"""WITH {KEPT}, v AS (SELECT (SELECT count(*) FROM traj)::DOUBLE AS o, (SELECT count(*) FROM kept)::DOUBLE AS c, (SELECT count(DISTINCT obj) FROM traj)::DOUBLE AS n)
  SELECT unnest(['num_updates_orig', 'num_updates_comp', 'num_traj', 'compression_ratio']) AS name, unnest([o, c, n, round(o / c, 9)]) AS value FROM v""")
def compression_stats(spark, d):
    t, _, kept = _kept(spark, d)
    return tooling.compression_stats(t, kept).withColumn("value", F.round("value", 9))


def _entropy(order):
    leads = ", ".join(f"lead(seg, {i}) OVER w AS s{i}" for i in range(1, order + 1))
    ctx = ", ".join(["seg", *[f"s{i}" for i in range(1, order)]])
    sql = f"""WITH {TRAJ}, g AS (SELECT seg, {leads} FROM traj WINDOW w AS (PARTITION BY obj ORDER BY id)),
      c AS (SELECT {ctx}, s{order} AS nx, count(*) AS n FROM g WHERE s{order} IS NOT NULL GROUP BY ALL), p AS (SELECT max(n) AS top, sum(n) AS n FROM c GROUP BY {ctx})
      SELECT round(1 - sum(top) / sum(n), 9) AS entropy, count(*) AS contexts FROM p"""

    def run(spark, d):
        return models.conditional_entropy(traj(spark, d), order).select(F.round("entropy", 9).alias("entropy"), "contexts")

    QUERIES[f"cond_entropy_o{order}"], SQL[f"cond_entropy_o{order}"] = run, sql


for _order in range(1, 7):
    _entropy(_order)


@query(f"""WITH {TRAJ}, s AS (SELECT seg, avg(dist) AS mu, 1 + stddev_pop(dist) AS sigma FROM traj GROUP BY seg)
  SELECT CAST(i AS INTEGER) AS seg, round(coalesce(mu, (i + 1) / 2.0), 6) AS mu, round(coalesce(sigma, (i + 1) / 5.0), 6) AS sigma FROM range(0, 7) r(i) LEFT JOIN s ON s.seg = i""")
def segment_time_model(spark, d):
    times = traj(spark, d).select("seg", F.col("dist").alias("x"))
    every = spark.range(7).select(F.col("id").cast("int").alias("seg"), (F.col("id") + 1.0).alias("length"))
    return travel_time.maximise(times, every, 2.0).select("seg", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


# Graph


def nation_edges(spark, d):
    o, c, l_, s = (_read(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier"))
    flows = l_.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    volume = flows.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return volume.withColumn("r", rank).where("r <= 3").select("src", "dst", (F.col("src") + 10.0).alias("weight"), "n")


EDGES = """edges AS (
  SELECT src, dst, src + 10.0::DOUBLE AS weight, n FROM (
    SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) WHERE r <= 3)"""


def _nation_segments(spark, d):
    return nation_edges(spark, d).select((F.col("src") * 100 + F.col("dst")).alias("seg"), F.col("src").alias("p_begin"), F.col("dst").alias("p_end"), F.col("n").cast("double").alias("length"))


@query(f"WITH {EDGES} SELECT a.src * 100 + a.dst AS src, b.src * 100 + b.dst AS dst, a.n::DOUBLE AS weight FROM edges a JOIN edges b ON a.dst = b.src AND NOT (a.src = b.src AND a.dst = b.dst)")
def adjacency(spark, d):
    return graph.adjacency(_nation_segments(spark, d))


@query(f"WITH {EDGES} SELECT src, count(*) AS degree FROM edges GROUP BY src")
def edge_degree(spark, d):
    return nation_edges(spark, d).groupBy("src").agg(F.count("*").alias("degree"))


@query(f"WITH RECURSIVE {EDGES}, h(src, node, hops) AS (SELECT DISTINCT src, src, 0 FROM edges UNION SELECT h.src, e.dst, h.hops + 1 FROM h JOIN edges e ON h.node = e.src WHERE hops < 3) SELECT src, node, min(hops) AS hops FROM h GROUP BY src, node")
def hops_k(spark, d):
    e = nation_edges(spark, d)
    return graph.hops(e, e.select("src").distinct(), 3)


PATHS = f"""{EDGES}, p(src, dst, d) AS (SELECT DISTINCT src, src, 0.0::DOUBLE FROM edges UNION SELECT p.src, e.dst, p.d + e.weight FROM p JOIN edges e ON p.dst = e.src WHERE p.d + e.weight <= 60),
  sp AS (SELECT src, dst, min(d) AS d FROM p GROUP BY src, dst)"""


@query(f"WITH RECURSIVE {PATHS} SELECT a.src::BIGINT AS src, a.dst::BIGINT AS dst, a.d, min(CASE WHEN e.src IS NOT NULL THEN b.dst END)::BIGINT AS pred FROM sp a LEFT JOIN sp b ON a.src = b.src AND a.src <> a.dst LEFT JOIN edges e ON e.src = b.dst AND e.dst = a.dst AND b.d + e.weight = a.d GROUP BY ALL")
def sp_bounded(spark, d):
    e = nation_edges(spark, d)
    return graph.shortest_paths(e, 60.0, e.select("src").distinct())


@query(f"WITH RECURSIVE {PATHS} SELECT src::BIGINT AS src, dst::BIGINT AS dst, d, d - (src + 10) AS path_length FROM sp WHERE src <> dst")
def sp_path(spark, d):
    e = nation_edges(spark, d)
    return graph.path_table(graph.shortest_paths(e, 60.0, e.select("src").distinct())).select("src", "dst", "d", "path_length")


def _rank_sql(rounds: int) -> str:
    out = f"WITH {EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"
    for i in range(rounds):
        out += f""", g{i} AS (SELECT e.dst, sum(r.rank / g.deg) AS got FROM edges e JOIN deg g ON g.src = e.src JOIN r{i} r ON r.node = e.src GROUP BY e.dst),
  r{i + 1} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM deg)) / (SELECT count(*) FROM nodes)) AS rank FROM nodes n LEFT JOIN g{i} g ON g.dst = n.node)"""
    return out


@query(_rank_sql(5) + " SELECT node, round(rank, 9) AS rank FROM r5")
def pagerank_k_iters(spark, d):
    return graph.pagerank(nation_edges(spark, d), 5).select("node", F.round("rank", 9).alias("rank"))


@query(_rank_sql(5) + " SELECT round(1 - sum(rank / deg), 9) AS entropy FROM r5 JOIN deg ON src = node")
def network_entropy(spark, d):
    e = nation_edges(spark, d)
    return graph.network_entropy(e, graph.pagerank(e, 5)).select(F.round("entropy", 9).alias("entropy"))


@query(f"WITH {TRAJ}, f AS (SELECT obj, min(time) AS t FROM traj GROUP BY obj) SELECT obj, CAST((row_number() OVER (ORDER BY t, obj) - 1) % 10 AS INTEGER) AS fold FROM f")
def folds_10(spark, d):
    return tooling.folds(traj(spark, d), "time")


# Geometry


def _points(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _segments(spark, d):
    w = Window.partitionBy("label").orderBy("pid")
    p = _points(spark, d).withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).where("bx is not null")
    return p.select(F.col("pid").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


PTS = """pts AS (SELECT vec_id AS pid, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
  segs AS (SELECT pid AS seg, x AS ax, y AS ay, bx, by_ FROM (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM pts WINDOW w AS (PARTITION BY label ORDER BY pid)) WHERE bx IS NOT NULL),
  near AS (SELECT pid, seg, x, y, ax, ay, bx, by_, greatest(0, least(1, coalesce(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0))) AS t FROM pts, segs),
  ends_ AS (SELECT *, CASE WHEN t >= 1 THEN bx ELSE ax + t * (bx - ax) END AS cx, CASE WHEN t >= 1 THEN by_ ELSE ay + t * (by_ - ay) END AS cy FROM near),
  dists AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM ends_)"""


@query(f"WITH {PTS} SELECT pid, seg, round(d, 9) AS d FROM dists WHERE d <= 0.01")
def within_distance(spark, d):
    return joins.within_distance(_points(spark, d), _segments(spark, d), 0.01).withColumn("d", geo.rounded(F.col("d"), 9))


@query(f"WITH {PTS} SELECT pid, seg, round(d, 9) AS d, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, seg) AS rank FROM dists) WHERE rank <= 3")
def knn_k(spark, d):
    return joins.nearest(_points(spark, d), _segments(spark, d), 3, 0.1).withColumn("d", F.round("d", 9))


def _pairs(spark, d):
    s = _segments(spark, d)
    return _points(spark, d).join(s, F.col("seg") == F.col("pid") - F.col("pid") % 5)


XY = ("x", "y", "ax", "ay", "bx", "by")


@query(f"WITH {PTS} SELECT pid, round(ax + t * (bx - ax), 9) AS cx, round(ay + t * (by_ - ay), 9) AS cy FROM near WHERE seg = pid - pid % 5")
def closest_point_on_segment(spark, d):
    cx, cy = geo.closest_point(*map(F.col, XY))
    return _pairs(spark, d).select("pid", F.round(cx, 9).alias("cx"), F.round(cy, 9).alias("cy"))


@query(f"WITH {PTS} SELECT pid, round(d, 9) AS d FROM dists WHERE seg = pid - pid % 5")
def point_segment_distance(spark, d):
    return _pairs(spark, d).select("pid", F.round(geo.distance_point_segment(*map(F.col, XY)), 9).alias("d"))


@query(f"WITH {PTS} SELECT pid, round(exp(-abs(d - 2 * d) / 1.5) / 1.5, 9) AS p FROM dists WHERE seg = pid - pid % 5")
def transition_prob(spark, d):
    dist = geo.distance_point_segment(*map(F.col, XY))
    return _pairs(spark, d).select("pid", F.round(geo.transition_probability(dist, 2 * dist, F.lit(5)), 9).alias("p"))


@query(f"""WITH {PTS}, g AS (SELECT pid, (bx - ax) ** 2 + (by_ - ay) ** 2 AS l, 2 * ((ax - x) * (bx - ax) + (ay - y) * (by_ - ay)) AS b, (ax - x) ** 2 + (ay - y) ** 2 AS c FROM near WHERE seg = pid - pid % 5),
  e AS (SELECT *, (2 * l + b) / (sqrt(l) * sqrt(2)) AS hi, b / (sqrt(l) * sqrt(2)) AS lo FROM g)
  SELECT pid, round(exp((b * b / (4 * l) - c) / 0.5) * 0.5 * list_sum(list_transform(range(0, 60), lambda n: (-1) ** n * (hi ** (2 * n + 1) - lo ** (2 * n + 1)) / (gamma(n + 1) * (2 * n + 1)))) * 2 / sqrt(pi()), 9) AS p FROM e""")
def emission_prob(spark, d):
    return _pairs(spark, d).select("pid", F.round(geo.segment_probability(0.5)(*map(F.col, XY)), 9).alias("p"))


# Kernels

TYPE_EDGES = """type_edges AS (
  SELECT DISTINCT seg AS src, nxt AS dst, seg + 1.0::DOUBLE AS weight FROM (SELECT seg, lead(seg) OVER (PARTITION BY obj ORDER BY id) AS nxt FROM traj)
  WHERE nxt IS NOT NULL AND nxt <> seg AND abs(nxt - seg) <> 2),
  tp(src, dst, d) AS (SELECT DISTINCT src, src, 0.0::DOUBLE FROM type_edges UNION SELECT tp.src, e.dst, tp.d + e.weight FROM tp JOIN type_edges e ON tp.dst = e.src WHERE tp.d + e.weight <= 100),
  tsp AS (SELECT src, dst, min(d) AS d FROM tp GROUP BY src, dst),
  preds AS (SELECT a.src, a.dst, a.d, min(b.dst) AS pred FROM tsp a JOIN tsp b ON a.src = b.src JOIN type_edges e ON e.src = b.dst AND e.dst = a.dst AND b.d + e.weight = a.d WHERE a.src <> a.dst GROUP BY ALL),
  walk(src, dst, d, here, via) AS (SELECT src, dst, d, pred, CAST([] AS INTEGER[]) FROM preds
    UNION ALL SELECT w.src, w.dst, w.d, p.pred, list_prepend(w.here::INTEGER, w.via) FROM walk w JOIN preds p ON p.src = w.src AND p.dst = w.here WHERE w.here <> w.src),
  ways AS (SELECT src, dst, d, via, d - (src + 1) AS path_length FROM walk WHERE here = src)"""
RUNS = """runs AS (SELECT obj, id, seg, time, row_number() OVER (PARTITION BY obj ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY obj) AS n
  FROM (SELECT *, lead(seg) OVER (PARTITION BY obj ORDER BY id) AS nxt FROM traj) WHERE nxt IS DISTINCT FROM seg)"""
PATH_KEPT = """ahead AS (SELECT *, lead(seg) OVER (PARTITION BY obj ORDER BY pos) AS nx FROM runs),
  pk(obj, pos, start, kept) AS (SELECT obj, pos, seg, true FROM ahead WHERE pos = 0
    UNION ALL SELECT a.obj, a.pos, CASE WHEN p.pred IS DISTINCT FROM a.seg AND a.pos < a.n - 1 THEN a.seg ELSE k.start END, a.pos = a.n - 1 OR p.pred IS DISTINCT FROM a.seg
    FROM pk k JOIN ahead a ON a.obj = k.obj AND a.pos = k.pos + 1 LEFT JOIN preds p ON p.src = k.start AND p.dst = a.nx),
  left_rows AS (SELECT a.obj, a.id, a.seg FROM pk JOIN ahead a USING (obj, pos) WHERE kept)"""


def _parse_sql(rows: str, least: int) -> str:
    """Patterns of up to three of rows, and the parse: from the end the longest that ends there, then on before it."""
    return f"""b AS (SELECT obj, seg, lag(seg) OVER w AS s1, lag(seg, 2) OVER w AS s2, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY obj) AS n FROM {rows} WINDOW w AS (PARTITION BY obj ORDER BY id)),
  f2 AS (SELECT s1, seg FROM b WHERE s1 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
  f3 AS (SELECT s2, s1, seg FROM b WHERE s2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
  ending AS (SELECT b.obj, b.pos, b.n, CASE WHEN f3.seg IS NOT NULL THEN 3 WHEN f2.seg IS NOT NULL THEN 2 ELSE 1 END AS len, concat_ws('-', CASE WHEN f3.seg IS NOT NULL THEN b.s2 END, CASE WHEN f2.seg IS NOT NULL THEN b.s1 END, b.seg) AS pattern
    FROM b LEFT JOIN f2 ON f2.s1 = b.s1 AND f2.seg = b.seg LEFT JOIN f3 ON f3.s2 = b.s2 AND f3.s1 = b.s1 AND f3.seg = b.seg),
  parse(obj, pos, len, pattern, step) AS (SELECT obj, pos, len, pattern, 0 FROM ending WHERE pos = n - 1
    UNION ALL SELECT e.obj, e.pos, e.len, e.pattern, p.step + 1 FROM parse p JOIN ending e ON e.obj = p.obj AND e.pos = p.pos - p.len),
  parsed AS (SELECT obj, CAST(max(step) OVER (PARTITION BY obj) - step AS INTEGER) AS place, pattern FROM parse)"""


TIMES = "times AS (SELECT seg, avg(dist * 100) AS mu, 1 + stddev_pop(dist * 100) AS sigma FROM traj GROUP BY seg)"


def _lengths(spark):
    return spark.range(5).select(F.col("id").cast("int").alias("seg"), (F.col("id") + 1.0).alias("length"))


def _type_edges(spark, d):
    t = traj(spark, d)
    pairs = t.select("seg", F.lead("seg").over(sequence.along()).alias("dst")).where("dst is not null and dst <> seg and abs(dst - seg) <> 2").distinct()
    return pairs.select(F.col("seg").alias("src"), "dst", (F.col("seg") + 1.0).alias("weight"))


def _type_paths(spark, d):
    return graph.shortest_paths(_type_edges(spark, d), 100.0)


@query(f"WITH RECURSIVE {TRAJ}, {TYPE_EDGES}, {RUNS}, {PATH_KEPT} SELECT obj, id, seg FROM left_rows")
def sp_compress(spark, d):
    return models.path_compress(sequence.dedup_runs(traj(spark, d)), _type_paths(spark, d))


@query(f"WITH {TRAJ}, {RUNS} SELECT obj, pos AS id, seg FROM runs")
def sp_roundtrip(spark, d):
    """Runs as a trajectory of their own on the graph of all steps, compressed by paths and restored."""
    t = sequence.renumbered(sequence.dedup_runs(traj(spark, d)), "id")
    steps = t.select(F.col("seg").alias("src"), F.lead("seg").over(sequence.along()).alias("dst")).where("dst is not null").distinct()
    paths = graph.shortest_paths(steps.withColumn("weight", F.col("src") + 1.0), 100.0)
    return models.path_decompress(models.path_compress(t, paths), graph.path_table(paths)).withColumn("id", F.col("id").cast("long"))


@query(f"WITH RECURSIVE {TRAJ}, {_parse_sql('traj', 50)} SELECT obj, place, pattern FROM parsed")
def fs_compress(spark, d):
    t = traj(spark, d)
    return _as_text(models.pattern_compress(t, models.frequent(t, 3, 50)))


@query(f"WITH {TRAJ} SELECT obj, id, seg FROM traj")
def fs_roundtrip(spark, d):
    t = traj(spark, d)
    parsed = models.pattern_compress(t, models.frequent(t, 3, 50))
    w = Window.partitionBy("obj").orderBy("place", "i")
    return parsed.select("obj", "place", F.posexplode("pattern").alias("i", "seg")).select("obj", (F.row_number().over(w) - 1).alias("id"), "seg")


@query(f"WITH RECURSIVE {TRAJ}, {TYPE_EDGES}, {RUNS}, {PATH_KEPT}, {_parse_sql('left_rows', 20)} SELECT obj, place, pattern FROM parsed")
def spfs_compress(spark, d):
    runs = sequence.dedup_runs(traj(spark, d))
    return _as_text(models.path_pattern_compress(runs, _type_paths(spark, d), runs, 3, 20))


@query(f"""WITH RECURSIVE {FILLED}, {TYPE_EDGES}, {RUNS}, {PATH_KEPT}, {_parse_sql('left_rows', 20)},
  timed AS (SELECT r.obj, r.pos, r.seg, f.time FROM runs r JOIN filled f USING (obj, id)),
  late(obj, pos, seg, piece, start) AS (SELECT obj, pos, seg, 0, time FROM timed WHERE pos = 0
    UNION ALL SELECT t.obj, t.pos, t.seg, CASE WHEN t.time - l.start > 86400 THEN l.piece + 1 ELSE l.piece END, CASE WHEN t.time IS NULL THEN l.start WHEN l.start IS NULL OR t.time - l.start > 86400 THEN t.time ELSE l.start END
    FROM late l JOIN timed t ON t.obj = l.obj AND t.pos = l.pos + 1),
  own AS (SELECT *, row_number() OVER w - 1 AS at_, count(*) OVER (PARTITION BY obj, piece) AS m, lead(seg) OVER w AS nx FROM late WINDOW w AS (PARTITION BY obj, piece ORDER BY pos)),
  ck(obj, piece, at_, start, kept) AS (SELECT obj, piece, at_, seg, true FROM own WHERE at_ = 0
    UNION ALL SELECT a.obj, a.piece, a.at_, CASE WHEN p.pred IS DISTINCT FROM a.seg AND a.at_ < a.m - 1 THEN a.seg ELSE k.start END, a.at_ = a.m - 1 OR p.pred IS DISTINCT FROM a.seg
    FROM ck k JOIN own a ON a.obj = k.obj AND a.piece = k.piece AND a.at_ = k.at_ + 1 LEFT JOIN preds p ON p.src = k.start AND p.dst = a.nx),
  b2 AS (SELECT obj, piece, seg, lag(seg) OVER w AS s1, lag(seg, 2) OVER w AS s2, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY obj, piece) AS n FROM ck JOIN own USING (obj, piece, at_) WHERE kept WINDOW w AS (PARTITION BY obj, piece ORDER BY at_)),
  e2 AS (SELECT b2.obj, b2.piece, b2.pos, b2.n, CASE WHEN f3.seg IS NOT NULL THEN 3 WHEN f2.seg IS NOT NULL THEN 2 ELSE 1 END AS len, concat_ws('-', CASE WHEN f3.seg IS NOT NULL THEN b2.s2 END, CASE WHEN f2.seg IS NOT NULL THEN b2.s1 END, b2.seg) AS pattern
    FROM b2 LEFT JOIN f2 ON f2.s1 = b2.s1 AND f2.seg = b2.seg LEFT JOIN f3 ON f3.s2 = b2.s2 AND f3.s1 = b2.s1 AND f3.seg = b2.seg),
  p2(obj, piece, pos, len, pattern) AS (SELECT obj, piece, pos, len, pattern FROM e2 WHERE pos = n - 1 UNION ALL SELECT e.obj, e.piece, e.pos, e.len, e.pattern FROM p2 p JOIN e2 e ON e.obj = p.obj AND e.piece = p.piece AND e.pos = p.pos - p.len)
  SELECT obj, CAST(row_number() OVER (PARTITION BY obj ORDER BY piece, pos) - 1 AS INTEGER) AS place, pattern FROM p2""")
def spfs_compress_delay(spark, d):
    """The same in chunks of a day; each is parsed by itself."""
    runs = sequence.dedup_runs(filled(spark, d))
    return _as_text(models.path_pattern_compress(runs, _type_paths(spark, d), runs, 3, 20, 86_400))


@query(f"WITH {TRAJ}, {LEADS}, {GRAMS}, f AS (SELECT pattern, depth, a, b, c, count(*) AS freq FROM grams GROUP BY ALL HAVING depth = 1 OR count(*) >= 50) SELECT pattern, repeat('  ', depth - 1) || coalesce(c, b, a) || ' ' || freq AS line FROM f")
def pattern_tree(spark, d):
    return _as_text(models.pattern_tree(models.frequent(traj(spark, d), 3, 50)))


def _curves(spark, d):
    return sequence.uniform_times(filled(spark, d)).select("obj", "id", F.col("run").alias("dist"), (F.col("t") / 3600).alias("time"))


def _curve_sql(error: float, by_time: bool) -> str:
    """The fold over a curve: s, the point kept last; low and high, the slopes that still fit (null: any); keep, whether the point before is kept."""
    from_start = "c.dist - k.sd", "c.time - k.st"
    if by_time:
        slack = "1e-9 * greatest(1.0, abs(dd))"
        low = f"CASE WHEN {{d}} > 0 AND {{t}} + {error} > 0 THEN greatest(coalesce({{low}}, '-infinity'::DOUBLE), {{d}} / ({{t}} + {error})) ELSE {{low}} END"
        high = f"CASE WHEN {{d}} > 0 AND {{t}} - {error} > 0 THEN least(coalesce({{high}}, 'infinity'::DOUBLE), {{d}} / ({{t}} - {error})) ELSE {{high}} END"
    else:
        slack = "0.001"
        low = f"CASE WHEN {{t}} > 0 THEN greatest(coalesce({{low}}, '-infinity'::DOUBLE), ({{d}} - {error}) / {{t}}) ELSE {{low}} END"
        high = f"CASE WHEN {{t}} > 0 THEN least(coalesce({{high}}, 'infinity'::DOUBLE), ({{d}} + {error}) / {{t}}) ELSE {{high}} END"
    stay = {"d": "dd", "t": "tt", "low": "low", "high": "high"}
    anew = {"d": "(dist - pd)", "t": "(time - pt)", "low": "NULL", "high": "NULL"}
    reset = (low.format(**anew), high.format(**anew)) if by_time else ("NULL", "NULL")
    return f"""WITH RECURSIVE {FILLED}, curve AS (
    SELECT obj, id, run AS dist, CASE WHEN t_start IS NULL THEN t_end::DOUBLE ELSE t_start + (t_end - t_start) * own / whole END / 3600 AS time,
           row_number() OVER (PARTITION BY obj ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY obj) AS m FROM chunked),
  fold(obj, i, sd, st, pd, pt, low, high, keep) AS (
    SELECT obj, i, dist, time, dist, time, NULL::DOUBLE, NULL::DOUBLE, false FROM curve WHERE i = 0
    UNION ALL
    SELECT obj, i, CASE WHEN fits THEN sd ELSE pd END, CASE WHEN fits THEN st ELSE pt END, dist, time,
           CASE WHEN fits THEN {low.format(**stay)} ELSE {reset[0]} END, CASE WHEN fits THEN {high.format(**stay)} ELSE {reset[1]} END, NOT fits
    FROM (SELECT *, (low IS NULL OR low * tt - {slack} <= dd) AND (high IS NULL OR dd <= high * tt + {slack}) AS fits
          FROM (SELECT c.obj, c.i, c.dist, c.time, k.sd, k.st, k.pd, k.pt, k.low, k.high, {from_start[0]} AS dd, {from_start[1]} AS tt FROM fold k JOIN curve c ON c.obj = k.obj AND c.i = k.i + 1)))
  SELECT c.obj, c.id, c.dist, round(c.time, 6) AS time FROM curve c LEFT JOIN fold f ON f.obj = c.obj AND f.i = c.i + 1 WHERE c.i = 0 OR c.i = c.m - 1 OR f.keep"""


@query(_curve_sql(6.0, True))
def nstd_compress(spark, d):
    return angular.angular_compress(_curves(spark, d), 6.0, by_time=True).withColumn("time", F.round("time", 6))


@query(_curve_sql(4.0, False))
def tsnd_compress(spark, d):
    return angular.angular_compress(_curves(spark, d), 4.0, by_time=False).withColumn("time", F.round("time", 6))


@query(f"""WITH RECURSIVE {FILLED}, r(obj, id, seg, chunk, start) AS (SELECT obj, id, seg, 0, time FROM filled WHERE id = 0
  UNION ALL SELECT f.obj, f.id, f.seg, CASE WHEN f.time - r.start > 86400 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN f.time IS NULL THEN r.start WHEN r.start IS NULL OR f.time - r.start > 86400 THEN f.time ELSE r.start END
  FROM r JOIN filled f ON f.obj = r.obj AND f.id = r.id + 1) SELECT obj, id, seg, chunk FROM r""")
def delay_chunks(spark, d):
    return sequence.delay_chunks(filled(spark, d), 86_400)


@query(f"""WITH RECURSIVE {FILLED}, o AS (SELECT obj, chunk AS k, CASE WHEN time > t_start THEN (whole - length) / (time - t_start) ELSE 'infinity'::DOUBLE END BETWEEN 0.00001 AND 0.01 AS fits FROM chunked WHERE time IS NOT NULL),
  r(obj, k, piece, skip) AS (SELECT obj, k, 0, false FROM o WHERE k = 0 UNION ALL SELECT o.obj, o.k, CASE WHEN r.skip OR o.fits THEN r.piece ELSE r.piece + 1 END, NOT (r.skip OR o.fits) FROM r JOIN o ON o.obj = r.obj AND o.k = r.k + 1)
  SELECT c.obj, c.id, c.seg, r.piece FROM chunked c JOIN r ON r.obj = c.obj AND r.k = c.chunk WHERE c.time IS NOT NULL OR (r.k > 0 AND NOT r.skip)""")
def break_by_speed(spark, d):
    return sequence.break_by_speed(filled(spark, d), 0.00001, 0.01)


def _times(spark, d):
    return travel_time.maximise(traj(spark, d).select("seg", (F.col("dist") * 100).alias("x")), _lengths(spark), 0.001)


@query()
def em_train(spark, d):
    model, _ = travel_time.train(filled(spark, d), _lengths(spark), 0.0001, 1000.0, 2)
    return model


@query(f"""WITH {FILLED}, {TIMES}, x AS (SELECT obj, id, seg, chunk, length, time, (t_end - t_start) * length / whole AS x, t_start, t_end FROM chunked WHERE chunk > 0),
  p AS (SELECT *, x / length - lag(x / length) OVER (PARTITION BY obj ORDER BY id) AS turn FROM x JOIN times USING (seg)),
  g AS (SELECT sum(x) AS x, max(t_end) - max(t_start) AS dt, sum(length) AS len FROM x GROUP BY obj, chunk),
  m AS (SELECT sum(((x - dt) / (10 / CASE WHEN dt > 0 AND len / dt > 0 THEN len / dt ELSE 40 END)) ** 2 / 2) AS miss FROM g)
  SELECT round((sum(((x - mu) / sigma) ** 2 / 2 + ln(sigma) + coalesce((turn / 1000.0) ** 2 / 2, 0)) + (SELECT miss FROM m)) / 1e6, 3) AS value, count(*) AS n FROM p""")
def em_objective(spark, d):
    t = filled(spark, d)
    return travel_time.objective(t, travel_time.start_times(t), _times(spark, d), 1000.0).select(F.round(F.col("value") / 1e6, 3).alias("value"), "n")


@query(f"""WITH RECURSIVE {FILLED}, {TIMES}, rows_ AS (
    SELECT c.obj, c.id, c.seg, c.time, mu, sigma, row_number() OVER (PARTITION BY c.obj ORDER BY c.id) - 1 AS i, c.time - c.t_start AS seconds, 10 / CASE WHEN c.time > c.t_start AND c.whole / (c.time - c.t_start) > 0 THEN c.whole / (c.time - c.t_start) ELSE 40 END AS noise
    FROM (SELECT * FROM chunked WHERE chunk > 0 OR time IS NOT NULL) c JOIN times USING (seg)),
  f(obj, i, told, fused, ahead, spread, kept, best) AS (SELECT obj, i, time::DOUBLE, time::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, true, time::DOUBLE FROM rows_ WHERE i = 0
    UNION ALL SELECT obj, i, CASE WHEN time IS NULL THEN told WHEN miss THEN fresh ELSE told + ahead END, CASE WHEN time IS NULL THEN fused ELSE fresh END, CASE WHEN time IS NULL THEN ahead ELSE 0.0 END, CASE WHEN time IS NULL THEN spread ELSE 0.0 END, time IS NOT NULL AND miss, fresh
    FROM (SELECT *, abs(told + ahead - fresh) > 20000 AS miss FROM (
      SELECT r.obj, r.i, r.time, f.told, f.fused, f.ahead + r.mu AS ahead, f.spread + r.sigma ** 2 AS spread, f.fused + (f.ahead + r.mu + (f.spread + r.sigma ** 2) / (f.spread + r.sigma ** 2 + r.noise ** 2) * (r.seconds - (f.ahead + r.mu))) AS fresh
      FROM f JOIN rows_ r ON r.obj = f.obj AND r.i = f.i + 1)))
  SELECT r.obj, r.id, r.seg, round(f.best, 3) AS time FROM f JOIN rows_ r USING (obj, i) WHERE kept""")
def em_compress(spark, d):
    return travel_time.time_compress(filled(spark, d), _times(spark, d), 20_000.0).withColumn("time", F.round("time", 3))


RESTORED = f"""{FILLED}, {TIMES}, k AS (SELECT obj, id, seg, time, mu, count(time) OVER w AS k, last_value(time IGNORE NULLS) OVER w AS before, sum(mu) OVER w AS run,
    first_value(time IGNORE NULLS) OVER (PARTITION BY obj ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after, lead(mu) OVER (PARTITION BY obj ORDER BY id) AS own
    FROM filled JOIN times USING (seg) WINDOW w AS (PARTITION BY obj ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  l AS (SELECT *, run - min(run) OVER p AS part, max(run + own) OVER p - min(run) OVER p AS whole FROM k WINDOW p AS (PARTITION BY obj, k))"""


@query(f"WITH {RESTORED} SELECT obj, id, seg, round(coalesce(time::DOUBLE, before + (after - before) * (part / nullif(whole, 0))), 3) AS time FROM l")
def time_restore(spark, d):
    return travel_time.time_restore(filled(spark, d), _times(spark, d)).withColumn("time", F.round("time", 3))


def _combined(spark, d):
    t = filled(spark, d)
    model = kernels.settled(models.context_model(t, 2))
    flags = models.predicted(t, model, 2).select("obj", "id", (F.col("seg") == F.col("pred")).alias("hit"))
    return t, model, travel_time.combined_compress(t, flags, _times(spark, d), 20_000.0)


@query(f"WITH {TRAJ} SELECT obj, id, seg FROM traj")
def combined_roundtrip(spark, d):
    _, model, kept = _combined(spark, d)
    return models.context_decompress(kept.select("obj", "id", "seg"), model, 2)


def _asked_seconds(spark, d):
    return _asked(spark, d).withColumn("at", F.floor(F.col("at") / 1_000_000).cast("double"))


#: What the combined compressor stores, the times of all rows from it, and the latest row of each question.
COMPRESSED = f"""WITH RECURSIVE {FILLED}, {_model_sql(2)}, {TIMES}, hits AS (
    SELECT g.obj, g.id, g.seg = coalesce(m2.nxt, m1.nxt, 0) AS hit FROM g LEFT JOIN model m1 ON m1.k = 1 AND m1.ctx = g.p1::VARCHAR LEFT JOIN model m2 ON m2.k = 2 AND m2.ctx = g.p2 || '-' || g.p1),
  parts AS (SELECT *, coalesce(count(time) OVER (PARTITION BY obj ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk, count(time) OVER (PARTITION BY obj) AS n, max(id) OVER (PARTITION BY obj) AS last_id FROM filled JOIN times USING (seg)),
  sums AS (SELECT *, sum(length) OVER (PARTITION BY obj, chunk ORDER BY id) AS own, sum(length) OVER c AS whole, sum(mu) OVER c AS ahead, sum(sigma ** 2) OVER c AS spread, max(time) OVER c AS t_end FROM parts WINDOW c AS (PARTITION BY obj, chunk)),
  obs AS (SELECT obj, chunk, any_value(ahead) AS ahead, any_value(spread) AS spread, any_value(whole) AS whole, max(time) AS t FROM sums WHERE chunk < n GROUP BY obj, chunk),
  fold(obj, chunk, t, told, fused, begin, step, missed) AS (SELECT obj, chunk, t, t::DOUBLE, t::DOUBLE, t::DOUBLE, 0.0::DOUBLE, true FROM obs WHERE chunk = 0
    UNION ALL SELECT obj, chunk, t, CASE WHEN miss THEN fresh ELSE told + ahead END, fresh, told, CASE WHEN miss THEN fresh - told ELSE ahead END, miss
    FROM (SELECT *, abs(told + ahead - fresh) > 20000 AS miss FROM (
      SELECT o.obj, o.chunk, o.t, o.ahead, f.told, f.fused + (o.ahead + o.spread / (o.spread + (10 / CASE WHEN o.t > f.t AND o.whole / (o.t - f.t) > 0 THEN o.whole / (o.t - f.t) ELSE 40 END) ** 2) * ((o.t - f.t) - o.ahead)) AS fresh
      FROM fold f JOIN obs o ON o.obj = f.obj AND o.chunk = f.chunk + 1))),
  ends AS (SELECT obj, arg_max(told, chunk) AS told FROM fold GROUP BY obj),
  stored AS (SELECT s.obj, s.id, s.seg, s.mu,
      CASE WHEN s.chunk = 0 AND s.time IS NOT NULL THEN f.told
           WHEN s.chunk = 0 AND s.n > 0 THEN NULL
           WHEN s.chunk < s.n AND (NOT h.hit OR (s.time IS NOT NULL AND f.missed)) THEN CASE WHEN h.hit THEN f.fused ELSE f.begin + f.step * s.own / s.whole END
           WHEN s.chunk >= s.n AND NOT h.hit THEN e.told + s.ahead * s.own / s.whole
           WHEN s.id = s.last_id AND s.chunk < s.n THEN f.told
           WHEN s.id = s.last_id THEN e.told + s.ahead END AS time
    FROM sums s JOIN hits h USING (obj, id) LEFT JOIN fold f ON f.obj = s.obj AND f.chunk = s.chunk LEFT JOIN ends e ON e.obj = s.obj),
  k AS (SELECT obj, id, seg, time, count(time) OVER w AS k, last_value(time IGNORE NULLS) OVER w AS before, sum(mu) OVER w AS run,
    first_value(time IGNORE NULLS) OVER (PARTITION BY obj ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after, lead(mu) OVER (PARTITION BY obj ORDER BY id) AS own
    FROM stored WINDOW w AS (PARTITION BY obj ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  l AS (SELECT *, run - min(run) OVER p AS part, max(run + own) OVER p - min(run) OVER p AS whole FROM k WINDOW p AS (PARTITION BY obj, k)),
  full_ AS (SELECT obj, id, seg, coalesce(time, before + (after - before) * (part / nullif(whole, 0))) AS time FROM l), {ASKED},
  found AS (SELECT qid, max(struct_pack(t := f.time, id := f.id, seg := f.seg)) AS b FROM asked a JOIN full_ f ON f.obj = a.obj AND f.time <= a.at // 1000000 GROUP BY qid)
  SELECT a.qid, a.obj, (a.at // 1000000)::DOUBLE AS at, b.id AS id, b.seg AS seg, round(b.t, 3) AS time FROM asked a LEFT JOIN found USING (qid)"""


@query(COMPRESSED)
def where_at_compressed(spark, d):
    _, model, kept = _combined(spark, d)
    return joins.as_of(store.restored(kernels.settled(kept), model, _times(spark, d), 2), _asked_seconds(spark, d), "time", "id").withColumn("time", F.round("time", 3))


@query(COMPRESSED)
def where_at_part(spark, d):
    """The same answers from the stretches that questions fall into."""
    _, model, kept = _combined(spark, d)
    return store.where_at_part(kernels.settled(kept), _asked_seconds(spark, d), model, _times(spark, d), 2).withColumn("time", F.round("time", 3))


# Sequences, continued


@query(f"WITH {FILLED} SELECT obj, id, seg, run, CASE WHEN t_start IS NULL THEN t_end::DOUBLE ELSE floor(t_end + (t_end - t_start) * own / whole) END AS t FROM chunked")
def uniform_times_shifted(spark, d):
    return sequence.uniform_times(filled(spark, d), shifted=True)


@query(f"WITH {FILLED} SELECT obj, id, seg, CAST(floor(CASE WHEN t_start IS NULL THEN t_end ELSE t_start + (t_end - t_start) * own / whole END) AS BIGINT) AS time FROM chunked")
def set_times_uniform(spark, d):
    return sequence.set_times_uniform(filled(spark, d)).select("obj", "id", "seg", "time")


@query(f"WITH {TRAJ} SELECT obj, id, seg FROM traj")
def append_and_push(spark, d):
    """Trajectories cut in three and put together: the middle, the end after it, the beginning before it."""
    t = traj(spark, d).select("obj", "id", "seg")
    middle = sequence.appended(t.where("id >= 10 and id < 30"), t.where("id >= 30"))
    return sequence.pushed_front(middle, t.where("id < 10"))


@query(f"""WITH RECURSIVE {TRAJ}, {TYPE_EDGES}, nx AS (SELECT obj, id, seg, time // 1000000 AS time, dist, lead(seg) OVER w AS ns, lead(time // 1000000) OVER w AS nt FROM traj WINDOW w AS (PARTITION BY obj ORDER BY id)),
  each AS (SELECT obj, id AS old, 0 AS k, seg, time, dist FROM nx UNION ALL
    SELECT obj, id, u.k, via[u.k], NULL, NULL FROM nx JOIN ways ON src = seg AND dst = ns AND nt > time AND path_length / (nt - time) <= 0.0002, unnest(range(1, len(via) + 1)) u(k))
  SELECT obj, CAST(row_number() OVER (PARTITION BY obj ORDER BY old, k) - 1 AS INTEGER) AS id, seg, time, round(dist, 6) AS dist FROM each""")
def extend_paths(spark, d):
    t = traj(spark, d).withColumn("time", F.floor(F.col("time") / 1_000_000))
    return sequence.extend_paths(t, graph.path_table(_type_paths(spark, d)), 0.0002).withColumn("dist", F.round("dist", 6))


# Models, continued

LAST_TWO = "ends AS (SELECT obj, max(id) AS id, max(time) AS time, arg_max(seg, id) AS a, arg_max(before, id) AS b FROM (SELECT *, lag(seg) OVER (PARTITION BY obj ORDER BY id) AS before FROM traj) GROUP BY obj)"


@query(f"""WITH {TRAJ}, {_model_sql(2)}, {TIMES}, {LAST_TWO}, p AS (SELECT obj, id + 1 AS id, coalesce(m2.nxt, m1.nxt, 0) AS seg, time FROM ends LEFT JOIN model m1 ON m1.k = 1 AND m1.ctx = a::VARCHAR LEFT JOIN model m2 ON m2.k = 2 AND m2.ctx = b || '-' || a)
  SELECT obj, id, seg, time::DOUBLE AS time FROM traj UNION ALL SELECT obj, id, seg, round(time + mu, 0) FROM p JOIN times USING (seg)""")
def ppm_extend(spark, d):
    t = traj(spark, d)
    longer = models.extend(t, models.context_model(t, 2), _times(spark, d), 2)
    return longer.withColumn("time", F.round("time", 0))


def _histories(spark, d):
    t = traj(spark, d).withColumn("before", F.lag("seg").over(sequence.along()))
    ends = t.groupBy("obj").agg(F.max_by("seg", "id").alias("a"), F.max_by("before", "id").alias("b"))
    return ends.select(F.col("obj").alias("pid"), F.array("b", "a").alias("history"), F.lit(3).alias("hops"), (F.col("obj") % 5).cast("int").alias("target"))


@query(f"WITH {TRAJ}, {_model_sql(2)}, {LAST_TWO} SELECT DISTINCT obj AS pid, nxt AS next FROM ends JOIN model ON ctx = a::VARCHAR OR ctx = b || '-' || a")
def next_segments(spark, d):
    return models.next_segments(_histories(spark, d), models.context_model(traj(spark, d), 2), 2)


@query(f"""WITH RECURSIVE {TRAJ}, {_model_sql(2)}, {LAST_TWO}, two AS (SELECT x.a AS b, y.a AS a, array_distinct(list(nxt)) AS nexts FROM (SELECT DISTINCT seg AS a FROM traj) x, (SELECT DISTINCT seg AS a FROM traj) y JOIN model ON ctx = y.a::VARCHAR OR ctx = x.a || '-' || y.a GROUP BY ALL),
  w(pid, b, a, h) AS (SELECT obj, b, a, 0 FROM ends UNION ALL SELECT w.pid, w.a, u.nx, h + 1 FROM w JOIN two USING (a, b), unnest(two.nexts) u(nx) WHERE h < 3)
  SELECT obj AS pid, (SELECT count(*) FROM w WHERE w.pid = obj AND h = 3 AND w.a = obj % 5) AS paths FROM ends""")
def count_paths(spark, d):
    return models.count_paths(_histories(spark, d), models.context_model(traj(spark, d), 2), 2)


# Figures of drives


def _drives(spark, d):
    return traj(spark, d).select("obj", "id", "seg", (F.abs("dist") + 1).alias("speed"), (F.col("seg") + 1.0).alias("length"))


DRIVES = "drives AS (SELECT obj, id, seg, abs(dist) + 1 AS speed, seg + 1.0::DOUBLE AS length FROM traj)"


@query(f"WITH {TRAJ}, {DRIVES}, t AS (SELECT speed, length / speed - lag(length / speed) OVER (PARTITION BY obj ORDER BY id) AS d FROM drives) SELECT round(avg(speed), 9) AS avg_speed, round(stddev_pop(speed), 9) AS sigma_speed, round(sqrt(avg(d * d)), 9) AS sigma_trans, count(*) AS n FROM t")
def drive_stats(spark, d):
    return tooling.drive_stats(_drives(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("avg_speed", "sigma_speed", "sigma_trans")], "n")


@query(f"WITH {TRAJ}, {DRIVES}, s AS (SELECT seg, avg(length / speed) AS mu, stddev_pop(length / speed) AS sigma FROM drives GROUP BY seg) SELECT CAST(i AS INTEGER) AS seg, round(coalesce(mu, 0), 9) AS mu, round(coalesce(sigma, 0) + sqrt(2.220446049250313e-16), 9) AS sigma FROM range(0, 7) r(i) LEFT JOIN s ON seg = i")
def drive_times_of_segments(spark, d):
    every = spark.range(7).select(F.col("id").cast("int").alias("seg"))
    return tooling.segment_times(tooling.travel_times(_drives(spark, d)), every).select("seg", F.round("mu", 9).alias("mu"), F.round("sigma", 9).alias("sigma"))


@query(f"WITH {FILLED} SELECT obj, id, seg, round((t_end - coalesce(t_start, 0)) / count(*) OVER (PARTITION BY obj, chunk), 6) AS x FROM chunked")
def travel_times_of_updates(spark, d):
    return tooling.travel_times_of_updates(filled(spark, d)).withColumn("x", F.round("x", 6))


# Graph, continued


@query(f"WITH RECURSIVE {PATHS} SELECT src::BIGINT AS src, dst::BIGINT AS dst, d FROM sp WHERE src <> dst AND d < 60")
def sp_bounded_strict(spark, d):
    e = nation_edges(spark, d)
    return graph.shortest_paths(e, 60.0, e.select("src").distinct(), strict=True).select("src", "dst", "d")


VIA = f"""{PATHS}, pr AS (SELECT a.src, a.dst, a.d, min(b.dst) AS pred FROM sp a JOIN sp b ON a.src = b.src JOIN edges e ON e.src = b.dst AND e.dst = a.dst AND b.d + e.weight = a.d WHERE a.src <> a.dst GROUP BY ALL),
  w(src, dst, d, here, via) AS (SELECT src, dst, d, pred, CAST([] AS BIGINT[]) FROM pr UNION ALL SELECT w.src, w.dst, w.d, pr.pred, list_prepend(w.here::BIGINT, w.via) FROM w JOIN pr ON pr.src = w.src AND pr.dst = w.here WHERE w.here <> w.src),
  via AS (SELECT src, dst, d, array_to_string(via, '-') AS via FROM w WHERE here = src)"""


@query(f"WITH RECURSIVE {VIA} SELECT src::BIGINT AS src, dst::BIGINT AS dst, d, via FROM via")
def sp_via(spark, d):
    e = nation_edges(spark, d)
    return _as_text(graph.path_table(graph.shortest_paths(e, 60.0, e.select("src").distinct())), "via").select("src", "dst", "d", "via")


@query(f"WITH RECURSIVE {VIA} SELECT src::BIGINT AS src, dst::BIGINT AS dst, d, via FROM via WHERE (src + dst) % 3 = 0")
def routes(spark, d):
    """Ways between pairs of nations that are asked for."""
    e = nation_edges(spark, d)
    nodes = e.select("src").distinct()
    pairs = nodes.join(e.select("dst").distinct(), (F.col("src") + F.col("dst")) % 3 == 0).where("src <> dst")
    return _as_text(graph.routes(e, pairs, 60.0), "via")


def _nation_pairs(spark, d):
    n = _read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("src"))
    return n.join(n.select(F.col("src").alias("dst")), F.col("src") % 5 == F.col("dst") % 5).select("src", "dst")


PAIRS = "pairs AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_nationkey % 5 = b.n_nationkey % 5)"


@query(f"WITH {EDGES}, {PAIRS} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM pairs SEMI JOIN edges USING (src, dst)")
def adjacent_pairs(spark, d):
    return graph.adjacent(_nation_pairs(spark, d), nation_edges(spark, d)).select(F.col("src").cast("long"), F.col("dst").cast("long"))


@query(f"WITH {EDGES}, {PAIRS} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM pairs ANTI JOIN edges USING (src, dst)")
def pairs_apart(spark, d):
    return graph.adjacent(_nation_pairs(spark, d), nation_edges(spark, d), apart=True).select(F.col("src").cast("long"), F.col("dst").cast("long"))


@query(f"WITH {EDGES} SELECT src::BIGINT AS src, count(DISTINCT dst) AS degree, array_to_string(list_sort(list(DISTINCT dst)), '-') AS neighbours FROM edges GROUP BY src")
def neighbours(spark, d):
    return _as_text(graph.neighbours(nation_edges(spark, d)), "to").select(F.col("src").cast("long"), "degree", F.col("to").alias("neighbours"))


@query(f"WITH RECURSIVE {PATHS} SELECT (src * 100 + dst)::BIGINT AS pid, CASE WHEN src = dst THEN 0.5 ELSE d - 2.0 + 1.5 END::DOUBLE AS distance FROM sp")
def point_distance(spark, d):
    e = nation_edges(spark, d)
    paths = graph.shortest_paths(e, 60.0, e.select("src").distinct())
    pairs = paths.select((F.col("src") * 100 + F.col("dst")).alias("pid"), F.col("src").alias("s1"), F.lit(2.0).alias("o1"), F.col("dst").alias("s2"), F.lit(1.5).alias("o2"))
    return graph.point_distance(pairs, paths, None)


@query("WITH p AS (SELECT vec_id AS pid, embedding[1]::DOUBLE * 90 AS lat, embedding[2]::DOUBLE * 180 AS lon FROM embeddings) SELECT pid, round(radians(lat) * 6371008.8, 3) AS x, round(radians(lon) * (6371008.8 * cos(radians(37.5))), 3) AS y FROM p")
def project_points(spark, d):
    x, y = geo.project(F.col("x") * 90, F.col("y") * 180, 37.5)
    return _points(spark, d).select("pid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query()
def map_match(spark, d):
    from ..config import Config
    from ..operators import matching

    w = Window.partitionBy("label").orderBy("pid")
    p = _points(spark, d)
    segs = p.withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).withColumn("p_end", F.lead("pid").over(w)).where("bx is not null")
    segs = segs.select(F.col("pid").cast("int").alias("seg"), F.col("pid").alias("p_begin"), "p_end", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", geo.std_distance(F.col("x"), F.col("bx"), F.col("y"), F.col("by")).alias("length"))
    gps = p.select(F.col("label").cast("long").alias("obj"), (F.row_number().over(w) - 1).alias("id"), (F.row_number().over(w) * 10).cast("long").alias("time"), (F.col("x") + 0.001).alias("x"), "y")
    return matching.map_match(gps, segs, config=Config(sigma=0.002, path_bound=1.0))
