"""Benchmark decontamination by SimHash windows. Native expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, written
from .licenses import BREAK, LOWER, UPPER
from .native import shingles

#: Benchmark shingles go to all executors up to this many (about 40 bytes each); beyond it both sides are shuffled.
BROADCAST_SHINGLES = 1_000_000
#: Texts with windows to look at go to all executors up to this many; beyond it both sides are shuffled.
BROADCAST_TEXTS = 100_000
BITS, SEGMENTS = 64, 12


def _shingled(table: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, and the hashes of k words (sh) of a whole text in order. Words: A-Z lower-cased, without ASCII punctuation."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    split = pick(table, *keys, "text").withColumn("w", F.array_remove(F.split(lower, BREAK), ""))
    return split.withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).select(*keys, shingles("h", k).alias("sh"))


def _simhash(array: str) -> str:
    """SQL: bit b is 1 if more than half of the hashes, repeats counted, have it. coalesce: else Spark filters on its not being null."""
    return f"coalesce(aggregate(sequence(0, 63), 0L, (a, b) -> a | if(2 * size(filter({array}, x -> getbit(x, b) = 1)) > size({array}), shiftleft(1L, b), 0L)), 0L)"


def _weighted(a: str, b: str) -> str:
    """SQL: sum of the smaller count of each shingle over the sum of the larger."""
    each = f"transform(array_distinct(concat({a}, {b})), x -> named_struct('p', size(filter({a}, y -> y = x)), 'q', size(filter({b}, y -> y = x))))"
    return f"aggregate({each}, named_struct('s', 0L, 'l', 0L), (t, c) -> named_struct('s', t.s + least(c.p, c.q), 'l', t.l + greatest(c.p, c.q)), t -> t.s / t.l)"


def _starts(similarity: float) -> str:
    """SQL: from ps, the sorted places of hits in a text of n shingles, all starts of windows of m that hold enough of them.

    A window belongs to its first hit, the i-th; so many hits on, the next ones must lie within it.
    """
    share = similarity / (1 + similarity)
    least = f"cast(ceil({similarity} * m - 1e-9) as int)"  # of the shortest window that can pass
    enough = f"cast(ceil({share!r} * (m + least(st + m, n) - greatest(st, 0)) - 1e-9) as int)"
    begin = f"greatest(if(i = 0, 1 - m, get(ps, i - 1) + 1), get(ps, i + {least} - 1) - m + 1)"
    firsts = f"filter(sequence(0, size(ps) - {least}), i -> get(ps, i + {least} - 1) - get(ps, i) < m)"
    return f"if(size(ps) >= {least}, flatten(transform({firsts}, i -> filter(sequence({begin}, get(ps, i)), st -> get(ps, i + {enough} - 1) < st + m))), array())"


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 23) -> DataFrame:
    """(doc_id, item_id, similarity, n_windows, start): documents that hold a passage of a benchmark item.

    A window has as many words as the item. Its SimHash is compared with the item's by multi-index
    blocks: the 64 bits fall into 12 segments, and within 23 bits of difference some segment has at
    most one; so each window is looked up, in each segment's table, under all keys in a ball of one
    flip, and every fingerprint within the radius is found. Verified are then the counts of their
    k-word shingles: the sum of the smaller ones over the sum of the larger ones is `similarity` or
    more. Two shingle sets that similar are 10 bits apart on average, 23 is over four deviations more.

    Windows start at every shingle, also those that either end of the text cuts off, where they can
    reach that at all: of m and w shingles, at least similarity / (1 + similarity) * (m + w) are in
    both. So shingles of the text are looked up among those of the benchmark, and wherever that many
    hits of an item lie within its length, each start is a window, in whatever order the hits are.
    Its fingerprint is looked up among all items of that length. n_windows counts those that pass,
    similarity and start (its first shingle, counted from 0) are of the best.

    Null text: as empty. Items of fewer than k words hold no shingle and match nothing; windows end
    with the text. Null doc_id or item_id: kept as a key of its own; rows with one doc_id give one
    row an item. No documents or items: no rows.
    """
    items = _shingled(benchmark, k, "item_id").withColumn("fp", F.expr(_simhash("sh"))).withColumn("m", F.size("sh"))
    items = items.withColumn("item", F.xxhash64("item_id", "sh"))
    seeds = items.select("item", "m", F.explode_outer("sh").alias("s")).where("s is not null").distinct()
    few = seeds.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    keyed = pick(docs, "doc_id", "text").withColumn("t", F.xxhash64("text"))
    placed = _shingled(keyed, k, "doc_id", "t").select("doc_id", "t", F.size("sh").alias("n"), F.posexplode_outer("sh").alias("p", "x")).where("x is not null")
    hits = placed.join(F.broadcast(seeds) if few else seeds, F.col("x") == F.col("s")).select("doc_id", "t", "item", "m", "n", "p")
    met = hits.groupBy("doc_id", "t", "item", "m", "n").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    starts = met.select("doc_id", "t", "m", F.explode(F.expr(_starts(similarity))).alias("st"))
    spans = written(starts.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("own")).agg(F.collect_set(F.struct("m", "st")).alias("spans")))
    some = spans.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    again = keyed.join(F.broadcast(spans) if some else spans, (F.col("t") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")))
    windows = _shingled(again, k, "doc_id", "spans").select("doc_id", "sh", F.explode("spans").alias("at")).select("doc_id", "sh", "at.m", "at.st")
    windows = windows.select("doc_id", "m", F.greatest("st", F.lit(0)).alias("start"), F.expr("slice(sh, greatest(st, 0) + 1, m + least(st, 0))").alias("win"))
    windows = windows.distinct().withColumn("mine", F.expr(_simhash("win")))
    asked = windows.select("*", F.explode(_balls("mine")).alias("key"))
    tables = items.select("item_id", F.col("m").alias("size"), "fp", F.col("sh").alias("theirs"), F.explode(_segments("fp")).alias("key2"))
    near = (F.col("m") == F.col("size")) & (F.col("key") == F.col("key2")) & (F.bit_count(F.col("mine").bitwiseXOR(F.col("fp"))) <= radius)
    pairs = asked.join(F.broadcast(tables) if few else tables, near).select("doc_id", "item_id", "start", "win", "theirs").distinct()
    judged = pairs.withColumn("similarity", F.expr(_weighted("win", "theirs")))
    passed = F.col("similarity") >= similarity
    best = F.max(F.when(passed, F.struct("similarity", (-F.col("start")).alias("s"))))
    # What fails goes after the aggregate: a filter before it would be tried on all that one key brings together.
    found = judged.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count_if(passed).alias("n_windows")).where("n_windows > 0")
    return found.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), "n_windows", (-F.col("best.s")).cast("long").alias("start"))


def _cuts() -> list[tuple[int, int]]:
    edges = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _part(column: str, a: int, b: int) -> str:
    return f"(shiftrightunsigned({column}, {a}) & {(1 << (b - a)) - 1})"


def _segments(column: str):
    """Keys of a fingerprint: segment number and value."""
    return F.expr("array(" + ", ".join(f"{i} * 1024L + {_part(column, a, b)}" for i, (a, b) in enumerate(_cuts())) + ")")


def _balls(column: str):
    """Keys within one flip of a fingerprint in each segment."""
    keys = [f"{i} * 1024L + ({_part(column, a, b)} ^ {flip})" for i, (a, b) in enumerate(_cuts()) for flip in [0, *(1 << j for j in range(b - a))]]
    return F.expr(f"array({', '.join(keys)})")


def op1_decontamination(spark, sf_dir):
    """Contract query of operator 1 over all of documents and benchmark."""
    from ._common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
