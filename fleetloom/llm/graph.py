"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, shared_dir, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each linked node with the smallest node of its component.

    Alternating large and small stars over the links, until a round changes nothing. Minima are
    aggregates with partial sums and the rest are equi-joins that AQE can split, so a hub with very
    many links needs no task of its own. Each round is written to the shared folder. Self links and
    repeated links do no harm; links with a null end are no links. No links: no rows.
    """
    # Orient each link from the larger end to the smaller.
    spark, at = links.sparkSession, shared_dir(links.sparkSession)
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), at)
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, at = at, shared_dir(spark)
        edges = written(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), at)
        dropped(spark, last)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
