"""Sequential work for one object at a time, and what iterative operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def object_type(rows: DataFrame, column: str = "obj") -> str:
    """The type of object ids, which operators keep: a number or a string."""
    return rows.schema[column].dataType.simpleString()


def fold_by_object(traj: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(rows of one object in order of id) for each object. Order-dependent cuts need all rows of an object.

    schema: of the columns after obj.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(rows.sort_values("id", kind="stable").reset_index(drop=True))

    return traj.groupBy("obj").applyInPandas(run, f"obj {object_type(traj)}, {schema}")


def settled(df: DataFrame) -> DataFrame:
    """df, made once and kept in the checkpoint folder that all executors share, so that lost ones cost nothing.

    Only where no folder is set and the master is local, a temporary one is taken.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or f"file://{tempfile.gettempdir()}/fleetloom-{os.getpid()}")
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its rows numbered from 0 in an order, by ranges: no task has all rows, and the driver sees a count a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = settled(placed.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    begins, at = [], 0
    for r in placed.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        begins.append((r["_p"], at))
        at += r["n"]
    offsets = df.sparkSession.createDataFrame(begins or [(0, 0)], "_p int, _at long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_at") + F.col("_i")).drop("_p", "_i", "_at")
