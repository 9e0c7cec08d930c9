"""What the training-data operators share: shared storage, staging, document blocks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. `bytes.split()` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null document id where ids are compared; a mask tells it from a document that has this id.
NO_ID = (1 << 63) - 1

_watching: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent (one machine, as in tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/fleetloom-{os.getpid()}"
    path = f"{base.rstrip('/')}/fleetloom-{uuid.uuid4().hex}"
    for made in _watching:
        made.append(path)
    return path


@contextmanager
def making() -> Iterator[list[str]]:
    """A list of the shared folders that are made within."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


def written(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more, by whatever file system Spark has for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that further ones can't clash with its own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def cut(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most most_bytes in a text column, or one row if that row alone has more."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < len(sizes):
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
