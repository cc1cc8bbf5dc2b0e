"""Written tables that are given up once consumed, and sums of arrays over all tasks."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.words import give_back
from driftline.session import scratch_path


def write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path for :func:`drop`."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later job reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Frees what finished jobs left on the driver: their plans and broadcasts, and Python's buffers.

    Plans are held by Python's objects, and broadcasts are cleaned once the JVM has collected theirs.
    """
    gc.collect()
    spark._jvm.System.gc()
    give_back()


def totals(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, kind: type = np.float64) -> np.ndarray:
    """Sum over all tasks of the array of ``size`` numbers that ``partial`` makes of a task's batches.

    Summed in two levels, so that the driver receives the root of the number of tasks.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([np.ascontiguousarray(partial(batches), kind).tobytes()], pa.binary())], names=["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, kind)
        for batch in batches:
            for v in batch.column(0):
                sums += np.frombuffer(v.as_py(), kind)
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], names=["v"])

    tasks = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    out = rows.mapInArrow(one, "v binary").repartition(tasks).mapInArrow(added, "v binary").collect()
    return sum((np.frombuffer(bytes(r[0]), kind) for r in out), np.zeros(size, kind))
