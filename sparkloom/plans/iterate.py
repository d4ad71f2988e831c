"""Iterations driven from the driver: bulk, bulk with a criterion, and delta.

Every step's result goes to the checkpoint folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkloom-"))  # a local folder only where none is named
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``settled``, packed (ORC), for tables of many rows; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.orc(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).orc(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session has ended: nothing can be reached any more
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Iterated:
    result: DataFrame
    steps: int
    converged: bool


def bulk(start: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int, criterion: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Iterated:
    """Apply ``step`` up to ``steps`` times; stop after one for which ``criterion(old, new)`` is empty. The last result counts."""
    now = start
    for k in range(steps):
        old, now = now, settled(step(now))
        if criterion is not None and criterion(old, now).isEmpty():
            return Iterated(now, k + 1, True)
    return Iterated(now, steps, criterion is None)


def delta(solution: DataFrame, work: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: str, value: str, steps: int) -> Iterated:
    """A solution set by ``key``; ``step(solution, work)`` gives the changed rows, which are the next work. Stops when nothing changes."""
    for k in range(steps):
        changes = settled(step(solution, work))
        if changes.isEmpty():
            return Iterated(solution, k + 1, True)
        new = changes.withColumnRenamed(value, "_new")
        solution = settled(solution.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).select(key, value))
        work = changes
    return Iterated(solution, steps, work.isEmpty())
