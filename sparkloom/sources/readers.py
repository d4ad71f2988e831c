"""Bounded and unbounded sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", line_sep: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Delimited records with an explicit schema; ``columns`` keeps some (the reader prunes the rest)."""
    reader = spark.read.schema(schema).option("sep", sep)
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    out = reader.csv(path)
    return out.select(*columns) if columns else out


def elements(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def number_sequence(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Both ends included."""
    return spark.range(first, last + 1)


def socket_lines(spark: SparkSession, port: int, host: str = "localhost") -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "line")


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


STATUSES = (200, 404, 500, 501, 301)


def request_log(rows: DataFrame, seed: int = 7) -> DataFrame:
    """A request log from rows of ``value`` (a number) and ``timestamp``: batch, or a ``rate`` stream.

    Users are 0 to 99 and response times 0 to 199. The status is one of the first four: 301 never occurs.
    """
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("value")), F.lit(n)).cast("int")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), draw(2, 4) + 1)
    millis = F.unix_millis("timestamp").alias("ts_ms")
    return rows.select(F.md5(F.col("value").cast("string").cast("binary")).alias("traceid"), draw(1, 100).alias("userid"), millis, status.alias("status"), draw(3, 200).alias("restime"))


def rate(spark: SparkSession, rows_per_second: int = 100) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def cycling_keys(spark: SparkSession, n: int = 20_000_000, keys: int = 10_000, instances: int = 1, with_millis: int | None = None) -> DataFrame:
    """``n`` rows (key, 1) an instance; keys go 1 to ``keys`` and start again. ``with_millis`` rows a second: ``ms`` has their time."""
    row = F.col("id") % n
    time = [F.floor(row * 1000 / with_millis).alias("ms")] if with_millis else []
    return spark.range(n * instances).select((row % keys + 1).alias("key"), F.lit(1).cast("long").alias("n"), *time)


def cycling_keys_stream(spark: SparkSession, rows_per_batch: int = 100_000, keys: int = 10_000, instances: int = 4, n: int | None = None, millis_per_batch: int = 1000) -> DataFrame:
    """``key, n, timestamp`` as a stream of ``instances`` parallel tasks; all rows, or the first ``n`` (bounded)."""
    reader = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", instances).option("advanceMillisPerBatch", millis_per_batch)
    rows = reader.load()
    rows = rows.where(F.col("value") < n) if n is not None else rows
    return rows.select((F.col("value") % keys + 1).alias("key"), F.lit(1).cast("long").alias("n"), "timestamp")


def parsed_pairs(lines: DataFrame, column: str = "line") -> DataFrame:
    """``a, b`` of ``(a,b)`` lines."""
    a, b = text.parse_pair(F.col(column))
    return lines.select(a.alias("a"), b.alias("b"))


def random_pairs(spark: SparkSession, n: int = 100, bound: int = 49, seed: int = 7) -> DataFrame:
    """Pairs of numbers from 1 to ``bound``."""
    return spark.range(n).select((F.floor(F.rand(seed) * bound) + 1).cast("int").alias("a"), (F.floor(F.rand(seed + 1) * bound) + 1).cast("int").alias("b"))
