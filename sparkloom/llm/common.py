"""Shared plumbing: shared-folder tables, bounded samples and skew-safe lookups."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that :func:`lookup` may broadcast; a key is hot from total / HOT_KEYS rows on.
HOT_KEYS = 1000
#: Ways in which the rows of a hot key are dealt out.
SALTS = 1024

_local_root: str | None = None
_written: list[tuple[SparkSession, str]] = []
_open = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (as in local tests) a local folder is made
    and set as the checkpoint folder.
    """
    global _local_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(_local_root)
    return _local_root


def posix_root(spark: SparkSession) -> str | None:
    """``scratch_root`` as a path that plain file calls reach on every executor; None if it is in a store that only Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return path.toUri().getPath() if store == "file" else None


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/sparkloom/{uuid.uuid4().hex}/{label}"
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    for frame in getattr(_open, "frames", [])[-1:]:
        frame.append((spark, path))
    return path


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are saved inside go at the end, but for those that are passed to what this gives."""
    frames = _open.frames = getattr(_open, "frames", [])
    frames.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._saved_at)
        return df

    try:
        yield keep
    finally:
        for spark, path in frames.pop():
            if path in kept:
                for frame in frames[-1:]:
                    frame.append((spark, path))
            else:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be reached any more
            return


class Saved:
    """A table written to the shared folder: it cuts lineage and survives lost executors.  ``plain`` ones, of hashes that hardly
    repeat, are written without dictionaries of their values."""

    def __init__(self, df: DataFrame, label: str, plain: bool = False):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, label)
        df.write.option("parquet.enable.dictionary", str(not plain).lower()).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.df._saved_at = self.path

    def drop(self) -> None:
        _delete(self.spark, self.path)


def saved(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
    return Saved(df, label, plain).df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    out = []
    for name in names:
        while name in df.columns:
            name = f"_{name}"
        out.append(name)
    return out


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, by: str, bound: int, total: int) -> DataFrame:
    """About ``bound`` of the ``total`` rows, chosen by a hash of ``by``; all if there are fewer."""
    if total <= bound:
        return df
    parts = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(by)), F.lit(parts)) < int(parts * bound / total))


def hash_masks(n: int) -> list[int]:
    """``n`` spread-out 64-bit numbers, from one rule."""
    out, x = [], 0
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: str, total: int) -> DataFrame:
    """Left outer join with ``right`` (one row a key), safe for keys that hold a large share of ``left``.

    ``weight`` (dropped) has how many rows of ``left`` a key of ``right`` has, ``total`` is their sum or
    more.  At most HOT_KEYS keys have over total / HOT_KEYS rows: these are broadcast, and their rows on
    the left are dealt out by a hash of ``spread`` rather than by key.  All others go through a shuffle.
    """
    edge = max(1, total // HOT_KEYS)
    values = [c for c in right.columns if c not in (key, weight)]
    named = right.select(F.col(key).alias("_k"), F.col(weight).alias("_w"), *[F.col(c).alias(f"_r_{c}") for c in values])
    hot = named.where(F.col("_w") > edge).drop("_w").withColumn("_hot", F.lit(True))
    cold = named.where(F.col("_w") <= edge).drop("_w").withColumn("_s", F.lit(0))
    hot = hot.select(F.col("_k").alias("_hk"), "_hot", *[F.col(f"_r_{c}").alias(f"_h_{c}") for c in values])
    out = left.join(F.broadcast(hot), left[key] == hot["_hk"], "left")
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int"))
    out = out.withColumn("_salt", salt)
    out = out.join(cold, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_r_{c}")).alias(c) for c in values])
