"""Batch and streaming sinks."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def show(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def to_list(df: DataFrame) -> list[Row]:
    """For results that are known to be small."""
    return df.collect()


def write_delimited(df: DataFrame, path: str, sep: str = ",", line_sep: str = "\n", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", sep).option("lineSep", line_sep).csv(path)


def write_text(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """A line a row: its columns joined."""
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]).alias("value")).write.mode(mode).text(path)


def stream_to_console(df: DataFrame, mode: str = "update") -> StreamingQuery:
    return df.writeStream.format("console").outputMode(mode).start()


def stream_to_csv(df: DataFrame, path: str, checkpoint: str, sep: str = "|", once: bool = False) -> StreamingQuery:
    writer = df.writeStream.format("csv").outputMode("append").option("sep", sep).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class SocketWriter:
    """``foreach`` writer that sends ``<now_ms> : <row>`` lines to a server; a lost connection is opened again.

    A line is sent once at least: one that the server got before the connection broke may come again.
    """

    def __init__(self, host: str, port: int, tries: int = 4, wait: float = 0.2):
        self.host, self.port, self.tries, self.wait, self.connection = host, port, tries, wait, None

    def open(self, partition: int, epoch: int) -> bool:
        self._again(lambda: None)
        return True

    def process(self, row: Row) -> None:
        line = f"{int(time.time() * 1000)} : ({','.join(map(str, row))})\n".encode()
        self._again(lambda: self.connection.sendall(line))

    def _again(self, act: Callable[[], None]) -> None:
        for k in range(self.tries):
            try:
                if self.connection is None:
                    self.connection = socket.create_connection((self.host, self.port))
                return act()
            except OSError:
                self.close(None)
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)

    def close(self, error: Exception | None) -> None:
        if self.connection is not None:
            self.connection.close()
            self.connection = None


def stream_to_socket(df: DataFrame, host: str, port: int, mode: str = "update", one_connection: bool = False, **trigger) -> StreamingQuery:
    """A connection a partition; ``one_connection`` sends a micro-batch in order through one."""
    writer = (df.coalesce(1) if one_connection else df).writeStream.foreach(SocketWriter(host, port)).outputMode(mode)
    return (writer.trigger(**trigger) if trigger else writer).start()


def show_window_ends(df: DataFrame, name: str = "ends", mode: str = "append", **trigger) -> StreamingQuery:
    """Prints each row of closed windows after the last instant of its window."""

    def each(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in ("window_start", "window_end")]
        stamped(batch).select(F.concat_ws(" ", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), *rest).alias(name)).show(batch.count() or 1, truncate=False)

    writer = df.writeStream.outputMode(mode).foreachBatch(each)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stamped(df: DataFrame) -> DataFrame:
    """Windowed rows with the last instant of their window (its end less a millisecond)."""
    return df.withColumn("at", F.col("window_end") - F.expr("INTERVAL '0.001' SECOND"))


def stream_to_many(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]], mode: str = "append", checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Several outputs of one read: each gets every micro-batch, which is held while they write."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, epoch)
        batch.unpersist()

    writer = df.writeStream.outputMode(mode).foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
