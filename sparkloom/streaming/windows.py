"""Time windows with one definition for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def event_time(df: DataFrame, column: str, slack: str | None = None, millis: bool = False) -> DataFrame:
    """``ts`` as a timestamp; with ``slack`` a watermark (`3 seconds`, `3 milliseconds`, or `0 seconds` for in-order data)."""
    value = F.timestamp_millis(F.col(column)) if millis else F.col(column).cast("timestamp")
    out = df.withColumn("ts", value)
    return out.withWatermark("ts", slack) if slack else out


def processing_time(df: DataFrame, slack: str | None = None) -> DataFrame:
    """``ts`` is the time of the micro-batch (or of its arrival, if the source has none of its own); ``slack`` as in ``event_time``."""
    out = df.withColumn("ts", F.current_timestamp())
    return out.withWatermark("ts", slack) if slack else out


def with_parallelism(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """What follows runs in ``n`` tasks, of whole keys if some are given."""
    return df.repartition(n, *keys)


def windowed(df: DataFrame, window: Column, keys: list[str], *aggregates: Column) -> DataFrame:
    grouped = df.groupBy(window.alias("w"), *keys).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "w"]
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)


def tumbling(df: DataFrame, width: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return windowed(df, F.window("ts", width), keys, *aggregates)


def sliding(df: DataFrame, width: str, slide: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return windowed(df, F.window("ts", width, slide), keys, *aggregates)


def sliding_sum(df: DataFrame, width_ms: int, slide_ms: int, key: str, value: str, time_ms: str) -> DataFrame:
    """``key, window_start_ms, total``: sums of sliding windows by panes of one slide, so that a record is summed once and
    only panes go into several windows. ``width_ms`` is a multiple of ``slide_ms``."""
    if width_ms % slide_ms:
        raise ValueError("the width is a multiple of the slide")
    panes = df.groupBy(key, (F.floor(F.col(time_ms) / slide_ms) * slide_ms).alias("pane")).agg(F.sum(value).alias("part"))
    starts = F.explode(F.sequence(F.col("pane") - (width_ms - slide_ms), F.col("pane"), F.lit(slide_ms)))
    return panes.select(key, "part", starts.alias("window_start_ms")).groupBy(key, "window_start_ms").agg(F.sum("part").alias("total"))


def full_windows(df: DataFrame, width: str, keys: list[str], function, schema: str) -> DataFrame:
    """``function`` (pandas frame to pandas frame) of all records of each window and key, where no aggregate will do."""
    return df.withColumn("window_start", F.window("ts", width)["start"]).groupBy("window_start", *keys).applyInPandas(function, schema)


def session(df: DataFrame, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """An event exactly one gap later belongs to the session."""
    return windowed(df, F.session_window("ts", gap), keys, *aggregates)


def parse_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """``traceid, userid, ts_ms, status, restime`` of comma-parted lines."""
    f = F.split(column, ",")
    return lines.select(f[0].alias("traceid"), f[1].cast("int").alias("userid"), f[2].cast("long").alias("ts_ms"), f[3].cast("int").alias("status"), f[4].cast("int").alias("restime"))


def parse_event(lines: DataFrame, column: str = "line") -> DataFrame:
    """``ts_ms, word`` of ``<ms> <word>`` lines."""
    f = F.split(column, " ")
    return lines.select(f[0].cast("long").alias("ts_ms"), f[1].alias("word"))


def status_counts(log: DataFrame, width: str = "5 seconds", keys: tuple[str, ...] = ("status",)) -> DataFrame:
    return tumbling(log, width, list(keys), F.count("*").alias("n"))


def slow_share(log: DataFrame, width: str = "5 seconds", time: str = "restime", limit: int = 50) -> DataFrame:
    """Whole percentages of slow and fast requests of each window, over all keys."""
    slow = F.count_if(F.col(time) > limit)
    counted = tumbling(log, width, [], slow.alias("slow"), F.count("*").alias("n"))
    return counted.select("window_start", "window_end", text.whole_percent(F.col("slow"), F.col("n")).alias("slow_percent"), text.whole_percent(F.col("n") - F.col("slow"), F.col("n")).alias("fast_percent"), F.lit(1).alias("one"))


DASHBOARD_SQL = """
SELECT count(*) AS pv, sum(restime) div count(restime) AS avg_restime,
       round(CAST(sum(CASE WHEN status = 200 THEN 0 ELSE 1 END) AS DOUBLE) / count(*), 2) AS error_rate,
       window.start + INTERVAL '8' HOUR AS at
FROM {{log}} WHERE status <> 404 GROUP BY window(ts, '{width}')
"""


def dashboard(log: DataFrame, width: str = "1 second") -> DataFrame:
    """Page views, mean response time (whole) and error rate of each window, in SQL on the log (batch or streaming)."""
    return log.sparkSession.sql(DASHBOARD_SQL.format(width=width), log=log)
