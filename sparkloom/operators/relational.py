"""Filters, joins, set operations and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.iterate import settled


def keyword_documents(docs: DataFrame, keywords: list[str], url: str = "url", contents: str = "contents") -> DataFrame:
    return docs.where(text.contains_all(F.col(contents), keywords)).select(url)


def web_log(docs: DataFrame, ranks: DataFrame, visits: DataFrame, keywords: list[str], least_rank: int, year: int) -> DataFrame:
    """``rank, url, avg_duration`` of pages with all keywords and over ``least_rank`` that have no visit in ``year``.

    Filters and projections come before the join; rank rows keep their number.  Visit dates are text (``2007-1-1``), or dates,
    of which the year is a range that the scan gets.
    """
    wanted = keyword_documents(docs, keywords)
    ranked = ranks.where(F.col("rank") > least_rank)
    date = F.col("visit_date")
    visited = visits.where(text.year_of(date) == year if visits.schema["visit_date"].dataType.typeName() == "string" else text.in_year(date, year)).select("url")
    return wanted.join(ranked, "url").select("rank", "url", "avg_duration").join(visited, "url", "left_anti").select("rank", "url", "avg_duration")


def whole_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or blank field."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | text.is_blank(F.col(c))
    return df.where(~bad)


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, blanks`` for each column, from one pass."""
    counts = df.agg(*[F.count_if(text.is_blank(F.col(c))).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("blanks")) for c in columns])).alias("x")).select("x.*")


def whole_rows_observed(df: DataFrame, columns: list[str], name: str = "blanks") -> tuple[DataFrame, Observation]:
    """``whole_rows`` with the blank counts as a side channel: read them once an action has run."""
    seen = Observation(name)
    return whole_rows(df.observe(seen, *[F.count_if(text.is_blank(F.col(c))).alias(c) for c in columns]), columns), seen


def join_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join whose result has each side's record as a struct."""
    a = left.select(F.col(key), F.struct(*left.columns).alias("left"))
    b = right.select(F.col(key), F.struct(*right.columns).alias("right"))
    return a.join(b, key).select("left", "right")


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` that ``old`` has not."""
    return new.join(old, new.columns, "left_anti")


def co_group(left: DataFrame, right: DataFrame, key: str, function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` of both sides' rows of each key that either side has; a side without it gives an empty frame."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(function, schema)


def co_group_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All right rows of a grouping of both sides, also where the left side has none."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in right.schema)
    return co_group(left, right, key, lambda _, r: r, schema)


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def running_count(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """One update a record: how many records of its key came up to it (in ``order``, which tells records apart).

    Records are dealt out in ranges of key and order, so that a key with a large share of them is counted by many
    tasks: within a range, and before it by the ranges' totals. Of these only those of keys that go on from range to range,
    one a range at most, are broadcast.
    """
    ranges = df.repartitionByRange(*([partitions] if partitions else []), key, *order)
    dealt = settled(ranges.withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy(key, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.sum("__n").over(earlier)).where("__before > 0").select(F.col(key).alias("__key"), F.col("__range").alias("__at"), "__before")
    own = Window.partitionBy(key, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dealt.withColumn("__n", F.count("*").over(own)).join(F.broadcast(before), (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__range") == F.col("__at")), "left")
    return counted.select(*df.columns, (F.col("__n") + F.coalesce("__before", F.lit(0))).alias("n"))
