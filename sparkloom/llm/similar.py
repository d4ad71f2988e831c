"""Components of similar sets from bands: each pair of a band is compared or already in one component."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, saved
from .components import connected_components


class Comparison(Protocol):
    """What :func:`similar_sets` asks of a kind of sets, which are named by a long ``h``."""

    def prepare(self, wanted: DataFrame) -> None:
        """Get ready to compare the sets of ``wanted`` (column ``h``, unique)."""

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, ...) that may be similar."""

    def near_pivots(self, ranked: DataFrame, done: int, until: int) -> DataFrame:
        """``(ha, hb, la, lb)``: pairs that may be similar, of a row (band, h, label, rank) with a rank in (done, until] and
        one of the same band with a higher rank and another label."""

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, ...) that are similar, by exact comparison."""


def few(df: DataFrame, rows: int) -> DataFrame:
    """Marked for a broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def similar_sets(banded: DataFrame, compare: Comparison, broadcast_rows: int) -> DataFrame:
    """``(h, component)`` of sets that are similar to another one with which they share a band, from ``(band, h)``.

    Those of a band are first held against the one of them that
    shares most bands with most others, as the original of many near copies does; what is found similar is
    then one component.  Where a band has several components left, its members are held against the next 8, 64,
    512 ... of other components, until each pair of a band either is in one component or was compared.
    Only pairs that may reach the similarity leave a join: near copies of one text take pairs in proportion to
    their number, and no candidate is dropped.
    """
    groups = saved(banded.groupBy("band").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("m")).where("m > 1"), "groups")
    large = saved(groups.where("m > 2").select("band", "m"), "large")
    if (n := large.count()) <= broadcast_rows:
        members = banded.join(F.broadcast(large), "band")
    else:
        members = lookup(banded, large.withColumn("weight", F.col("m")), "band", "weight", "h", large.agg(F.sum("m")).first()[0]).where("m is not null")
    members = saved(members.select("band", "h", "m"), "members")
    central = members.groupBy("h").agg(F.sum("m").alias("degree"))
    members = saved(members.join(central, "h").select("band", "h", "m", F.struct((-F.col("degree")).alias("d"), F.col("h").alias("h")).alias("place")), "placed")
    first = members.groupBy("band").agg(F.min("place")["h"].alias("a"))
    star = members.select("band", F.col("h").alias("b")).join(first, "band").where("a <> b").select(*ordered("a", "b"))
    pairs = saved(groups.where("m = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).union(star).distinct(), "pairs")
    compare.prepare(members.select("h").union(groups.where("m = 2").select(F.explode(F.array("low", "high")))).distinct())
    found = saved(connected_components(compare.similar(compare.near(pairs))).withColumnRenamed("node", "h"), "components")
    ranked, done = None, 1
    while n:
        named = (members if ranked is None else ranked).join(found, "h", "left").withColumn("label", F.coalesce("component", "h")).drop("component")
        open_ = named.where(F.col("m") > done).groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
        named = saved(named.join(open_, "band", "left_semi"), "open")
        if named.isEmpty():
            break
        if ranked is None:
            rank = F.row_number().over(Window.partitionBy("band").orderBy("place"))
            named = saved(named.withColumn("rank", rank).drop("place"), "ranked")
        ranked, until = named.drop("label"), done * 8 + 1
        more = compare.near_pivots(named, done, until)
        more = saved(more.select(*ordered("ha", "hb"), F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).distinct(), "pairs")
        done = until
        if more.isEmpty():
            continue
        merged = connected_components(compare.similar(more).select("la", "lb").distinct(), "la", "lb").select(F.col("node").alias("label"), F.col("component").alias("to"))
        merged = saved(merged, "merged")
        both = found.select("h", F.col("component").alias("label")).join(merged, "label", "left").select("h", F.coalesce("to", "label").alias("component"))
        alone = merged.select(F.col("label").alias("h"), F.col("to").alias("component")).join(found, "h", "left_anti")
        found = saved(both.union(alone), "components")
    return found
