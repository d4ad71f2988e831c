"""Distributed union-find: connected components by repeated contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node reachable.

    In each round a node hooks onto the neighbour (itself included) of the smallest rank; hooks are
    contracted and edges inside a contracted node disappear.  Ranks are by degree in even rounds, so that a star is
    done in one, and random in odd ones, where the expected number of edges falls by a constant
    factor whatever the shape, so long chains take a logarithmic number of rounds.  Each round is
    written to the shared folder.  Aggregates combine before the shuffle, and joins deal with a hub by
    the skew-join split.  Rows with a null end and loops on one node are ignored; a node that has only
    a loop is not returned.  No edges: an empty result.
    """
    live = Saved(
        edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    labels: Saved | None = None
    for step in range(max_rounds):
        if live.df.isEmpty():
            break
        both = live.df.union(live.df.select("b", "a"))
        if step % 2:
            rank = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("n"))
            hooks = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m")).select("node", F.least(F.col("m"), rank("node"))["n"].alias("to"))
        else:
            degree = both.groupBy(F.col("a").alias("n")).agg((-F.count("*")).alias("d")).select("d", F.xxhash64(F.lit(step), "n").alias("h"), "n")
            near = both.join(degree.select(F.col("n").alias("b"), F.struct("d", "h", "n").alias("rank")), "b")
            lowest = near.groupBy(F.col("a").alias("n")).agg(F.min("rank").alias("m")).join(degree, "n")
            hooks = lowest.select(F.col("n").alias("node"), F.least("m", F.struct("d", "h", "n"))["n"].alias("to"))
        hooks = Saved(hooks, "hooks")
        at_a = hooks.df.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        at_b = hooks.df.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = live.df.join(at_a, "a").join(at_b, "b").where("ta <> tb")
        new_live = Saved(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if labels is None:
            new_labels = Saved(hooks.df.select("node", F.col("to").alias("root")), "labels")
        else:
            via = hooks.df.select(F.col("node").alias("root"), "to")
            new_labels = Saved(labels.df.join(via, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            labels.drop()
        live.drop()
        hooks.drop()
        live, labels = new_live, new_labels
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return live.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.df.groupBy("root").agg(F.min("node").alias("component"))
    return labels.df.join(least, "root").select("node", "component")
