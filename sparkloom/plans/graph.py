"""Graph computations on ``edges(src, dst)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import cells
from .iterate import Iterated, bulk, delta, settled, stored

#: Most vertices whose degrees are broadcast, and edges of which they are counted, about.
HUBS, COUNTED = 500_000, 4_000_000


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, repeats kept."""
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with the smaller end first; loops go."""
    return _smaller_first(edges).distinct()


def _smaller_first(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def page_rank(pages: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 10, epsilon: float | None = 1e-4) -> Iterated:
    """``page, rank``.  The number of pages is counted once; links carry their page's out-degree, so a step is one join and
    one sum.  Pages without in-links drop out after a step, and the rank of pages without out-links is lost.  Both inputs
    are worked out once."""
    pages, edges = settled(pages), settled(edges)
    n = pages.count()
    links = settled(edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src").select("src", "dst", "degree"))

    def step(ranks: DataFrame) -> DataFrame:
        sent = ranks.join(links, ranks["page"] == links["src"]).select(F.col("dst").alias("page"), (F.col("rank") / F.col("degree")).alias("part"))
        return sent.groupBy("page").agg((F.sum("part") * damping + (1 - damping) / n).alias("rank"))

    def moved(old: DataFrame, new: DataFrame) -> DataFrame:
        return new.join(old.withColumnRenamed("rank", "before"), "page").where(F.abs(F.col("rank") - F.col("before")) > epsilon)

    start = pages.select(F.col("page"), F.lit(1.0 / n).alias("rank")) if n else pages.select("page", F.lit(0.0).alias("rank"))
    return bulk(start, step, steps, moved if epsilon is not None else None)


def components(vertices: DataFrame, edges: DataFrame, steps: int = 10) -> Iterated:
    """``vertex, component``: smallest label by propagation of changes; ``steps`` bound the diameter that is reached.

    See ``contracted_components`` for graphs of unknown diameter."""
    both = settled(mirrored(edges))
    start = vertices.select(F.col("vertex"), F.col("vertex").alias("component"))

    def step(solution: DataFrame, work: DataFrame) -> DataFrame:
        offered = work.join(both, work["vertex"] == both["src"]).groupBy(F.col("dst").alias("vertex")).agg(F.min("component").alias("offer"))
        return offered.join(solution, "vertex").where("offer < component").select("vertex", F.col("offer").alias("component"))

    return delta(start, start, step, "vertex", "component", steps)


def contracted_components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> Iterated:
    """``vertex, component`` of the smallest vertex that is reached, in a logarithmic number of rounds whatever the diameter.

    In each round a vertex joins its neighbour (or itself) of the lowest rank, by degree in even rounds and at random in
    odd ones; edges inside what has joined disappear.  Of each round the joins alone are kept.
    """
    live = settled(ordered_edges(edges))
    labels = settled(vertices.select("vertex", F.col("vertex").alias("root")))
    for k in range(rounds):
        if live.isEmpty():
            break
        both = mirrored(live)
        weight = -F.count("*") if k % 2 == 0 else F.lit(0)
        rank = both.groupBy(F.col("src").alias("v")).agg(weight.alias("w")).select("v", F.struct("w", F.xxhash64(F.lit(k), "v").alias("h"), "v").alias("rank"))
        lowest = both.join(rank, both["dst"] == rank["v"]).groupBy(F.col("src").alias("v")).agg(F.min("rank").alias("least"))
        joins = settled(lowest.join(rank, "v").select("v", F.least("least", "rank")["v"].alias("to")))
        ends = live.join(joins.toDF("src", "a"), "src").join(joins.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        live = settled(ordered_edges(ends))
        labels = settled(labels.join(joins.toDF("root", "to"), "root", "left").select("vertex", F.coalesce("to", "root").alias("root")))
    least = labels.groupBy("root").agg(F.min("vertex").alias("component"))
    return Iterated(labels.join(least, "root").select("vertex", "component"), k, live.isEmpty())


def closure(edges: DataFrame, steps: int = 10, doubling: bool = False) -> Iterated:
    """``src, dst``: all pairs with a directed path; only new paths are grown, and those found are never written again.

    Paths grow by one edge a step, or with ``doubling`` by all paths so far, so that steps are logarithmic in the longest.
    """
    links = settled(edges.select("src", "dst").distinct())
    paths, fresh = links, links
    for k in range(steps):
        grown = fresh.toDF("src", "via").join((paths if doubling else links).toDF("via", "dst"), "via").select("src", "dst")
        if doubling:
            grown = grown.union(paths.toDF("src", "via").join(fresh.toDF("via", "dst"), "via").select("src", "dst"))
        fresh = settled(grown.distinct().join(paths, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return Iterated(paths, k + 1, True)
        paths = paths.union(fresh)
    return Iterated(paths, steps, False)


def triangles(edges: DataFrame, as_written: bool = False) -> DataFrame:
    """``v1, v2, v3`` in ascending order. Edges are directed from the end of lower degree, so that a hub opens few pairs. Edges
    are worked out once.

    Of whole numbers no open pair is a row: they are closed in the memory of ``cells``.  Only vertices of over four times the mean
    degree are told apart by it (of many edges, by their share of a part); which end an edge leaves decides on the work, not on the result.
    ``as_written``: one pair a vertex, of its two smallest larger neighbours.
    """
    if as_written:
        e = settled(ordered_edges(edges))
        ranked = e.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("k <= 2")
        pair = ranked.groupBy("src").agg(F.min("dst").alias("v2"), F.max("dst").alias("v3"), F.count("*").alias("m")).where("m = 2")
        return pair.select(F.col("src").alias("v1"), "v2", "v3").join(e.select(F.col("src").alias("v2"), F.col("dst").alias("v3")), ["v2", "v3"]).select("v1", "v2", "v3")
    pairs = _smaller_first(edges)
    kind = pairs.schema["src"].dataType
    if not isinstance(kind, IntegralType):
        return _joined_triangles(settled(pairs.distinct()))
    e = stored(pairs.select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst")]))
    size = e.agg(F.count("*").alias("n"), F.min("src").alias("least"), F.max("dst").alias("most")).first()
    wide = bool(size.n) and not -(1 << 31) <= size.least <= size.most < 1 << 31
    directed = e.select(F.col("src").alias("low"), F.col("dst").alias("high"))
    hubs = _hubs(e, size.n)
    if hubs is not None:
        a, b = F.broadcast(hubs.toDF("src", "ds")), F.broadcast(hubs.toDF("dst", "dd"))
        turned = F.coalesce("ds", F.lit(0)) > F.coalesce("dd", F.lit(0))
        ends = [F.when(turned, F.col(x)).otherwise(F.col(y)) for x, y in (("dst", "src"), ("src", "dst"))]
        directed = e.join(a, "src", "left").join(b, "dst", "left").select(ends[0].alias("low"), ends[1].alias("high"))
    return cells.closed(directed, size.n, wide).select(*[F.col(f"v{k}").cast(kind).alias(f"v{k}") for k in (1, 2, 3)])


def _hubs(e: DataFrame, n: int) -> DataFrame | None:
    """``(v, d)`` of the vertices of over four times the mean degree, HUBS at most; None if there are none."""
    every = max(1, n // COUNTED)
    counted = e.where(F.pmod(F.xxhash64("src", "dst"), F.lit(every)) == 0).distinct() if every > 1 else e.distinct()
    degree = settled(mirrored(counted).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d")))
    size = degree.agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("ends")).first()
    hubs = degree.where(F.col("d") > max(4 * size.ends / max(1, size.n), size.ends / HUBS))
    return None if hubs.isEmpty() else hubs


def _joined_triangles(e: DataFrame) -> DataFrame:
    degree = mirrored(e).groupBy("src").agg(F.count("*").alias("d")).withColumnRenamed("src", "v")
    a = degree.select(F.col("v").alias("src"), F.col("d").alias("ds"))
    b = degree.select(F.col("v").alias("dst"), F.col("d").alias("dd"))
    lower = F.struct("ds", "src") < F.struct("dd", "dst")
    out = settled(e.join(a, "src").join(b, "dst").select(F.when(lower, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(lower, F.col("dst")).otherwise(F.col("src")).alias("high")))
    open_ = out.alias("x").join(out.alias("y"), "low").where("x.high < y.high").select("low", F.col("x.high").alias("src"), F.col("y.high").alias("dst"))
    v = open_.join(e, ["src", "dst"]).select(F.sort_array(F.array("low", "src", "dst")).alias("t"))
    return v.select(*[F.col("t")[k].alias(f"v{k + 1}") for k in range(3)])
