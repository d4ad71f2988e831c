"""Iterative models: k-means, gradient descent, Monte-Carlo pi, per-row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import Iterated, bulk


def nearest(points: DataFrame, centroids: list[tuple[int, float, float]]) -> DataFrame:
    """``points(x, y)`` with ``cid`` of the nearest centroid: the lowest id of equally near ones."""
    far = [F.struct(F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2).alias("d"), F.lit(i).alias("id")) for i, x, y in sorted(centroids)]
    return points.withColumn("cid", F.array_min(F.array(*far))["id"] if far else F.lit(-1))


def k_means(points: DataFrame, centroids: list[tuple[int, float, float]], steps: int = 10) -> list[tuple[int, float, float]]:
    """Centroids are a few numbers and stay on the driver; a step is one aggregate. A centroid without points goes."""
    points = points.select("x", "y").persist()
    for _ in range(steps):
        rows = nearest(points, centroids).groupBy("cid").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()
        centroids = sorted((r.cid, r.x, r.y) for r in rows)
    points.unpersist()
    return centroids


def linear_regression(samples: DataFrame, theta: tuple[float, float] = (0.0, 0.0), steps: int = 10, rate: float = 0.01) -> tuple[float, float]:
    """Batch gradient descent on ``samples(x, y)``: theta moves by ``rate`` times the mean gradient."""
    samples = samples.select("x", "y").persist()
    for _ in range(steps):
        error = F.lit(theta[0]) + F.lit(theta[1]) * F.col("x") - F.col("y")
        a, b = samples.agg(F.avg(theta[0] - rate * error), F.avg(theta[1] - rate * error * F.col("x"))).first()
        if a is None:
            break
        theta = (a, b)
    samples.unpersist()
    return theta


def pi_estimate(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """``pi`` from points of the unit square: four times the share inside the circle."""
    return points.agg((F.sum(F.when(x * x + y * y < 1, 1).otherwise(0)) * 4 / F.count("*")).alias("pi"))


def random_points(df: DataFrame, seed: int = 7) -> DataFrame:
    return df.select(F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))


def counting_loop(start: DataFrame, until: int = 50, steps: int = 100, divisor: float = 10_000.0) -> tuple[Iterated, DataFrame]:
    """Add one to ``value`` a step until no value is under ``until``; then value / divisor * 4."""
    done = bulk(start, lambda d: d.select((F.col("value") + 1).alias("value")), steps, lambda _, new: new.where(F.col("value") < until))
    return done, done.result.select((F.col("value") / divisor * 4).alias("value"))


def increment_loop(start: DataFrame, steps: int = 2) -> Iterated:
    """The criterion is the new data itself, which is never empty: all steps are run."""
    return bulk(start, lambda d: d.select((F.col("value") + 1).alias("value")), steps, lambda _, new: new)


def fibonacci_steps(pairs: DataFrame, bound: int = 100, most: int = 64) -> DataFrame:
    """``a, b, n``: steps (p, q) -> (q, p + q) until one is ``bound`` or more; at least one, at most ``most`` (batch or stream)."""
    state = F.struct(F.col("a").cast("long").alias("p"), F.col("b").cast("long").alias("q"), F.lit(0).alias("n"))
    go = lambda s: (s["n"] == 0) | ((s["p"] < bound) & (s["q"] < bound))
    step = lambda s, _: F.when(go(s), F.struct(s["q"].alias("p"), (s["p"] + s["q"]).alias("q"), (s["n"] + 1).alias("n"))).otherwise(s)
    return pairs.select("a", "b", F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step)["n"].alias("n"))
