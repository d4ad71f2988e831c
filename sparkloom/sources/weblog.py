"""Seeded generator of web-log files: documents, ranks and visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = ("harbour", "lantern", "meadow")
FILLER = tuple("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy".split())


def documents(spark: SparkSession, n: int, seed: int = 7, keywords: tuple[str, ...] = KEYWORDS, filler: tuple[str, ...] = FILLER) -> DataFrame:
    """``url, contents``: 10 to 49 words, about a tenth of them keywords."""
    draw = lambda i, k, m: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i, F.lit(k)), F.lit(m)).cast("int")
    pick = lambda words, i, k: F.element_at(F.array(*map(F.lit, words)), draw(i, k, len(words)) + 1)
    size = draw(F.lit(0), 0, 40) + 10
    words = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(draw(i, 1, 10) == 0, pick(keywords, i, 2)).otherwise(pick(filler, i, 3)))
    return spark.range(n).select(F.concat(F.lit("url_"), "id").alias("url"), F.array_join(words, " ").alias("contents"))


def ranks(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """``rank, url, avg_duration``: ranks 0 to 99, durations 0 to 58."""
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(m)).cast("int")
    return spark.range(n).select(draw(1, 100).alias("rank"), F.concat(F.lit("url_"), "id").alias("url"), (draw(2, 10) + draw(3, 50)).alias("avg_duration"))


def visits(spark: SparkSession, n: int, urls: int, seed: int = 7) -> DataFrame:
    """Nine columns; dates are unpadded text, years 2000 to 2009, days 1 to 27."""
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(m)).cast("int")
    ip = F.concat_ws(".", *[draw(k, 256).cast("string") for k in range(10, 14)])
    date = F.concat_ws("-", (draw(1, 10) + 2000).cast("string"), (draw(2, 12) + 1).cast("string"), (draw(3, 27) + 1).cast("string"))
    fixed = {"revenue": "0.12", "agent": "agent", "country": "DE", "language": "de", "word": "word", "duration": "0"}
    return spark.range(n).select(ip.alias("ip"), F.concat(F.lit("url_"), draw(4, urls).cast("string")).alias("url"), date.alias("visit_date"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def write_files(df: DataFrame, path: str) -> None:
    """Fields parted by ``|``, each line ending with one."""
    df.select(F.concat(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]), F.lit("|")).alias("value")).write.mode("overwrite").text(path)
