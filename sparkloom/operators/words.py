"""Word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def word_count(lines: DataFrame, column: str = "line") -> DataFrame:
    """``word, n`` over lower-cased words; combined before the shuffle."""
    return lines.select(F.explode(text.word_tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def whitespace_word_count(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.select(F.explode(text.whitespace_tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def routed(lines: DataFrame, column: str = "line", longest: int = 5) -> DataFrame:
    """``token, word``: every token and the name it is counted under (batch or streaming)."""
    tokens = lines.select(F.explode(text.java_split(F.lower(F.col(column)), r"\W+")).alias("token"))
    return tokens.withColumn("word", text.routed_token(F.col("token"), longest))


def routed_word_count(lines: DataFrame, column: str = "line", longest: int = 5) -> DataFrame:
    return routed(lines, column, longest).groupBy("word").agg(F.count("*").alias("n"))


def rejected_words(lines: DataFrame, column: str = "line", longest: int = 5, prefix: str = "rejected:") -> DataFrame:
    """The side output: long tokens, with a prefix."""
    return routed(lines, column, longest).where(F.length("token") > longest).select(F.concat(F.lit(prefix), "token").alias("word"))
