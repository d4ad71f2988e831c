"""A custom unbounded source: request log lines, through the Python data source interface."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .readers import STATUSES


class RequestLogSource(DataSource):
    """``spark.readStream.format("request_log")``; option ``rowsPerBatch`` (100), ``seed`` (7)."""

    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema) -> RequestLogReader:
        return RequestLogReader(int(self.options.get("rowsPerBatch", 100)), int(self.options.get("seed", 7)))


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RequestLogReader(DataSourceStreamReader):
    def __init__(self, rows: int, seed: int):
        self.rows, self.seed, self.at = rows, seed, 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self.at += self.rows
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(start["row"], end["row"])]

    def read(self, partition: _Range) -> Iterator[tuple[str]]:
        import random

        for k in range(partition.first, partition.last):
            draw = random.Random(self.seed * 1_000_003 + k)
            yield (f"{uuid.UUID(int=draw.getrandbits(128))},{draw.randrange(100)},{int(time.time() * 1000)},{STATUSES[draw.randrange(4)]},{draw.randrange(200)}",)

    def commit(self, end: dict) -> None:
        pass
