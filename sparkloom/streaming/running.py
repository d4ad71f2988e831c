"""Running aggregates of a stream: one update a record, not one a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_updates(df: DataFrame, key: str = "word") -> DataFrame:
    """``key, n`` for every record of a streaming frame: how many its key has had so far."""
    kind = df.schema[key].dataType.simpleString()

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for p in parts:
            yield pd.DataFrame({key: [k[0]] * len(p), "n": range(n + 1, n + len(p) + 1)})
            n += len(p)
        state.update((n,))

    return df.select(key).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long", "n long", "append", GroupStateTimeout.NoTimeout)
