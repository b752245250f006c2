"""Bounded concurrency: a fixed number of lanes, each working through its rows in order until it has to stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_lanes(rows: DataFrame, key: str, lane: Column, lanes: int, call: Callable[[pd.DataFrame], pd.DataFrame], stop: Callable[[pd.DataFrame], pd.Series], schema: str) -> DataFrame:
    """``call`` on all rows of every lane, by ascending key, up to and with the first row for which ``stop`` holds.

    No more than ``lanes`` calls run at once; a lane is one task that streams its rows in batches and asks for nothing
    after it has stopped. lane: a number from 0; a key's rows are in one lane."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            halted = stop(frame).to_numpy()
            if halted.any():
                yield call(frame.iloc[: int(halted.argmax()) + 1])
                return
            yield call(frame)

    return rows.withColumn("__lane", lane.cast("int")).repartitionById(lanes, F.col("__lane")).sortWithinPartitions(key).drop("__lane").mapInPandas(run, schema)
