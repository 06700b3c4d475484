"""Accumulation over a stream of frames: running sums by place, and a running weighted mean."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["y", "x", "c"]


def running(frames: DataFrame, how: str = "sum") -> DataFrame:
    """frames: a stream of frame_id, y, x, c, v. For output in complete or update mode: y, x, c, v, frames. State: one sum for each place."""
    v = F.col("v").cast("double")
    return frames.groupBy(*KEY).agg(F.sum(v if how == "sum" else v * v).alias("v"), F.count("*").alias("frames"))


def running_product(frames: DataFrame) -> DataFrame:
    """frames with a second value w: sums of v * w."""
    return frames.groupBy(*KEY).agg(F.sum(F.col("v").cast("double") * F.col("w").cast("double")).alias("v"), F.count("*").alias("frames"))


def windowed(frames: DataFrame, every: str, late: str) -> DataFrame:
    """frames with ts: sums for each window of time; the watermark bounds the state. For append mode."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", every), *KEY).agg(F.sum(F.col("v").cast("double")).alias("v")).select(F.col("window.start").alias("start"), *KEY, "v")


class Fading(StatefulProcessor):
    """v of a place becomes (1 - alpha) * v + alpha * new, in the order of frame_id within a batch."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        v = self.value.get()[0] if self.value.exists() else 0.0
        for new in pd.concat(list(rows)).sort_values("frame_id")["v"]:
            v = (1 - self.alpha) * v + self.alpha * float(new)
        self.value.update((v,))
        yield pd.DataFrame({"y": [key[0]], "x": [key[1]], "c": [key[2]], "v": [v]})

    def close(self) -> None:
        pass


def faded(frames: DataFrame, alpha: float) -> DataFrame:
    """For update mode; needs the RocksDB state store."""
    return frames.groupBy(*KEY).transformWithStateInPandas(Fading(alpha), "y int, x int, c int, v double", "update", "none")
