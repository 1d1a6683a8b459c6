"""The sliding window over epochs that arrive one by one: keyed state with event time, timers and an end.

A key is a block of ``SERIES`` series, so that one call of a kernel fits the windows of all of them. Its list state holds an
entry per epoch: the values and weights of the block's series. A window of consecutive epochs is fitted when its last missing
row arrives, in whatever order rows come; a series that lacks an epoch has no window around it.

Epochs are event times. The watermark trails the newest one by ``lag`` epochs: rows behind it leave the stream, and what no window
can need any more leaves the state, which thus holds ``lag`` and a window's length of epochs at most. A timer, one per
block, fires when the watermark has passed all windows of the newest row; a block without newer rows by then is closed and its
state is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from terraloom.operators import window_fit
from terraloom.schema import EPOCH_DAYS, HALF

#: Series in a block.
SERIES = 64
OUT = "px long, t int, fit double, mean double, late boolean"
STATE = "t int, px array<bigint>, v array<double>, w array<double>"
_MS = EPOCH_DAYS * 86_400_000
#: Epochs before epoch 0 that event time begins with, as a watermark starts at 0 and what isn't above it is late.
BEFORE = 1000
_STORE = "spark.sql.streaming.stateStore.providerClass"


def completed(px: np.ndarray, t: np.ndarray, v: np.ndarray, w: np.ndarray, new: np.ndarray, half: int = HALF) -> pd.DataFrame:
    """The windows of consecutive epochs that the rows marked ``new`` complete, with the parabola's value at the centre and the mean."""
    ids, row = np.unique(px, return_inverse=True)
    epochs, col = np.unique(t, return_inverse=True)
    width = 2 * half + 1
    if len(epochs) < width:
        return pd.DataFrame({"px": [], "t": [], "fit": [], "mean": [], "late": []})
    values, weights = np.full((2, len(ids), len(epochs)), np.nan)
    there, before = np.zeros((2, len(ids), len(epochs)), bool)
    values[row, col], weights[row, col], there[row, col] = v, w, True
    before[row[~new], col[~new]] = True
    whole = lambda m: np.logical_and.reduce(window_fit.around(m, half))
    full = whole(there) & ~whole(before) & (epochs[width - 1 :] - epochs[: len(epochs) - width + 1] == width - 1)
    used = np.flatnonzero(full.any(axis=0))
    vs, ws = ([m[:, used] for m in window_fit.around(x, half)] for x in (values, weights))
    fit, seen = window_fit.coefficients(vs, ws)[0], sum(np.isfinite(x).astype(int) for x in vs)
    mean = sum(np.nan_to_num(x) for x in vs) / np.where(seen > 0, seen, np.nan)
    at = np.nonzero(full[:, used])
    return pd.DataFrame({"px": ids[at[0]], "t": epochs[used[at[1]] + half], "fit": fit[at], "mean": mean[at], "late": False})


class Windows(StatefulProcessor):
    """Of one block of series."""

    def __init__(self, half: int = HALF):
        self.half = half

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.epochs = handle, handle.getListState("epochs", STATE)

    def _held(self) -> tuple[np.ndarray, ...]:
        """px, t, v, w of the rows in the state."""
        rows = list(self.epochs.get()) if self.epochs.exists() else []
        whole = lambda parts, kind: np.concatenate(parts).astype(kind) if rows else np.empty(0, kind)
        return whole([r[1] for r in rows], np.int64), whole([np.full(len(r[1]), r[0]) for r in rows], np.int64), *(whole([np.array(r[i], float) for r in rows], float) for i in (2, 3))

    def _closes_at(self, newest: int) -> int:
        return (newest + 2 * self.half + 1 + BEFORE) * _MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(rows))
        px, t = come["px"].to_numpy(np.int64), come["t"].to_numpy(np.int64)
        held = self._held()
        known = pd.MultiIndex.from_arrays([np.r_[held[0], px], np.r_[held[1], t]]).duplicated()[len(held[0]) :]
        if known.any():
            yield pd.DataFrame({"px": px[known], "t": t[known].astype(np.int32), "fit": np.nan, "mean": np.nan, "late": True})
        fresh = ~known
        columns = [np.r_[a, b[fresh]] for a, b in zip(held, (px, t, come["v"].to_numpy(float), come["w"].to_numpy(float)), strict=True)]
        out = completed(*columns, np.r_[np.zeros(len(held[0]), bool), np.ones(int(fresh.sum()), bool)], self.half)
        if len(out):
            yield out.astype({"px": "int64", "t": "int32"})
        needed = columns[1] > timerValues.getCurrentWatermarkInMs() // _MS - BEFORE - (2 * self.half + 1)
        px, t, v, w = (c[needed] for c in columns)
        order = np.argsort(t, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(t[order])) + 1) if len(t) else []
        if not parts:
            self.epochs.clear()
            return
        self.epochs.put([(int(t[p[0]]), px[p].tolist(), v[p].tolist(), w[p].tolist()) for p in parts])
        if next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(self._closes_at(int(t.max())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self._held()[1]
        if len(newest) and self._closes_at(int(newest.max())) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._closes_at(int(newest.max())))
        else:
            self.epochs.clear()
        return iter([])

    def close(self) -> None:
        pass


def windows(stream: DataFrame, half: int = HALF, lag: int = 0) -> DataFrame:
    """px, t, fit, mean, late for every full window of a stream (px, t, v, w); rows that repeat one in the state are given as ``late``,
    without fit and mean."""
    timed = stream.select("px", "t", "v", "w", F.timestamp_millis((F.col("t").cast("long") + BEFORE) * _MS).alias("at")).withWatermark("at", f"{lag * EPOCH_DAYS} days")
    blocks = timed.withColumn("block", F.floor(F.col("px") / SERIES)).groupBy("block")
    return blocks.transformWithStateInPandas(Windows(half), OUT, "append", "eventtime")


def run_once(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1, lag: int = 0, progress: list | None = None) -> DataFrame:
    """All files of ``source`` so far through the sliding window into ``target``; a later call with the same checkpoint goes on
    where this one ended. ``progress`` is given what Spark tells of every batch."""
    schema = spark.read.parquet(source).schema
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        done = windows(stream.select("px", "t", "v", "w"), lag=lag).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
        if progress is not None:
            progress += done.recentProgress
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.schema(OUT).parquet(target)
