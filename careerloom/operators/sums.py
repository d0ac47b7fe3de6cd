"""Sums of large vectors over all rows: tasks add up their rows, blocks are added by tasks of their own, and the driver gets one vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of a block.
BLOCK = 1 << 17


def summed(rows: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over all batches of ``rows``; zeros without rows. ``part`` gives ``size`` numbers, which bounds what a task and the driver hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = part(batch) if total is None else total + part(batch)
        if total is not None:
            cuts = range(0, size, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([total[k : k + BLOCK].tobytes() for k in cuts], pa.binary())], ["block", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [np.sum([np.frombuffer(s) for s in frame["sums"]], 0).tobytes()]})

    got = rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInPandas(added, "block int, sums binary").collect()
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(got, key=lambda r: r["block"])]) if got else np.zeros(size)


def entries(at: list | pa.Array, x: list | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and row numbers of sparse rows."""
    if isinstance(at, pa.Array):
        sizes = np.diff(np.asarray(at.offsets)).astype(np.int64)
        places, values = np.asarray(at.flatten()).astype(np.int64), np.asarray(x.flatten()).astype(float)
    else:
        sizes = np.array([len(a) for a in at], np.int64)
        places = np.concatenate([np.asarray(a, np.int64) for a in at]) if sizes.sum() else np.zeros(0, np.int64)
        values = np.concatenate([np.asarray(a, float) for a in x]) if sizes.sum() else np.zeros(0)
    return places, values, np.repeat(np.arange(len(sizes)), sizes)
