"""Tables of hashed counters over all rows: a bounded summary of how often things occur."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slots(h: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each 64-bit hash."""
    return (h % np.uint64(counters)).astype(np.int64)


def tally(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], counters: int) -> np.ndarray:
    """How many of the hashes that ``hashes`` gives for each batch of ``rows`` fall on each counter.

    Each task sums its own rows; Spark adds the tasks' sums counter by counter, so no task holds more than one table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            for h in hashes(batch):
                total += np.bincount(slots(h, counters), minlength=counters)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["slot", "n"])

    found = rows.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(counters, dtype=np.int64)
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return total
