"""Loops that survive a lost driver: their state is written at intervals and read again on restart."""

from __future__ import annotations

import math
import pickle
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

#: Hours between failures of one machine.
MTTF_HOURS = 4000.0


def interval_seconds(machines: int, checkpoint_seconds: float) -> float:
    """Young's interval: the square root of twice the system's time between failures times the time of a checkpoint."""
    return math.sqrt(2 * MTTF_HOURS * 3600 / max(1, machines) * checkpoint_seconds)


class Checkpoints:
    """States of one loop in a shared folder, as single-row Parquet tables named by iteration; only this loop writes there."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs, self.path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def save(self, iteration: int, state: Any) -> None:
        row = self.spark.createDataFrame([(iteration, bytearray(pickle.dumps(state)))], "iteration long, state binary")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{iteration:09d}")

    def latest(self) -> tuple[int, Any] | None:
        """The last state that was written whole."""
        if not self.fs.exists(self.path):
            return None
        for name in sorted((s.getPath().getName() for s in self.fs.listStatus(self.path)), reverse=True):
            if self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")):
                r = self.spark.read.parquet(f"{self.folder}/{name}").first()
                return r["iteration"], pickle.loads(bytes(r["state"]))
        return None

    def clear(self) -> None:
        self.fs.delete(self.path, True)


def run(spark: SparkSession, step: Callable[[int, Any], Any], state: Any, iterations: int, folder: str, every: float | None = None, machines: int = 1, restart: bool = False, keep: bool = False) -> Any:
    """state = step(i, state) for i below iterations, saved when `every` seconds have passed since the last save.

    every: by default Young's interval for so many machines, from the time that the last save took (at
    first one second). restart: go on from the latest state in the folder. The folder goes at the end
    unless keep.
    """
    saved, first, cost = Checkpoints(spark, folder), 0, 1.0
    if restart and (found := saved.latest()):
        first, state = found
    last = time.monotonic()
    for i in range(first, iterations):
        state = step(i, state)
        if time.monotonic() - last >= (interval_seconds(machines, cost) if every is None else every):
            began = time.monotonic()
            saved.save(i + 1, state)
            last = time.monotonic()
            cost = last - began
    if not keep:
        saved.clear()
    return state
