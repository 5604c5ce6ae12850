"""What iterative operators share: results between rounds in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds in one plan. More of them save jobs, but a plan's making grows with its joins.
AT_ONCE = 5


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the folder of ``spark.checkpoint.dir``.
    Only a local session without one falls back to a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "skein-checkpoints"))
    return df.checkpoint(eager=True)


def iterated(
    start: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    rounds: int,
    key: str,
    value: str,
    tolerance: float | None = None,
    measure: Callable = F.max,
) -> DataFrame:
    """``step(frame, round)`` applied ``rounds`` times, a few rounds to a job. With a tolerance it
    ends when ``measure`` of the values' change in the last round of a job is below it."""
    now, done = start, 0
    while done < rounds:
        last = now
        upto = min(rounds, done + AT_ONCE)
        for k in range(done, upto):
            last, now = now, step(now, k)
        done = upto
        if tolerance is None:
            now = settled(now)
            continue
        before = last.select(key, F.col(value).alias("_before"))
        both = settled(now.join(before, key))
        now = both.drop("_before")
        if both.agg(measure(F.abs(F.col(value) - F.col("_before")))).first()[0] < tolerance:
            break
    return now
