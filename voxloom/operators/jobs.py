"""Tasks with state of their own for each worker and failures that stay with their task."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.operators import chunks

RESULT = "task_id long, success boolean, worker int, seconds double, error string, result double"


def alone(work: Callable[[pd.DataFrame], Any], rows: pd.DataFrame) -> pd.DataFrame:
    """result and error of work(rows), which gives one number for each row. Where it raises, the rows are halved until those
    that fail are alone: a bad row costs about twice as many calls as the logarithm of their number, and the others stay
    together."""
    result, error = np.full(len(rows), np.nan), np.full(len(rows), None, object)
    left = [(0, len(rows))] if len(rows) else []
    while left:
        a, b = left.pop()
        try:
            result[a:b] = np.asarray(work(rows.iloc[a:b]), dtype=float)
        except Exception as e:
            if b - a > 1:
                left += [((a + b) // 2, b), (a, (a + b) // 2)]
            else:
                error[a] = f"{type(e).__name__}: {e}"
    return pd.DataFrame({"result": result, "error": error})


def run_tasks(tasks: DataFrame, init: Callable[[], Any], work: Callable[[Any, pd.DataFrame], Any], workers: int) -> DataFrame:
    """work(state, rows) for the tasks (task_id, ...), a batch of rows at a time, with one number for each; sorted by task.
    The state is made once for each partition. There are `workers` partitions at least, and one for each core if these are
    more. Tasks are dealt by ranges of their ids and sorted there, so their results are sorted as they come: no second shuffle
    follows, which would also do all work twice, once to find its ranges.

    An exception in work fails the rows that raise it when alone, and no others; one in init fails all tasks of the
    partition. seconds are a row's share of its batch. A failed row's result is null, and so is a result that is no number."""
    def run(batches):
        state = broken = None
        try:
            state = init()
        except Exception as e:
            broken = f"{type(e).__name__}: {e}"
        for rows in batches:
            began = time.perf_counter()
            done = pd.DataFrame({"result": np.nan, "error": broken}, index=range(len(rows))) if broken else alone(lambda some: work(state, some), rows)
            share = (time.perf_counter() - began) / max(len(rows), 1)
            done = done.assign(task_id=rows["task_id"].to_numpy(), success=done["error"].isna(), worker=TaskContext.get().partitionId(), seconds=share)
            yield done[["task_id", "success", "worker", "seconds", "error", "result"]]

    parts = max(workers, tasks.sparkSession.sparkContext.defaultParallelism)
    done = tasks.repartitionByRange(parts, "task_id").sortWithinPartitions("task_id").mapInPandas(run, RESULT)
    return done.withColumn("result", F.nanvl("result", F.lit(None).cast("double")))


def each_run(rows: DataFrame, key: str, change: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """change(rows of one run) for every run, with an error column: a run that fails has one row with its key and the error.

    A group is what is known of one run; keep voxels out of it."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return change(pdf).assign(error=None)
        except Exception as e:
            return pd.DataFrame([{**dict.fromkeys(names), key: pdf[key].iloc[0], "error": f"{type(e).__name__}: {e}"}])

    return rows.groupBy(key).applyInPandas(run, f"{schema}, error string")


def filter_volumes(jobs: DataFrame, volumes: DataFrame, edge: int, spacing: float, to: float) -> tuple[DataFrame, DataFrame]:
    """A downsampling job over runs: (run, d, h, w, z, y, x, v) of the jobs' volumes, and one row for each job with what it
    makes or why it makes nothing, which follows from the volumes' sizes alone. jobs: run, name; volumes: chunks."""
    if to < spacing:
        raise ValueError("only coarser spacings")
    found = jobs.select("run", "name").join(chunks.extents(volumes, "run", edge), "run", "left")
    error = F.when(F.col("whole").isNull(), "no volume").when(~F.col("whole"), "voxels are missing")
    size = lambda n: F.when(error.isNull(), text.rescaled(F.col(n), F.lit(spacing), F.lit(to))).alias(n)
    table = found.select("run", "name", size("d"), size("h"), size("w"), error.alias("error"))
    done = chunks.rescaled(volumes.join(table.where("error IS NULL").select("run"), "run", "left_semi"), "run", edge, spacing, to)
    return done, table.select("run", "name", "d", "h", "w", (F.col("d").cast("long") * F.col("h") * F.col("w")).alias("voxels"), "error")
