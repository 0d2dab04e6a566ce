"""Batches with progress: results are written, and a callback hears how far the tasks are."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from verisift.operators.identity import analyze, batch_summary


def analyze_many(files: DataFrame, path: str, *, skip_metadata: bool = False, on_progress: Callable[[int, int], None] | None = None, every: float = 0.2) -> tuple[DataFrame, dict]:
    """Writes the results of all files as Parquet to ``path``. Returns them, and total, succeeded, failed, success_rate and duration_seconds.
    ``on_progress(completed, total)`` counts tasks, and is called a last time when all are done."""
    spark = files.sparkSession
    sc, group = spark.sparkContext, f"analyze-{uuid.uuid4().hex}"
    stop = threading.Event()

    def watch() -> None:
        tracker, told = sc.statusTracker(), None
        while not stop.wait(every):
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
            now = (sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s))
            if now != told and now[1]:
                on_progress(*now)
                told = now

    began = time.perf_counter()
    sc.setJobGroup(group, "analyze_many")
    watcher = threading.Thread(target=watch, daemon=True)
    if on_progress:
        watcher.start()
    try:
        analyze(files, skip_metadata=skip_metadata).write.mode("overwrite").parquet(path)
    finally:
        stop.set()
        sc.setLocalProperty("spark.jobGroup.id", None)
    results = spark.read.parquet(path)
    summary = batch_summary(results).first().asDict() | {"duration_seconds": round(time.perf_counter() - began, 3)}
    if on_progress:
        watcher.join()
        on_progress(summary["total"], summary["total"])
    return results, summary
