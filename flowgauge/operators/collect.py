"""What a phase of a run costs: wall time, and Spark's own figures of the tasks it ran.

A collector is asked at the start and at the end of a phase; user code adds its
own. The jobs of a phase run in a job group of their own, so figures of tasks are
those of that phase only, also while others run beside it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, phase string, collector string, metric_key string, value double"


class Collector(Protocol):
    def start(self, spark: SparkSession, group: str) -> None: ...

    def stop(self, spark: SparkSession, group: str) -> dict[str, float]: ...


class WallClock:
    """Seconds from start to end."""

    def start(self, spark: SparkSession, group: str) -> None:
        self.at = time.perf_counter()

    def stop(self, spark: SparkSession, group: str) -> dict[str, float]:
        return {"runtime_s": time.perf_counter() - self.at}


class TaskFigures:
    """Sums over the finished tasks of the group's jobs, and the mean load of the cores they held."""

    def start(self, spark: SparkSession, group: str) -> None:
        self.at = time.perf_counter()

    def stop(self, spark: SparkSession, group: str) -> dict[str, float]:
        sc = spark.sparkContext
        # figures of tasks arrive by a queue, a little after the job's end
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
        infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = {s for info in infos if info is not None for s in info.stageIds}
        out = dict.fromkeys(("task_s", "task_cpu_s", "gc_s", "read_mb", "written_mb", "shuffle_mb", "spill_mb", "peak_task_mb"), 0.0)
        tasks = 0
        for stage in sorted(stages):
            try:
                s = store.lastStageAttempt(stage)
            except Exception:  # noqa: BLE001  a stage that Spark skipped, or no longer keeps, has no figures
                continue
            tasks += s.numCompleteTasks()
            out["task_s"] += s.executorRunTime() / 1e3
            out["task_cpu_s"] += s.executorCpuTime() / 1e9
            out["gc_s"] += s.jvmGcTime() / 1e3
            out["read_mb"] += s.inputBytes() / 1e6
            out["written_mb"] += s.outputBytes() / 1e6
            out["shuffle_mb"] += s.shuffleWriteBytes() / 1e6
            out["spill_mb"] += s.diskBytesSpilled() / 1e6
            out["peak_task_mb"] = max(out["peak_task_mb"], s.peakExecutionMemory() / 1e6)
        spent = max(time.perf_counter() - self.at, 1e-9)
        return {"jobs": float(len(infos)), "tasks": float(tasks), "cpu_percent": 100 * out["task_cpu_s"] / spent, **out}


# Collectors by name; user code adds its own factories.
COLLECTORS: dict[str, Callable[[], Collector]] = {"wall": WallClock, "tasks": TaskFigures}


@dataclass
class Resources:
    """Figures of the phases measured so far."""

    spark: SparkSession
    collectors: tuple[str, ...] = ("wall", "tasks")
    rows: list[tuple[str, str, str, str, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        unknown = [c for c in self.collectors if c not in COLLECTORS]
        if unknown:
            raise KeyError(f"unknown collectors {unknown}; known: {sorted(COLLECTORS)}")

    @contextmanager
    def phase(self, run_id: str, phase: str) -> Iterator[None]:
        """Measure the actions inside the block. A phase that fails is told as well."""
        sc = self.spark.sparkContext
        before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
        group = f"{run_id}|{phase}|{uuid.uuid4().hex[:8]}"
        sc.setJobGroup(group, f"{run_id} {phase}")
        active = [(name, COLLECTORS[name]()) for name in self.collectors]
        for _, c in active:
            c.start(self.spark, group)
        try:
            yield
        finally:
            sc.setLocalProperty("spark.jobGroup.id", before[0])
            sc.setLocalProperty("spark.job.description", before[1])
            for name, c in reversed(active):
                self.rows += [(run_id, phase, name, key, float(value)) for key, value in c.stop(self.spark, group).items()]

    def table(self) -> DataFrame:
        """(run_id, phase, collector, metric_key, value)."""
        return self.spark.createDataFrame(self.rows, SCHEMA)

    def samples(self) -> DataFrame:
        """(run_id, phase, cpu, ram): one sample a measured phase, as ``resource_summary`` takes them."""
        value = {k: F.max(F.when(F.col("metric_key") == k, F.col("value"))) for k in ("cpu_percent", "peak_task_mb")}
        by = self.table().where("collector = 'tasks'").groupBy("run_id", "phase")
        return by.agg(value["cpu_percent"].alias("cpu"), value["peak_task_mb"].alias("ram"))
