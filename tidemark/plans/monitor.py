"""Wall-clock phases of a combination, and texts per second."""

from __future__ import annotations

import os
import platform
import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


class Monitor:
    def __init__(self) -> None:
        self.started = datetime.now(timezone.utc)
        self._began = time.perf_counter()
        self.phases: list[tuple[str, float, int | None]] = []

    @contextmanager
    def phase(self, name: str, texts: int | None = None):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.phases.append((name, time.perf_counter() - began, texts))

    def total(self, name: str) -> float | None:
        own = [s for n, s, _ in self.phases if n == name]
        return sum(own) if own else None

    def snapshot(self) -> dict:
        seconds = self.total("inference")
        texts = sum(t or 0 for n, _, t in self.phases if n == "inference")
        return {
            "started_at": self.started.isoformat(),
            "total_time_seconds": time.perf_counter() - self._began,
            "load_time_seconds": self.total("load"),
            "inference_time_seconds": seconds,
            "texts_per_second": texts / seconds if seconds else None,
        }

    def execution_metrics(self, spark: SparkSession, status: str = "success", error: Exception | None = None, **identity) -> DataFrame:
        """One row about the run; scheduler variables are taken along where there are any."""
        row = {
            **identity,
            "status": status,
            "error_type": type(error).__name__ if error else None,
            "error_message": str(error) if error else None,
            **self.snapshot(),
            "python_version": platform.python_version(),
            "hostname": platform.node(),
            "process_id": os.getpid(),
            **{k.lower(): os.environ.get(k) for k in ("SLURM_JOB_ID", "SLURM_ARRAY_JOB_ID", "SLURM_ARRAY_TASK_ID")},
        }
        kinds = {int: "long", float: "double"}
        floats = ("total_time_seconds", "load_time_seconds", "inference_time_seconds", "texts_per_second")
        schema = ", ".join(f"{k} {'double' if k in floats else kinds.get(type(v), 'string')}" for k, v in row.items())
        return spark.createDataFrame([tuple(row.values())], schema)
