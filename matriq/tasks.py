"""Work in the background: computed apart, applied at the end, and interrupted in Spark itself when cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


@dataclass
class Task:
    name: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "pending"  # pending, running, completed, failed, cancelled
    progress: float = 0.0
    result: Any = None
    error: str = ""
    ended: float = 0.0
    stop: threading.Event = field(default_factory=threading.Event)


class Tasks:
    """compute(report) runs on a worker under a job tag; apply(value) runs after it, unless the task was cancelled."""

    def __init__(self, spark: SparkSession, workers: int = 2, keep_seconds: float = 300):
        self.spark, self.keep = spark, keep_seconds
        self.pool = ThreadPoolExecutor(workers)
        self.tasks: dict[str, Task] = {}

    def submit(self, name: str, compute: Callable[[Callable[[float], None]], Any], apply: Callable[[Any], Any] = lambda v: v) -> Task:
        self._forget()
        task = Task(name)
        self.tasks[task.id] = task

        def run() -> None:
            if task.stop.is_set():
                return self._end(task, "cancelled")
            task.status = "running"
            self.spark.addTag(task.id)
            try:
                value = compute(lambda share: setattr(task, "progress", share))
                if task.stop.is_set():
                    return self._end(task, "cancelled")
                task.result = apply(value)
                self._end(task, "completed")
            except Exception as e:
                task.error = str(e)
                self._end(task, "cancelled" if task.stop.is_set() else "failed")
            finally:
                self.spark.removeTag(task.id)

        self.pool.submit(inheritable_thread_target(self.spark)(run))
        return task

    def cancel(self, task_id: str) -> None:
        self.tasks[task_id].stop.set()
        self.spark.interruptTag(task_id)

    def get(self, task_id: str) -> Task:
        return self.tasks[task_id]

    @staticmethod
    def _end(task: Task, status: str) -> None:
        task.status, task.ended = status, time.monotonic()
        task.progress = 1.0 if status == "completed" else task.progress

    def _forget(self) -> None:
        now = time.monotonic()
        self.tasks = {k: t for k, t in self.tasks.items() if not t.ended or now - t.ended < self.keep}
