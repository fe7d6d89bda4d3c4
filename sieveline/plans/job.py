"""A triage that can be watched and stopped from another thread."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Cancelled(Exception):
    """The job was cancelled; names the step that did not end or did not begin."""


@dataclass
class Step:
    """A step that has ended: its name, seconds, and what was counted while its rows were written."""

    name: str
    seconds: float
    counts: dict[str, int]


@dataclass
class Job:
    """Steps of a triage under one Spark tag. cancel() ends the step that runs and keeps further ones from starting; progress is called after each step."""

    spark: SparkSession
    progress: Callable[[Step], None] = lambda step: None
    steps: list[Step] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tag = f"sieveline-{uuid.uuid4().hex}"
        self._stop = threading.Event()

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def step(self, name: str, seen: Observation | None = None) -> Iterator[None]:
        """Spark jobs of a step, under the tag. seen: counts that the step's own write observes."""
        if self.cancelled:
            raise Cancelled(f"cancelled before {name}")
        began = time.monotonic()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield
        except Exception as e:
            if self.cancelled:
                raise Cancelled(f"cancelled in {name}") from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        if self.cancelled:
            raise Cancelled(f"cancelled in {name}")
        self.steps.append(Step(name, time.monotonic() - began, dict(seen.get) if seen else {}))
        self.progress(self.steps[-1])

    def written(self, df: DataFrame, path: str, name: str, **counts) -> None:
        """df written as Parquet in a step that counts rows and what `counts` says on the way, without a second pass."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        with self.step(name, seen):
            df.observe(seen, F.count("*").alias("rows"), *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
