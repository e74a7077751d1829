"""Counters of the stages of a run, observed while it runs: no job of their own, no second pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """What left a stage: rows, and those of them that failed. rows_in is what left the stage before."""

    name: str
    rows_in: int | None
    rows_out: int
    failed: int


class Progress:
    """Wraps the frames between stages; after an action, `stages` tells what went through each.

    Counts are those of the first action that finishes over the observed plan. If a task runs again its rows count once,
    as Spark merges the counts of a partition's successful attempt. A plan that reads a stage twice counts its rows twice.
    """

    def __init__(self, on_stage: Callable[[Stage], None] | None = None):
        self.on_stage = on_stage
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, name: str, df: DataFrame, failed: Column | None = None) -> DataFrame:
        """The same rows, counted under `name`; `failed` holds for rows that count as failed."""
        observation = Observation(f"{name}-{len(self._watched)}")
        self._watched.append((name, observation))
        wrong = F.lit(0).cast("long") if failed is None else F.coalesce(F.sum(F.when(failed, 1)), F.lit(0)).cast("long")
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), wrong.alias("failed"))

    def stages(self) -> list[Stage]:
        """The counts in the order of the stages. Waits for the action; call it after one. Hands each stage to `on_stage`."""
        out: list[Stage] = []
        for name, observation in self._watched:
            found = observation.get
            out.append(Stage(name, out[-1].rows_out if out else None, found["rows"], found["failed"]))
        for stage in out if self.on_stage is not None else ():
            self.on_stage(stage)
        return out
