"""Figures that a job counts beside its rows, while it writes them (observed metrics), instead of counting again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Figures:
    """The figures of one job, by step.  ``watch`` a table just before the action that writes it."""

    def __init__(self) -> None:
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        seen = Observation(f"{step}-{uuid.uuid4().hex}")
        self._watched.append((step, seen))
        return df.observe(seen, *(c.alias(n) for n, c in counts.items()))

    def collected(self) -> dict[str, dict[str, int]]:
        """Figures by step, of tables that have been written; a count over no rows is 0."""
        out: dict[str, dict[str, int]] = {}
        for step, seen in self._watched:
            out.setdefault(step, {}).update({k: v or 0 for k, v in seen.get.items()})
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """``step, figure, value``, in the order of the job."""
        rows = [(step, name, int(v)) for step, of in self.collected().items() for name, v in of.items()]
        return spark.createDataFrame(rows, "step string, figure string, value long")
