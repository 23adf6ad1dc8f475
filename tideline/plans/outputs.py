"""Several tables of one run that appear together or not at all.

Every table is written to a folder of the run; a row in the list of runs, written last, makes the run visible.
A run that fails leaves the last one in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables below ``folder`` and then list their run; the run's name."""
    run = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{folder}/runs/{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    listed = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), F.array(*map(F.lit, tables)).alias("tables"))
    listed.coalesce(1).write.mode("append").parquet(f"{folder}/published")
    return run


def published(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    """A table of the run last published, or of ``run``."""
    runs = spark.read.schema("run string, at timestamp, tables array<string>").parquet(f"{folder}/published")
    if run is None:
        run = runs.orderBy(F.desc("at"), "run").first()["run"]  # a row per run
    return spark.read.parquet(f"{folder}/runs/{run}/{name}")
