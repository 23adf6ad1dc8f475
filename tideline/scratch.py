"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one, else a folder in the warehouse.

    A warehouse on one machine's disk is refused unless Spark runs on that machine alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    alone = spark.conf.get("spark.master", "local").startswith("local") and "cluster" not in spark.conf.get("spark.master", "local")
    if warehouse.startswith(("file:", "/")) and not alone:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse.rstrip("/") + "/scratch"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh table and read that: lineage ends at files that outlive any executor."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
