"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one, else a folder in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or spark.conf.get("spark.sql.warehouse.dir") + "/llm_scratch").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once (with the writer's ``options``) and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (a null key counts as the empty text)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def texts(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text, a null text as the empty one; every other column is pruned."""
    return docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias(text))
