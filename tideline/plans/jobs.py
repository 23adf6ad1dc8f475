"""Whole jobs with several outputs: the input is read once, the outputs appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import from_micros
from ..operators import beats
from ..operators.figures import Figures
from ..scratch import materialize
from . import movement
from .outputs import publish
from .report import movement_report

SERIES = {"key": "source", "ts": "ts", "tie": "row_no"}


def imu_job(rows: DataFrame, folder: str, **names: str) -> str:
    """Six-axis rows to the tables ``seconds`` (features), ``samples`` (cleaned series) and ``report_...``, in one published run."""
    return _movement_job(rows, folder, movement.imu_samples, movement.imu_seconds, SERIES | names)


def angle_job(rows: DataFrame, folder: str, **names: str) -> str:
    """Angle rows to the same tables."""
    return _movement_job(rows, folder, movement.angle_samples, movement.angle_seconds, SERIES | names)


def _movement_job(rows: DataFrame, folder: str, clean, summarise, names: dict[str, str]) -> str:
    figures = Figures()
    samples = clean(rows, figures=figures, **names)  # written once; all outputs read that
    report = {f"report_{k}": v for k, v in movement_report(samples, figures, **names).items()}
    return publish({"seconds": summarise(samples, **names), "samples": samples, **report}, folder)


def beats_job(rows: DataFrame, folder: str, *, key: str = "source", ts: str = "ts", value: str = "adc", cleaned: bool = False, resample: bool = True, keep_times: bool = False, **options) -> str:
    """A signal to the tables ``signal`` (with labels), ``labels`` (beats alone) and, if asked for, ``cleaned`` (the cleaned signal with labels)."""
    even = rows
    if resample:
        even = beats.resample_seconds(rows, key=key, ts=ts, value=value, keep_times=keep_times).withColumn(ts, from_micros(F.col("us"))).select(key, ts, F.col("value").alias(value))
    labelled = materialize(beats.label_beats(even, key=key, ts=ts, value=value, **options).withColumn("ts", from_micros(F.col("us"))), "labelled")
    tables = {"signal": labelled.select(key, "ts", F.col("value").alias("data"), "label"), "labels": labelled.filter("label = 1").select(key, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), "label")}
    if cleaned:
        tables["cleaned"] = labelled.select(key, "ts", F.col("clean").alias("data"), "label")
    return publish(tables, folder)
