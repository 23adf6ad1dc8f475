"""Tasks as JSON objects, for those who start jobs from files: each names its kind, its inputs and its output folder."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beats, quality
from ..sources import text_logs
from .jobs import angle_job, beats_job, imu_job
from .outputs import publish

#: Settings and the ways to resample.
SETTINGS = {"language": "zh", "batch_size": 2, "cache_size": 1, "correct": True, "interpolation_algorithm": "original_timestamps"}
ALGORITHMS = ("original_timestamps", "uniform_grid")


def settings(text: str | None) -> dict[str, Any]:
    """Settings of a JSON text over the usual ones: an unknown algorithm, or a text that is no JSON object, gives the usual ones.

    ``origin_resample`` is the old name of the algorithm.  Batch and cache sizes are kept but not used: Spark sizes its tasks.
    """
    try:
        given = json.loads(text) if text else {}
    except json.JSONDecodeError:
        given = {}
    given = given if isinstance(given, dict) else {}
    out = SETTINGS | given
    if "origin_resample" in given and "interpolation_algorithm" not in given:
        out["interpolation_algorithm"] = ALGORITHMS[0 if given["origin_resample"] else 1]
    if out["interpolation_algorithm"] not in ALGORITHMS:
        out["interpolation_algorithm"] = SETTINGS["interpolation_algorithm"]
    return out


def _signals(spark: SparkSession, task: dict[str, Any], cached: bool) -> DataFrame:
    read = text_logs.read_cache if cached else text_logs.read_ecg
    parts = [read(spark, path).select("source", "ts", "data") for path in task["selected_files"]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_task(spark: SparkSession, task: dict[str, Any], **options) -> str:
    """Run one task and publish its tables below its output folder; the run's name."""
    kind = task["task_type"]
    if kind in ("convert", "convert_cache", "cache_only"):
        config = settings(json.dumps(task.get("config", {})))
        keep = config["interpolation_algorithm"] == ALGORITHMS[0]
        rows = _signals(spark, task, kind == "convert_cache")
        if kind == "cache_only":
            even = beats.resample_seconds(rows, key="source", ts="ts", value="data", keep_times=keep)
            return publish({"cache": even}, task["output_dir"])
        return beats_job(rows, task["output_dir"], value="data", keep_times=keep, resample=kind == "convert", correct=config["correct"], **options)
    if kind == "heart_process":
        return publish({"heart": text_logs.read_labels(spark, task["source_dir"]).orderBy("ts")}, task["save_path"])
    if kind == "folder_inspect":
        files, wrong = text_logs.listed(spark, task["source_dir"])
        found = quality.folder_messages(files) if not wrong else spark.range(1).select(F.lit("").alias("folder"), F.lit(f"root_{wrong}").alias("finding"), F.lit("").alias("file_name"), F.lit(task["source_dir"]).alias("detail"))
        return publish({"messages": found}, task["save_path"])
    if kind == "move_old":
        return angle_job(text_logs.read_angles(spark, task["source_dir"]), task["save_path"])
    if kind == "move_new":
        return imu_job(text_logs.read_imu(spark, task["source_dir"]), task["save_path"])
    raise ValueError(f"unknown task {kind}")
