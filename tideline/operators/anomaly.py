"""Data-driven thresholds and the separation of real activity from artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clipped
from .quantiles import exact_quantiles
from .scans import null_safe
from .timeline import HOUR, beside


def speed_thresholds(df: DataFrame, value: str, *, key: str, active: float = 1.0, floor: float = 300.0, active_p: float = 0.75, suspicious_p: float = 0.999) -> DataFrame:
    """Per key: the usual speed of active samples, and the speed from which one is suspicious (null without any)."""
    on = F.when(F.col(value) > active, F.col(value))
    found = exact_quantiles(df, {"active_base": (on, active_p), "top": (on, suspicious_p)}, keys=[key])
    return found.select(key, "active_base", F.when(F.col("top").isNotNull(), F.greatest("top", F.lit(floor))).alias("suspicious"))


def activity_status(df: DataFrame, value: str, thresholds: DataFrame, *, key: str, series: str, ts: str, tie: str, ratio: float = 10.0, chunk_us: int = HOUR) -> DataFrame:
    """``status``: a suspicious sample is real if its neighbours move too, an artefact if it stands alone.

    ``thresholds`` has one row per ``key``: Spark broadcasts it if its size allows, and else splits a hot key.
    """
    beside_it = beside(df, {"v": F.col(value)}, key=series, ts=ts, tie=tie, chunk_us=chunk_us)
    near = F.greatest(F.coalesce("before_v", F.lit(0.0)), F.coalesce("after_v", F.lit(0.0)))
    joined = null_safe(beside_it.select(*df.columns, near.alias("near")), thresholds, [key], "left").withColumn("isolation", F.col(value) / (F.col("near") + 1))
    high = F.col(value) > F.col("suspicious")
    real = high & ((F.col("near") > F.col("active_base")) | (F.col("isolation") < ratio))
    alone = high & (F.col("near") < F.col("active_base")) & (F.col("isolation") > ratio)
    return joined.withColumn("status", F.when(F.coalesce(real, F.lit(False)), "Real_Activity").when(F.coalesce(alone, F.lit(False)), "Artifact").otherwise("Normal"))


def effort_limits(df: DataFrame, value: str, *, key: str, lowest: float = 0.01, factor: float = 1.5, highest: float = 3.0) -> DataFrame:
    """Per key the noise floor and the ceiling of effort, learnt from rows that are no artefacts."""
    sane = F.when(F.col("status") != "Artifact", F.col(value))
    found = exact_quantiles(df, {"mid": (sane, 0.5), "top": (sane, 0.999)}, keys=[key])
    return found.select(key, F.greatest(factor * F.col("mid"), F.lit(lowest)).alias("noise_floor"), F.least("top", F.lit(highest)).alias("impact_ceiling"))


def behaviour_thresholds(df: DataFrame, *, key: str, effort: str, roll: str | None = None, pitch: str | None = None, speed: str | None = None, lying: tuple[float, float] = (40.0, 80.0)) -> DataFrame:
    """Per key: low and high effort, lying angle, head-down pitch, active speed, with their usual values where nothing tells."""
    over = lambda c, least: F.when(F.col(c) > least, F.col(c))
    wanted = {"low": (over(effort, 0), 0.33), "high": (over(effort, 0), 0.75)}
    usual = {"low": 0.01, "high": 0.05, "head_down": 10.0, "active": 10.0}
    if roll:
        wanted["lying"] = (F.abs(F.col(roll)), 0.9)
    if pitch:
        wanted["head_down"] = (over(pitch, 0), 0.75)
    if speed:
        wanted["active"] = (over(speed, 1), 0.75)
    found = exact_quantiles(df, wanted, keys=[key])
    return found.select(key, *(clipped(F.col(c), *lying).alias(c) if c == "lying" else F.coalesce(c, F.lit(usual[c])).alias(c) for c in wanted))


def cleaned_effort(effort: Column, status: Column, strength: Column, floor: Column, ceiling: Column) -> Column:
    """Artefacts and free fall become 0, then values under the noise floor, then peaks are capped."""
    x = F.when((status == "Artifact") | F.coalesce(strength < 0.2, F.lit(False)), 0.0).otherwise(effort)
    x = F.when(x < floor, 0.0).otherwise(x)
    return F.when(x > ceiling, ceiling).otherwise(x)


def around_first(df: DataFrame, condition: Column, *, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows within ``seconds`` of each key's first row that meets ``condition``."""
    first = df.filter(condition).groupBy(key).agg(F.min(ts).alias("_at"))
    span = F.expr(f"interval {seconds} seconds")
    return df.join(first, key).filter((F.col(ts) >= F.col("_at") - span) & (F.col(ts) <= F.col("_at") + span)).withColumnRenamed("_at", "centre")
