"""The report of a movement recording, put together from tables, and a Markdown form of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import from_micros, micros
from ..operators import anomaly, quality, timeline
from ..operators.figures import Figures
from .movement import posture_zero


def sampling(samples: DataFrame, *, key: str, ts: str, width: str = "1 second", low: int = 5, high: int = 15) -> DataFrame:
    """``key, slot, n, status`` of every slot between a recording's first and last row."""
    slots = timeline.dense_counts(samples, ts=ts, width=width, key=key)
    return slots.withColumn("status", quality.rate_status(F.col("n"), low, high))


def abnormal_minutes(slots: DataFrame, *, key: str, per_hour: int = 60) -> DataFrame:
    """``key, start, whole_hour, missing, too_low, too_high`` of minutes with slots of too few or too many rows; an hour of such minutes alone is one row."""
    minute = F.date_trunc("minute", "slot").cast("timestamp_ntz")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("missing", "too_low", "too_high")]
    bad = slots.groupBy(key, minute.alias("minute")).agg(*counts).filter("too_low > 0 or too_high > 0")
    hour = F.date_trunc("hour", "minute").cast("timestamp_ntz")
    sums = [F.sum(c).alias(c) for c in ("missing", "too_low", "too_high")]
    hours = bad.groupBy(key, hour.alias("hour")).agg(F.count("*").alias("_k"), *sums, F.array_sort(F.collect_list(F.struct("minute", "missing", "too_low", "too_high"))).alias("_m"))  # 60 at most
    whole = hours.filter(F.col("_k") == per_hour).select(key, F.col("hour").alias("start"), F.lit(True).alias("whole_hour"), "missing", "too_low", "too_high")
    parts = hours.filter(F.col("_k") < per_hour).select(key, F.inline("_m")).select(key, F.col("minute").alias("start"), F.lit(False).alias("whole_hour"), "missing", "too_low", "too_high")
    return whole.unionByName(parts)


def examples(samples: DataFrame, *, key: str, ts: str, tie: str, shown: int = 3) -> DataFrame:
    """The first ``shown`` samples of each status that is not normal, by recording: ``key, status, number, ts, gyro, near, isolation``."""
    w = timeline.order([key, "status"], ts, tie)
    rows = samples.filter("status <> 'Normal'").withColumn("number", F.row_number().over(w)).filter(F.col("number") <= shown)
    return rows.select(key, "status", "number", F.col(ts).alias("ts"), "gyro", "near", "isolation")


def thresholds(samples: DataFrame, *, key: str) -> DataFrame:
    """``key`` and the limits by which its samples were judged; each sample carries those it met."""
    kept = [c for c in ("suspicious", "active_base", "noise_floor", "impact_ceiling") if c in samples.columns]
    return samples.groupBy(key).agg(*(F.max(c).alias(c) for c in kept))


def movement_report(samples: DataFrame, figures: Figures, *, key: str = "source", ts: str = "ts", tie: str = "row_no", axes: tuple[str, ...] = ("x", "y", "z"), width: str = "1 second") -> dict[str, DataFrame]:
    """The sections of the report on ``movement.imu_samples`` or ``movement.angle_samples``, in order, each a table.

    What the job has counted while it ran comes from ``figures``; samples are read for the rest.
    """
    slots = sampling(samples, key=key, ts=ts, width=width)
    gap = F.col("dt") > 3
    before = from_micros((micros(ts) - F.round(F.col("dt") * 1e6)).cast("long"))
    return {
        "cleaning": figures.table(samples.sparkSession),
        "gaps": samples.filter(gap).select(key, before.alias("gap_start"), F.col(ts).alias("gap_end"), F.col("dt").alias("gap_s")).orderBy(key, "gap_start"),
        "sampling": slots.groupBy(key, "status").agg(F.count("*").alias("slots")).orderBy(key, "status"),
        "abnormal_minutes": abnormal_minutes(slots, key=key).orderBy(key, "start"),
        "thresholds": thresholds(samples, key=key).orderBy(key),
        "status": samples.groupBy(key, "status").agg(F.count("*").alias("samples")).orderBy(key, "status"),
        "examples": examples(samples, key=key, ts=ts, tie=tie).orderBy(key, "status", "number"),
        "posture_zero": posture_zero(samples, key=key, ts=ts, axes=list(axes)).orderBy(key),
    }


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """Each table under its heading, in the order it has; after ``rows`` rows a line says how many more there are."""
    out = [f"# {title}"]
    for name, table in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
        shown = table.limit(rows + 1).collect()
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in shown[:rows]]
        if len(shown) > rows:
            out += ["", f"{table.count() - rows} more rows in the table"]
        if not shown:
            out += ["", "nothing to report"]
    return "\n".join(out) + "\n"
