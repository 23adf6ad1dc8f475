"""Movement recordings to one row per second: six-axis loggers and angle-only loggers.

Thresholds are learnt per ``by`` (one recording by default) in dependent passes.  Every pass is written once to
``scratch`` (the session's shared folder by default) and read by the next one; the input itself is read
twice, by the rows and by what passes the borders of their chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import bucket, from_micros, micros
from ..functions.vectors import dominant_axis, flag, magnitude, pitch, roll, wrapped
from ..operators import anomaly, features, timeline
from ..operators.figures import Figures
from ..operators.quantiles import exact_quantiles
from ..operators.scans import null_safe
from ..scratch import materialize

AXES = ("X", "Y", "Z")


def _stepped(df: DataFrame, angles: list[str], *, key: str, ts: str, tie: str, chunk_us: int) -> DataFrame:
    """One row per time, with ``dt``, the angle steps and ``bad`` for steps that tell nothing."""
    rows = timeline.first_of_time(df, key=key, ts=ts, tie=tie)
    near = timeline.beside(rows, {"us": micros(ts)} | {a: F.col(a) for a in angles}, key=key, ts=ts, tie=tie, chunk_us=chunk_us, after=False)
    dt = (micros(ts) - F.col("before_us")) / F.lit(1e6)
    steps = [wrapped(F.col(a) - F.col(f"before_{a}")).alias(f"d{n}") for a, n in zip(angles, AXES)]
    return near.select(*rows.columns, dt.alias("dt"), *steps).withColumn("bad", F.col("dt").isNull() | (F.col("dt") > 3) | (F.col("dt") <= 0.001))


def _whole(df: DataFrame, axes: list[str], ts: str, figures: Figures | None, scratch: str | None) -> DataFrame:
    """Rows with a time and all axes; with ``figures``, they are counted on the way into a table."""
    if figures is None:
        return df.na.drop("any", subset=[ts, *axes])
    lacking = F.lit(False)
    for c in (ts, *axes):
        lacking = lacking | F.col(c).isNull() | (F.isnan(c) if c != ts else F.lit(False))
    counted = figures.watch(df.withColumn("_lacking", lacking), "read", rows=F.count("*"), incomplete=F.count_if("_lacking"))
    return materialize(counted.filter("not _lacking").drop("_lacking"), "whole", scratch)


def _written(df: DataFrame, name: str, scratch: str | None, figures: Figures | None, step: str, **counts: Column) -> DataFrame:
    return materialize(figures.watch(df, step, **counts) if figures else df, name, scratch)


def _statuses() -> dict[str, Column]:
    return {"real": F.count_if(F.col("status") == "Real_Activity"), "artifact": F.count_if(F.col("status") == "Artifact")}


def imu_samples(df: DataFrame, *, key: str = "source", ts: str = "ts", tie: str = "row_no", by: str | None = None, scratch: str | None = None, figures: Figures | None = None, chunk_us: int = timeline.HOUR) -> DataFrame:
    """Six-axis samples (acceleration ``x y z``, angles ``jx jy jz``) with status, gravity split and cleaned effort."""
    by = by or key
    named = df.select(*dict.fromkeys([key, by, ts, tie]), "x", "y", "z", "jx", "jy", "jz")
    rows = _stepped(_whole(named, ["x", "y", "z", "jx", "jy", "jz"], ts, figures, scratch), ["jx", "jy", "jz"], key=key, ts=ts, tie=tie, chunk_us=chunk_us)
    speed = F.when(F.col("bad"), 0.0).otherwise(magnitude(*(F.col(f"d{n}") for n in AXES)) / F.when(F.col("dt") > 0, F.col("dt")))
    rows = timeline.centred_mean(rows.withColumn("gyro", speed), ["x", "y", "z"], key=key, ts=ts)
    rows = rows.select("*", magnitude(F.col("x"), F.col("y"), F.col("z")).alias("strength"), *((F.col(a) - F.col(f"{a}_mean")).alias(f"dyn{n}") for a, n in zip("xyz", AXES)))
    rows = _written(rows.withColumn("vedba", magnitude(*(F.col(f"dyn{n}") for n in AXES))), "imu-1", scratch, figures, "times", kept=F.count("*"), gaps=F.count_if(F.col("dt") > 3))
    rows = _written(anomaly.activity_status(rows, "gyro", anomaly.speed_thresholds(rows, "gyro", key=by), key=by, series=key, ts=ts, tie=tie, chunk_us=chunk_us), "imu-2", scratch, figures, "activity", **_statuses())
    rows = null_safe(rows, anomaly.effort_limits(rows, "vedba", key=by), [by], "left")
    effort = anomaly.cleaned_effort(F.col("vedba"), F.col("status"), F.col("strength"), F.col("noise_floor"), F.col("impact_ceiling"))
    means = [F.col(f"{a}_mean") for a in "xyz"]
    rows = rows.select("*", effort.alias("effort"), roll(*means).alias("roll"), pitch(*means).alias("pitch"))
    near = timeline.beside(rows, {"effort": F.col("effort")}, key=key, ts=ts, tie=tie, chunk_us=chunk_us, after=False)
    jerk = F.when(F.col("dt") <= 0.5, F.abs(F.col("effort") - F.col("before_effort")))
    rows = near.select(*rows.columns, jerk.alias("jerk"), magnitude(F.col("roll"), F.col("pitch")).alias("tilt"))
    lost = (F.col("status") == "Artifact") | (F.col("strength") < 0.2)
    return _written(rows, "imu-3", scratch, figures, "effort", artifacts_removed=F.count_if(F.col("status") == "Artifact"), free_fall_removed=F.count_if(F.col("strength") < 0.2), noise_removed=F.count_if(~lost & (F.col("vedba") < F.col("noise_floor"))), impacts_capped=F.count_if(~lost & (F.col("vedba") > F.col("impact_ceiling"))))


def _moments(value: Column, names: dict[str, str]) -> list[Column]:
    """Aggregates of a slot's values by the names of ``features.distribution``, as ``names`` gives them."""
    n, mean, sd = F.count(value).cast("double"), F.avg(value), F.stddev_pop(value)
    g1, g2 = F.skewness(value), F.kurtosis(value)
    of = {
        "cv": F.coalesce(sd / F.nullif(mean, F.lit(0.0)), F.lit(0.0)),
        "skew": F.coalesce(F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))), F.lit(0.0)),
        "kurt": F.coalesce(F.when(n >= 4, (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * g2 + 6)), F.lit(0.0)),
        "p25": F.percentile(value, F.lit(0.25)),
        "p75": F.percentile(value, F.lit(0.75)),
        "rms": F.sqrt(F.avg(value * value)),
    }
    return [of[k].alias(v) for k, v in names.items()]


def imu_seconds(samples: DataFrame, *, key: str = "source", ts: str = "ts", tie: str = "row_no", by: str | None = None) -> DataFrame:
    """The per-second table of six-axis recordings: 59 features besides ``key`` and ``second``; one shuffle on the second."""
    by = by or key
    t = anomaly.behaviour_thresholds(samples, key=by, effort="effort", roll="roll", pitch="pitch", speed="gyro")
    e = F.col("effort")
    marks = {"Rest": e <= F.col("low"), "Moderate": (e > F.col("low")) & (e <= F.col("high")), "Vigorous": e > F.col("high"), "Lying": F.abs("roll") > F.col("lying"), "HeadDown": F.col("pitch") > F.col("head_down"), "active": F.col("gyro") > F.col("active")}
    rows = null_safe(samples, t, [by], "left").withColumn("second", bucket(ts, "1 second")).withColumns({f"is_{k}": flag(c) for k, c in marks.items()})
    mean_sd = lambda c, name: [F.avg(c).alias(f"{name}_Mean"), F.stddev_samp(c).alias(f"{name}_Std")]
    aggs = [F.avg(e).alias("Acc_Mean"), F.coalesce(F.sum(e), F.lit(0.0)).alias("Acc_Sum"), F.max(e).alias("Acc_Max"), F.min(e).alias("Acc_Min"), F.stddev_samp(e).alias("Acc_Std"), F.avg("gyro").alias("Gyro_Mean"), F.max("gyro").alias("Gyro_Max"), F.count("x").alias("Data_Count")]
    for n in AXES:
        aggs += [*mean_sd(f"dyn{n}", f"Dyn{n}"), F.stddev_samp(f"d{n}").alias(f"Ang{n}_Std"), F.avg(F.abs(f"d{n}")).alias(f"Ang{n}_Rate"), F.avg(F.abs(f"dyn{n}")).alias(f"Dyn{n}_Mean_abs")]
    aggs += [*mean_sd("strength", "AccMag"), *mean_sd("roll", "Roll"), *mean_sd("pitch", "Pitch"), F.avg("jerk").alias("Jerk_Mean"), *mean_sd("tilt", "Tilt_Mag"), F.avg("is_active").alias("Active_Fraction")]
    aggs += [F.avg(f"is_{k}").alias(f"Frac_{k}") for k in marks if k != "active"]
    aggs += [F.coalesce(features.correlation(F.col(f"dyn{a}"), F.col(f"dyn{b}")), F.lit(0.0)).alias(f"Corr_{a}{b}") for a, b in ("XY", "XZ", "YZ")]
    aggs += _moments(e, {"cv": "Coefficient_of_Variation", "skew": "Skewness", "kurt": "Kurtosis", "p25": "Acc_P25", "p75": "Acc_P75", "rms": "VeDBA_RMS"})
    slots = rows.groupBy(key, "second").agg(*aggs, features.in_order(e, ts, tie).alias("_x"))
    shaped = features.with_shapes(slots, {"_": ("_x", 10.0, ("waves", "sample", "turns"))})
    names = {"crossings": "Zero_Crossing_Rate", "peaks": "Peak_Count", "autocorr": "Autocorr_Lag1", "entropy": "Spectral_Entropy", "frequency": "Dominant_Frequency", "power_low": "Power_Low", "power_mid": "Power_Loco", "power_high": "Power_High", "sample_entropy": "Sample_Entropy"}
    derived = {"Acc_Range": F.col("Acc_Max") - F.col("Acc_Min"), "Axis_Dominance": dominant_axis(*(F.col(f"Ang{n}_Std") for n in AXES)), "ODBA": sum((F.col(f"Dyn{n}_Mean_abs") for n in AXES), F.lit(0.0)), "_peaks": F.col("_peaks").cast("long")}
    return shaped.withColumns(derived).withColumnsRenamed({f"_{k}": v for k, v in names.items()})


def posture_zero(df: DataFrame, *, key: str, ts: str, axes: list[str]) -> DataFrame:
    """Per recording the medians of the axes in the hours 23 to 4 and the number of samples there; a quality figure, nothing is moved by it."""
    night = (F.hour(ts) >= 23) | (F.hour(ts) < 4)
    medians = exact_quantiles(df, {f"zero_{a}": (F.when(night, F.col(a)), 0.5) for a in axes}, keys=[key])
    held = F.lit(True)
    for a in axes:
        held = held & F.col(a).isNotNull()
    return null_safe(medians, df.groupBy(key).agg(F.count_if(night & held).alias("n_samples")), [key], "left")


def angle_samples(df: DataFrame, *, key: str = "source", ts: str = "ts", tie: str = "row_no", by: str | None = None, scratch: str | None = None, figures: Figures | None = None, chunk_us: int = timeline.HOUR) -> DataFrame:
    """Angle samples (``x y z`` degrees) with zero runs filled, repeats of a time spread over its second, and status; artefacts are null."""
    by = by or key
    named = _whole(df.select(*dict.fromkeys([key, by, ts, tie]), "x", "y", "z"), ["x", "y", "z"], ts, figures, scratch)
    filled = _written(timeline.fill_joint_zeros(named, ["x", "y", "z"], key=key, ts=ts, tie=tie, chunk_us=chunk_us), "angle-0", scratch, figures, "zeros", filled=F.count_if("filled"))
    # loggers with whole-second stamps: without this, all but one row of a second would go
    spread = timeline.spread_repeats(filled, key=key, ts=ts, tie=tie, out="_us").withColumn(ts, from_micros(F.col("_us"))).drop("_us")
    rows = _stepped(spread, ["x", "y", "z"], key=key, ts=ts, tie=tie, chunk_us=chunk_us)
    rows = rows.select(*(c for c in rows.columns if c not in ("dX", "dY", "dZ")), *(F.when(~F.col("bad"), F.col(f"d{n}")).alias(f"d{n}") for n in AXES))
    size = magnitude(*(F.col(f"d{n}") for n in AXES))
    rows = rows.select("*", size.alias("angle"), (size / F.when(F.col("dt") > 0, F.col("dt"))).alias("gyro"))
    rows = _written(timeline.centred_mean(rows, ["x", "y"], key=key, ts=ts), "angle-1", scratch, figures, "times", kept=F.count("*"), gaps=F.count_if(F.col("dt") > 3))
    near = timeline.beside(rows, {"gyro": F.col("gyro")}, key=key, ts=ts, tie=tie, chunk_us=chunk_us, after=False)
    jerk = F.when(F.col("dt") <= 0.5, F.abs(F.col("gyro") - F.col("before_gyro")))
    rows = anomaly.activity_status(near.select(*rows.columns, jerk.alias("jerk")), "gyro", anomaly.speed_thresholds(rows, "gyro", key=by), key=by, series=key, ts=ts, tie=tie, chunk_us=chunk_us)
    clean = {c: F.when(F.col("status") != "Artifact", F.col(c)) for c in ("dX", "dY", "dZ", "angle", "gyro")}
    return _written(rows.withColumns(clean), "angle-2", scratch, figures, "activity", **_statuses())


def angle_seconds(samples: DataFrame, *, key: str = "source", ts: str = "ts", tie: str = "row_no", by: str | None = None) -> DataFrame:
    """The per-second table of angle recordings: 52 features besides ``key`` and ``second``; seconds without a valid sample go.

    The rate of a second is its number of valid samples, so frequencies are cycles per second of that many.
    """
    by = by or key
    t = anomaly.behaviour_thresholds(samples, key=by, effort="angle", roll="x_mean", speed="gyro", lying=(20.0, 60.0))
    a, valid = F.col("angle"), F.col("angle").isNotNull()
    marks = {"Rest": a <= F.col("low"), "Moderate": (a > F.col("low")) & (a <= F.col("high")), "Vigorous": a > F.col("high"), "Lying": F.abs("x_mean") > F.col("lying"), "active": F.col("gyro") > F.col("active")}
    rows = null_safe(samples, t, [by], "left").withColumn("second", bucket(ts, "1 second")).withColumns({f"is_{k}": F.when(valid, flag(c)) for k, c in marks.items()})
    energy = F.col("gyro") * F.col("gyro")
    aggs = [F.avg(a).alias("Angle_Mean"), F.coalesce(F.sum(a), F.lit(0.0)).alias("Angle_Sum"), F.max(a).alias("Angle_Max"), F.min(a).alias("Angle_Min"), F.stddev_samp(a).alias("Angle_Std"), F.avg("gyro").alias("Gyro_Mean"), F.max("gyro").alias("Gyro_Max"), F.avg(energy).alias("RotEnergy_1s_mean"), F.max(energy).alias("RotEnergy_1s_max"), F.coalesce(F.sum(energy * F.col("dt")), F.lit(0.0)).alias("RotEnergy_1s_sum"), F.count("x").alias("Data_Count"), F.count(a).alias("Valid_Sample_Count"), F.avg("jerk").alias("Jerk_Mean"), F.avg("is_active").alias("Active_Fraction")]
    for n in AXES:
        aggs += [F.stddev_samp(f"d{n}").alias(f"d{n}_Std"), F.avg(F.abs(f"d{n}")).alias(f"d{n}_Mean")]
    for c, n, other in (("x_mean", "Euler_X_lpf", "Roll"), ("y_mean", "Euler_Y_lpf", "Pitch")):
        for name in (n, other):
            aggs += [F.avg(c).alias(f"{name}_Mean"), F.stddev_samp(c).alias(f"{name}_Std")]
    aggs += [F.avg(f"is_{k}").alias(f"Frac_{k}") for k in marks if k != "active"]
    aggs += _moments(a, {"cv": "Coefficient_of_Variation", "skew": "Skewness", "kurt": "Kurtosis", "p25": "Angle_P25", "p75": "Angle_P75"})
    series = {"_z": "dZ", "_g": "gyro", "_a": "angle"}
    slots = rows.groupBy(key, "second").agg(*aggs, *(features.in_order(F.col(c), ts, tie).alias(f"{p}x") for p, c in series.items())).filter("Valid_Sample_Count > 0")
    shaped = features.with_shapes(slots, {"_z": ("_zx", None, ("waves", "turns")), "_g": ("_gx", None, ("waves", "turns")), "_a": ("_ax", None, ("turns",))})
    names = {"entropy": "Spectral_Entropy", "crossings": "Zero_Crossing_Rate", "frequency": "Dominant_Frequency", "peaks": "Peak_Count"}
    whole = lambda p, k: F.col(p + k).cast("long") if k == "peaks" else F.col(p + k)
    derived = {"Angle_Range": F.col("Angle_Max") - F.col("Angle_Min"), "Axis_Dominance": dominant_axis(*(F.col(f"d{n}_Std") for n in AXES)), "Autocorr_Lag1": F.col("_aautocorr")}
    # the names without a tag are those of the vertical axis
    derived |= {f"{v}{tag}": whole(p, k) for k, v in names.items() for p, tag in (("_z", "_dz"), ("_g", "_GMag"), ("_z", ""))}
    return shaped.withColumns(derived).drop(*(c for c in shaped.columns if c[:2] in series))


def daily_curves(seconds: DataFrame, *, key: str, activity: str, gyro: str) -> DataFrame:
    """Per minute the summed activity and the mean speed, on days with any activity: ready to plot."""
    minutes = seconds.groupBy(key, bucket("second", "1 minute").alias("minute")).agg(F.sum(activity).alias("activity"), F.avg(gyro).alias("gyro"))
    day = Window.partitionBy(key, F.to_date("minute"))
    return minutes.withColumn("_day", F.sum("activity").over(day)).filter("_day <> 0").drop("_day")
