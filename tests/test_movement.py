"""Golden rows of the angle job, worked out by hand, and chunk borders of the series operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import anomaly, features, timeline
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.scans import framed, framed_sums, neighbours, running_sums
from tideline.plans import movement

NOON = dt.datetime(2025, 1, 2, 12)
ANGLES = "source string, row_no long, ts timestamp_ntz, x double, y double, z double"


def seconds(spark, rows):
    frame = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], ANGLES)
    return {r.second: r for r in movement.angle_seconds(movement.angle_samples(frame)).collect()}


def test_whole_second_stamps_keep_all_rows(spark):
    """10 rows per whole second, z going up a degree a row: each second has ten rows a tenth apart."""
    got = seconds(spark, [(NOON + dt.timedelta(seconds=s), 5.0, 5.0, float(10 * s + i)) for s in range(6) for i in range(10)])
    assert len(got) == 6
    assert [got[NOON + dt.timedelta(seconds=s)].Data_Count for s in range(6)] == [10] * 6
    assert [got[NOON + dt.timedelta(seconds=s)].Valid_Sample_Count for s in range(6)] == [9] + [10] * 5
    second = got[NOON + dt.timedelta(seconds=3)]
    assert second.Angle_Mean == 1.0 and second.Gyro_Mean == pytest.approx(10.0) and second.dZ_Mean == 1.0
    assert second.RotEnergy_1s_sum == pytest.approx(10 * 100 * 0.1)


def test_night_medians_move_nothing(spark):
    """Around 50 degrees at 23 h the roll is around 50; the median is a figure beside it."""
    night = NOON.replace(hour=23)
    rows = [(night + dt.timedelta(milliseconds=100 * i), 50.0 + i % 2, 1.0, 2.0) for i in range(40)]
    got = seconds(spark, rows)
    assert all(abs(r.Roll_Mean - 50.5) < 0.5 for r in got.values())
    frame = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)] + [("t", 0, NOON, 1.0, 1.0, 1.0)], ANGLES)
    zero = {r.source: (r.zero_x, r.zero_y, r.n_samples) for r in movement.posture_zero(frame, key="source", ts="ts", axes=["x", "y"]).collect()}
    assert zero == {"s": (50.5, 1.0, 40), "t": (None, None, 0)}


def test_rate_is_the_number_of_valid_samples(spark):
    """20 rows a second, two cycles of the step of z in each: 2 a second, by the vertical axis and without a tag."""
    z, rows = 0.0, []
    for s in range(4):
        for i in range(20):
            z += 3 * math.cos(2 * math.pi * 2 * i / 20)
            rows.append((NOON + dt.timedelta(seconds=s, milliseconds=50 * i), 1.0, 1.0, z))
    got = seconds(spark, rows)[NOON + dt.timedelta(seconds=2)]
    assert got.Dominant_Frequency_dz == 2.0 and got.Dominant_Frequency == 2.0
    assert got.Dominant_Frequency_GMag == 4.0  # the magnitude has twice the cycles
    assert (got.Spectral_Entropy, got.Zero_Crossing_Rate, got.Peak_Count) == (got.Spectral_Entropy_dz, got.Zero_Crossing_Rate_dz, got.Peak_Count_dz)
    assert got.Zero_Crossing_Rate_dz != got.Zero_Crossing_Rate_GMag


def test_a_second_of_one_sample_has_no_autocorrelation(spark):
    got = seconds(spark, [(NOON + dt.timedelta(seconds=s), 1.0, 1.0, float(s)) for s in range(4)])
    assert [r.Autocorr_Lag1 for r in got.values()] == [0.0] * 3


def test_dominant_axis_is_that_of_the_angles(spark):
    """The vertical angle varies most, the first acceleration does too."""
    rows = [("s", i, NOON + dt.timedelta(milliseconds=100 * i), float(i % 3), 0.0, 1.0, 1.0, 1.0, float((7 * i) % 20)) for i in range(40)]
    frame = spark.createDataFrame(rows, "source string, row_no long, ts timestamp_ntz, x double, y double, z double, jx double, jy double, jz double")
    assert {r.Axis_Dominance for r in movement.imu_seconds(movement.imu_samples(frame)).collect()} == {2}


def series(spark, n=400):
    rng = np.random.default_rng(4)
    rows = [(k, NOON + dt.timedelta(seconds=int(t)), i, float(rng.integers(0, 3))) for k in ("a", None) for i, t in enumerate(np.sort(rng.integers(0, 3000, n)))]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long, v double").cache()


@pytest.mark.parametrize("chunk_s", [1, 7, 500])
def test_chunks_change_nothing(spark, chunk_s):
    df, at = series(spark), {"key": "k", "ts": "ts", "tie": "i"}
    one, many = {"chunk_us": 10**15}, {"chunk_us": chunk_s * 1_000_000}
    same = lambda f: sorted(map(str, f(one).collect())) == sorted(map(str, f(many).collect()))
    assert same(lambda c: timeline.with_dt(df, **at, **c))
    assert same(lambda c: timeline.gaps(df, **at, longer_than=20, **c))
    assert same(lambda c: timeline.runs(df, F.col("v") == 0, **at, **c))
    assert same(lambda c: timeline.fill_joint_zeros(df, ["v"], **at, least=2, **c))
    holes = df.withColumn("v", F.when(F.col("v") > 1, F.col("v")))
    assert same(lambda c: timeline.filled(holes, ["v"], **at, **c))
    assert same(lambda c: timeline.centred_mean(df, ["v"], key="k", ts="ts", half_us=9_000_000, **c))
    thresholds = df.select("k").distinct().withColumns({"active_base": F.lit(0.5), "suspicious": F.lit(1.5)})
    assert same(lambda c: anomaly.activity_status(df, "v", thresholds, key="k", series="k", ts="ts", tie="i", ratio=1.5, **c))


def test_long_series_is_spread_over_tasks(spark):
    """One recording alone: no window's partition holds all of it."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), "id")
    chunk = F.floor(F.col("id") / 500)
    out = neighbours(running_sums(df, {"n": F.lit(1)}, key=["k"], chunk=chunk, by=[F.col("id")]), {"id": F.col("id")}, key=["k"], chunk=chunk, by=["id"])
    assert out.filter("n = id + 1 and before_id <=> case when id > 0 then id - 1 end and after_id <=> case when id < 19999 then id + 1 end").count() == 20_000
    held = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert held < 15_000
    near = framed(df, [F.sum("id")], key=["k"], at=F.col("id"), back=2, ahead=1, width=4)
    assert near.filter("id between 2 and 19998 and _f0 <> 4 * id - 2").count() == 0 and near.count() == 20_000


@pytest.mark.parametrize("few", [30, 100_000])
def test_exact_quantiles(spark, few):
    """Two keys hold nearly all rows; a third of them are one value; nulls and empty columns."""
    rng = np.random.default_rng(0)
    n = 6000
    key = rng.choice(np.array(["a", "b", None], object), n, p=[0.7, 0.29, 0.01])
    x = np.where(rng.random(n) < 0.3, 5.0, rng.lognormal(0, 4, n))
    y = [None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 4, n)]
    df = spark.createDataFrame([(k, float(a), b) for k, a, b in zip(key, x, y)], "k string, x double, y double")
    shares = (0.0, 0.001, 0.33, 0.5, 0.999, 1.0)
    wanted = {f"x{j}": (F.col("x"), p) for j, p in enumerate(shares)} | {"y": (F.col("y"), 0.9), "none": (F.when(F.col("x") < 0, F.col("x")), 0.5)}
    got = {r.k: r for r in exact_quantiles(df, wanted, keys=["k"], few=few).collect()}
    assert set(got) == {"a", "b", None}
    for k, r in got.items():
        own = [a for a, o in zip(x, key) if o == k]
        assert [r[f"x{j}"] for j in range(len(shares))] == pytest.approx([np.quantile(own, p) for p in shares], rel=1e-12)
        assert r.y == pytest.approx(np.quantile([b for b, o in zip(y, key) if o == k and b is not None], 0.9)) and r.none is None


def test_sample_entropy_by_cells(spark):
    rng = np.random.default_rng(2)
    parts = {"a": rng.normal(size=120), "b": np.round(rng.normal(size=90)), "c": np.ones(30), "d": rng.normal(size=3)}
    df = spark.createDataFrame([(k, NOON + dt.timedelta(seconds=i), i, float(v)) for k, x in parts.items() for i, v in enumerate(x)] + [("a", NOON, 500, None)], "k string, ts timestamp_ntz, i int, v double")
    got = {r.k: r.sample_entropy for r in features.sample_entropy_of_any_size(df, "v", slot=["k"], ts="ts", tie="i", chunk_us=25_000_000).collect()}
    assert got == pytest.approx({k: features.sample_entropy(x[None])[0] for k, x in parts.items()})


def test_thousands_of_rows_at_one_time(spark):
    """Rank times a million passes 32 bits from the 2148th row on."""
    df = spark.range(3000).select(F.lit("a").alias("k"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), "id")
    got = timeline.spread_repeats(df, key="k", ts="ts", tie="id").agg(F.max("spread_us") - F.min("spread_us"), F.countDistinct("spread_us")).first()
    assert tuple(got) == (999_666, 3000)


def test_framed_sums_make_no_pass_per_row(spark):
    """Every row's own frame, as plain sums, by running sums alone; null keys and times, ties and NaN included."""
    rng = np.random.default_rng(1)
    rows = [(None if i % 7 == 0 else "ab"[i % 2], None if i % 50 == 0 else int(t), float("nan") if i == 33 else None if i % 11 == 0 else float(v)) for i, (t, v) in enumerate(zip(rng.integers(-60, 200, 300), rng.integers(0, 9, 300)))]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    out = framed_sums(df, {"s": F.sum("v"), "n": F.count("*")}, key=["k"], at=F.col("t"), back=4, ahead=5)
    assert "rangeframe, -" not in out._jdf.queryExecution().toString().lower()
    want = []
    for k, t, v in rows:
        own = [x for a, b, x in rows if a == k and (b is None if t is None else b is not None and t - 4 <= b <= t + 5)]
        held = [x for x in own if x is not None]
        want.append((k, t, v, sum(held) if held else None, len(own)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_centred_mean_slides_no_frame_over_rows(spark):
    df = series(spark)
    plan = timeline.centred_mean(df, ["v"], key="k", ts="ts")._jdf.queryExecution().toString().lower()
    assert "rangeframe, -" not in plan
