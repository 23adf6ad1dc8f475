import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import times, vectors
from tideline.operators import quality, timeline
from tideline.plans import movement
from tideline.plans.report import markdown
from tideline.sources import text_logs
from tideline.streaming.live import live_rates, live_sessions

DAY = dt.datetime(2025, 1, 2)


@pytest.mark.parametrize("text,us", [("01:02:03", 3723_000_000), ("0:0:1.5", 1_005_000), ("0:0:1.123456", 124_456_000), ("x", None), ("1:2", None), ("1:2:z", None)])
def test_clock(spark, text, us):
    assert spark.createDataFrame([(text,)], "t string").select(times.clock_micros(F.col("t"))).first()[0] == us


def test_micros_round_trip(spark):
    df = spark.sql("select timestamp_ntz'2024-02-29 23:59:59.123456' as ts union all select timestamp_ntz'1969-12-31 23:00:00.5'")
    assert df.filter(times.from_micros(times.micros("ts")) != F.col("ts")).count() == 0


def test_wrapped_and_axis(spark):
    df = spark.createDataFrame([(190.0,), (-190.0,), (180.0,), (None,)], "d double")
    assert [r[0] for r in df.select(vectors.wrapped(F.col("d"))).collect()] == [-170.0, 170.0, 180.0, None]
    axes = spark.createDataFrame([(1.0, 2.0, 2.0), (None, 5.0, 9.0), (None, None, None), (3.0, 1.0, 3.0)], "a double, b double, c double")
    assert [r[0] for r in axes.select(vectors.dominant_axis(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1, 0, 0, 0]


@pytest.mark.parametrize("n,status", [(0, "missing"), (4, "too_low"), (5, "normal"), (15, "normal"), (16, "too_high")])
def test_status_bounds(spark, n, status):
    assert spark.range(1).select(quality.rate_status(F.lit(n))).first()[0] == status


def test_zero_runs(spark):
    rows = [("a", DAY + dt.timedelta(seconds=i), i, float(v), float(v)) for i, v in enumerate([0, 0, 0, 4, 0, 0, 6, 0, 0, 0])]
    out = timeline.fill_joint_zeros(spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int, x double, y double"), ["x", "y"], key="k", ts="ts", tie="i").orderBy("i").collect()
    assert [r.x for r in out] == [0, 0, 2, 4, 0, 0, 6, 3, 0, 0] and sum(r.filled for r in out) == 6


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_readers(spark, tmp_path):
    write(tmp_path / "a/Angle_2025-01-02.txt", "23:59:58.10 1 2 3 9\n23:59:59.20 1 2 3 9\n00:00:01.5 4 5 6 9\nbad 1 2 3 9\n00:00:02 x 5 6 9\n")
    write(tmp_path / "a/B1_IMU_2025-01-02.csv", "time,x,y,z,a,b,c\n10:00:00.1,1,2,3,4,5,6\n10:00:00.2,1,2,3,4,5,6\n")
    write(tmp_path / "a/Raw_2025-1-2-x.txt", "10:00:00.1 5\n09:59:59 6\n\n")
    write(tmp_path / "a/Device2_BMD101Data_2025-01-02.txt", "t,v\n10:00:00.1,7,1\n")
    angles = text_logs.read_angles(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r.ts, r.x) for r in angles] == [(DAY + dt.timedelta(hours=23, minutes=59, seconds=58, milliseconds=10), 1), (DAY + dt.timedelta(hours=23, minutes=59, seconds=59, milliseconds=20), 1), (DAY + dt.timedelta(days=1, seconds=1, milliseconds=5), 4)]
    assert [r.jz for r in text_logs.read_imu(spark, str(tmp_path)).collect()] == [6, 6]
    assert sorted((r.ts.day, r.adc) for r in text_logs.read_ecg(spark, str(tmp_path)).collect()) == [(2, 5), (2, 7), (3, 6)]
    write(tmp_path / "b/Raw_BMD_2025-01-02.txt", "t,v\n10:00:00.1,8\n")
    assert [r.adc for r in text_logs.read_ecg(spark, str(tmp_path / "b")).collect()] == [8]
    write(tmp_path / "c/Angle_undated.txt", "10:00:00 1 2 3 9\n")
    with pytest.raises(Exception, match="Angle_undated"):
        text_logs.read_angles(spark, str(tmp_path / "c")).collect()
    write(tmp_path / "l/Raw_a.csv", "timestamp,label\n2025-01-02 10:00:00.5,1\n2025-01-02 10:00:01,0\n")
    write(tmp_path / "l/BMD_b.csv", "b'2025-01-02 10:00:02',2\nnever,2\n")
    beats = text_logs.read_labels(spark, str(tmp_path / "l"))
    assert sorted((r.source, r.label) for r in beats.collect()) == [("BMD_b", 2), ("Raw_a", 1)]
    assert {r.file_name for r in text_logs.file_listing(spark, str(tmp_path / "l")).collect()} == {"Raw_a.csv", "BMD_b.csv"}
    text_logs.write_series(beats, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert "| source |" in markdown("R", {"beats": beats.select("source")})


def imu(n=400):
    import math

    return [("s", i, DAY + dt.timedelta(milliseconds=100 * i), math.sin(i) * (1 + i // 50 % 4), math.cos(i), 1.0, float(i % 360 - 180), 5.0, -5.0) for i in range(n)]


def test_second_tables(spark, tmp_path):
    df = spark.createDataFrame(imu(), "source string, row_no long, ts timestamp_ntz, x double, y double, z double, jx double, jy double, jz double")
    samples = movement.imu_samples(df, scratch=str(tmp_path))
    out = movement.imu_seconds(samples)
    assert len(out.columns) == 61 and len(set(out.columns)) == 61
    got = out.orderBy("second").collect()
    assert len(got) == 40 and all(r.Data_Count == 10 for r in got) and all(abs(r.Frac_Rest + r.Frac_Moderate + r.Frac_Vigorous - 1) < 1e-9 for r in got)
    angle = movement.angle_seconds(movement.angle_samples(df.select("source", "row_no", "ts", "x", "y", "z")))
    assert len(angle.columns) == 54 and angle.count() == 40
    assert movement.daily_curves(out, key="source", activity="Acc_Sum", gyro="Gyro_Mean").count() == 1


def test_live_rates(spark, tmp_path):
    rows = [("a", DAY + dt.timedelta(seconds=s, milliseconds=100 * i)) for s, n in ((0, 3), (1, 10), (60, 1)) for i in range(n)]
    spark.createDataFrame(rows, "k string, ts timestamp_ntz").write.parquet(f"{tmp_path}/in")
    for name, make in (("rates", live_rates), ("sessions", lambda s: live_sessions(s, key="k"))):
        stream = spark.readStream.schema("k string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.n, r.status) for r in spark.table("rates").collect()} == {(3, "too_low"), (10, "normal")}
    assert [r.n for r in spark.table("sessions").collect()] == [13]


def test_dense_counts_in_chunks(spark):
    rows = spark.createDataFrame([("a", DAY + dt.timedelta(minutes=m)) for m in (0, 7, 7)] + [("b", DAY)], "k string, ts timestamp_ntz")
    got = timeline.dense_counts(rows, ts="ts", width="1 minute", key="k", chunk=3).orderBy("k", "slot").collect()
    assert [(r.k, (r.slot - DAY).seconds // 60, r.n) for r in got] == [*(("a", m, {0: 1, 7: 2}.get(m, 0)) for m in range(8)), ("b", 0, 1)]


def test_folder_messages(spark):
    files = [("20250102_x", "A1 2025-01-02.txt"), ("20250102_x", "A1 20250102 b.txt"), ("20250103", "A1 2025-01-04.txt"), ("20250103", "B2.txt"), ("misc", "A1 2025-01-04.txt")]
    got = quality.folder_messages(spark.createDataFrame(files, "folder string, file_name string")).collect()
    assert sorted((r.folder, r.finding, r.file_name, r.detail) for r in got) == [
        ("20250102_x", "ok", "", "2"),
        ("20250103", "date_mismatch", "A1 2025-01-04.txt", "20250104"),
        ("20250103", "several_ids", "", "A1,B2"),
        ("misc", "bad_name", "", ""),
        ("misc", "few_files", "", "1"),
    ]
