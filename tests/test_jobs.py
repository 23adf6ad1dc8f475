"""Whole jobs: outputs of one run, figures counted on the way, the report, cached signals, folders."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import times
from tideline.operators.beats import IntervalCorrector
from tideline.operators.figures import Figures
from tideline.plans import jobs, movement, outputs, report, tasks
from tideline.scratch import shared_dir
from tideline.sources import text_logs

DAY = dt.datetime(2025, 1, 2, 10)
IMU = "source string, row_no long, ts timestamp_ntz, x double, y double, z double, jx double, jy double, jz double"


def imu_rows(n=600):
    """Ten rows a second, a gap of ten seconds, a repeated time, free fall, incomplete rows, and two speeds that stand out."""
    rows = []
    for i in range(n):
        t = DAY + dt.timedelta(milliseconds=100 * i + (10_000 if i >= 300 else 0))
        still = 50 <= i < 60
        turn = 170.0 if i in (120, 121, 400) else 0.0
        rows.append(("s", i, t, 0.0 if still else math.sin(i), 0.0 if still else math.cos(i), 0.1 if still else 1.0, float(i % 7) * 0.01 + turn, 1.0, 2.0))
    rows.append(("s", n, DAY, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0))
    rows += [("s", n + 1, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("s", n + 2, DAY, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return rows


def test_imu_job_writes_all_from_one_read(spark, tmp_path):
    df = spark.createDataFrame(imu_rows(), IMU)
    run = jobs.imu_job(df, str(tmp_path))
    samples, seconds = (outputs.published(spark, str(tmp_path), n) for n in ("samples", "seconds"))
    assert samples.count() == 600 and seconds.count() == 60 and len(seconds.columns) == 61
    table = lambda n: outputs.published(spark, str(tmp_path), f"report_{n}", run).collect()
    got = {(r.step, r.figure): r.value for r in table("cleaning")}
    samples.createOrReplaceTempView("samples")
    one = lambda q: spark.sql(f"select count(*) from samples where {q}").first()[0]
    assert got == {
        ("read", "rows"): 603, ("read", "incomplete"): 2, ("times", "kept"): 600, ("times", "gaps"): 1,
        ("activity", "real"): one("status = 'Real_Activity'"), ("activity", "artifact"): one("status = 'Artifact'"),
        ("effort", "artifacts_removed"): one("status = 'Artifact'"), ("effort", "free_fall_removed"): 10,
        ("effort", "noise_removed"): one("status <> 'Artifact' and strength >= 0.2 and vedba < noise_floor"), ("effort", "impacts_capped"): one("status <> 'Artifact' and strength >= 0.2 and vedba > impact_ceiling"),
    }
    assert [(r.gap_start, r.gap_end, r.gap_s) for r in table("gaps")] == [(DAY + dt.timedelta(seconds=29.9), DAY + dt.timedelta(seconds=40), 10.1)]
    assert {r.status: r.slots for r in table("sampling")} == {"missing": 10, "normal": 60}
    shown = table("examples")
    assert {r.number for r in shown} <= {1, 2, 3} and all(r.status in ("Real_Activity", "Artifact") for r in shown)
    assert [r.suspicious >= 300 for r in table("thresholds")] == [True]


def test_observed_rows_are_read_once(spark):
    figures = Figures()
    frame = spark.createDataFrame(imu_rows(), IMU)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    movement.imu_samples(frame.mapInArrow(count, frame.schema), figures=figures)
    assert seen.value == 603 and figures.collected()["read"] == {"rows": 603, "incomplete": 2}


def test_a_failed_run_stays_unseen(spark, tmp_path):
    good = spark.range(3).toDF("v")
    first = outputs.publish({"a": good, "b": good}, str(tmp_path))
    bad = good.withColumn("v", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        outputs.publish({"a": good.union(good), "b": bad}, str(tmp_path))
    assert outputs.published(spark, str(tmp_path), "a").count() == 3
    outputs.publish({"a": good.union(good), "b": good}, str(tmp_path))
    assert outputs.published(spark, str(tmp_path), "a").count() == 6 and outputs.published(spark, str(tmp_path), "a", first).count() == 3


def test_angle_and_beats_jobs(spark, tmp_path):
    angle = spark.createDataFrame([r[:6] for r in imu_rows()], ", ".join(IMU.split(", ")[:6]))
    jobs.angle_job(angle, f"{tmp_path}/angle")
    assert outputs.published(spark, f"{tmp_path}/angle", "seconds").count() == 60 and outputs.published(spark, f"{tmp_path}/angle", "samples").count() > 500
    t = np.arange(3000)
    x = np.exp(-((t % 400 - 200) ** 2) / 18.0)
    rows = spark.createDataFrame([("a", DAY + dt.timedelta(microseconds=int(i * 1e6 / 512)), float(v)) for i, v in zip(t, x)], "source string, ts timestamp_ntz, adc double")
    for cleaned in (False, True):
        folder = f"{tmp_path}/beats{cleaned}"
        jobs.beats_job(rows, folder, cleaned=cleaned, size=1200, hop=400, clean=False, correct=False)
        labels = outputs.published(spark, folder, "labels").collect()
        assert len(labels) in (7, 8) and set(labels[0].asDict()) == {"source", "timestamp", "label"}
        signal = outputs.published(spark, folder, "signal")
        assert signal.filter("label = 1").count() == len(labels)
        if cleaned:
            assert outputs.published(spark, folder, "cleaned").count() == signal.count()
        else:
            with pytest.raises(Exception):
                outputs.published(spark, folder, "cleaned")


def test_abnormal_minutes_by_hand(spark):
    """A whole hour of seconds of one row, then a minute with one second of twenty rows, then a quiet one."""
    rows = [("s", DAY + dt.timedelta(seconds=s)) for s in range(3600)] + [("s", DAY + dt.timedelta(seconds=3600 + s // 10)) for s in range(1200)] + [("s", DAY + dt.timedelta(seconds=3605))] * 10
    got = report.abnormal_minutes(report.sampling(spark.createDataFrame(rows, "source string, ts timestamp_ntz"), key="source", ts="ts"), key="source").collect()
    assert sorted((r.start - DAY, r.whole_hour, r.missing, r.too_low, r.too_high) for r in got) == [(dt.timedelta(0), True, 0, 3600, 0), (dt.timedelta(hours=1), False, 0, 0, 1)]


def test_markdown_says_what_it_leaves_out(spark):
    text = report.markdown("R", {"few": spark.range(3), "many": spark.range(7), "none": spark.range(0)}, rows=3)
    assert text.count("more rows") == 1 and "4 more rows in the table" in text and "nothing to report" in text


def test_cached_signals_of_three_headers(spark, tmp_path):
    files = {"a_cache.csv": "timestamp,data\n2025-01-02 10:00:00.001,1.5\n", "Bcache.csv": "ADC,timestamp,x\n2,2025-01-02 10:00:01.000,9\n,2025-01-02 10:00:02.000,9\n", "sub/Ccache.csv": "timestamp,signal,data2\n2025-01-02 10:00:03,3,7\nnever,4,7\n", "other.csv": "timestamp,data\n2025-01-02 10:00:00,5\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = sorted((r.source, r.ts is not None, r.data or 0.0) for r in text_logs.read_cache(spark, str(tmp_path)).collect())
    assert got == [("B", True, 0.0), ("B", True, 2.0), ("C", False, 4.0), ("C", True, 3.0), ("a_", True, 1.5)]
    (tmp_path / "Dcache.csv").write_text("time,data\n1,2\n")
    with pytest.raises(Exception, match="Dcache.csv"):
        text_logs.read_cache(spark, str(tmp_path)).collect()


def test_roots_of_folders(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    assert text_logs.listed(spark, str(tmp_path / "none"))[1] == "missing" and text_logs.listed(spark, str(tmp_path / "file"))[1] == "not_a_folder"
    assert text_logs.listed(spark, str(tmp_path))[1] == "empty"
    (tmp_path / "20250102_a").mkdir()
    (tmp_path / "20250102_a" / "f1").write_text("x")
    files, wrong = text_logs.listed(spark, str(tmp_path))
    assert wrong == "" and ("20250102_a", "f1") in {(r.folder, r.file_name) for r in files.collect()}


def test_readings_are_scaled(spark, tmp_path):
    (tmp_path / "Raw_2025-01-02.txt").write_text("10:00:00.1 32767\n10:00:00.2 -16384\n")
    assert [round(r.data, 3) for r in text_logs.read_ecg(spark, str(tmp_path)).orderBy("ts").collect()] == [100.0, -50.002]


def test_wall_times(spark):
    texts = ["2025-01-02 10:00:00.5", "2025-01-02T10:00:00+02:00", "2025-01-02 10:00:00Z", "never"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", times.wall_time(F.col("t"), "Asia/Shanghai").alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [dt.datetime(2025, 1, 2, 10, 0, 0, 500_000), dt.datetime(2025, 1, 2, 16), dt.datetime(2025, 1, 2, 18), None]


@pytest.mark.parametrize("text,algorithm,batch", [(None, "original_timestamps", 2), ("{", "original_timestamps", 2), ("[1]", "original_timestamps", 2), ('{"origin_resample": false, "batch_size": 5}', "uniform_grid", 5), ('{"interpolation_algorithm": "other"}', "original_timestamps", 2), ('{"origin_resample": false, "interpolation_algorithm": "original_timestamps"}', "original_timestamps", 2)])
def test_settings(text, algorithm, batch):
    got = tasks.settings(text)
    assert got["interpolation_algorithm"] == algorithm and got["batch_size"] == batch and got["correct"] is True


def test_tasks(spark, tmp_path):
    root = tmp_path / "in" / "20250102_A1"
    root.mkdir(parents=True)
    clock = lambda i, hz: f"10:{i // hz // 60:02d}:{i // hz % 60:02d}.{i % hz * 1000 // hz:03d}"
    (root / "B1_IMU_2025-01-02.csv").write_text("h\n" + "".join(f"{clock(i, 10)},{i % 3},{i % 5},1,{i % 7},2,3\n" for i in range(200)))
    (root / "Angle_2025-01-02.txt").write_text("".join(f"{clock(i, 10)} {i % 7} {i % 5} 1 0\n" for i in range(200)))
    (root / "Raw_2025-01-02.txt").write_text("".join(f"{clock(i, 500)} {1000 * (i % 400 == 200)}\n" for i in range(2500)))
    task = lambda kind, **more: tasks.run_task(spark, {"task_type": kind, "source_dir": str(tmp_path / "in"), "save_path": f"{tmp_path}/{kind}", "output_dir": f"{tmp_path}/{kind}", "selected_files": [str(root)], "language": "en"} | more, **({"size": 1200, "hop": 400, "clean": False} if kind == "convert" else {}))
    for kind in ("move_old", "move_new", "folder_inspect", "convert", "cache_only"):
        task(kind, config={"origin_resample": False, "correct": False})
    count = lambda kind, name: outputs.published(spark, f"{tmp_path}/{kind}", name).count()
    assert count("move_old", "seconds") == 20 and count("move_new", "seconds") == 20 and count("folder_inspect", "messages") > 0
    assert count("convert", "signal") == 5 * 512 and count("convert", "labels") > 2 and count("cache_only", "cache") == 5 * 512
    task("folder_inspect", source_dir=str(tmp_path / "none"))
    assert outputs.published(spark, f"{tmp_path}/folder_inspect", "messages").first().finding == "root_missing"
    with pytest.raises(ValueError):
        task("other")


def test_scratch_on_one_machine_is_refused_on_a_cluster():
    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    session = lambda **c: type("Session", (), {"conf": Conf({k.replace("_", "."): v for k, v in c.items()})})
    where = {"spark_sql_warehouse_dir": "file:/tmp/w"}
    assert shared_dir(session(spark_master="local[2]", **where)) == "file:/tmp/w/scratch"
    with pytest.raises(ValueError):
        shared_dir(session(spark_master="yarn", **where))
    assert shared_dir(session(spark_master="yarn", spark_checkpoint_dir="hdfs:/c/", **where)) == "hdfs:/c"


class TestCorrector:
    """Rules of the interval corrector, by hand at 100 samples a second."""

    c = IntervalCorrector(100.0)

    def test_reference_is_the_mean_of_a_tight_centre(self):
        assert self.c.reference(np.array([])) == 600.0
        assert self.c.reference(np.array([500.0, 700.0])) == 600.0  # fewer than three: their mean
        assert self.c.reference(np.array([10.0, 800.0, 800.0, 800.0, 5000.0])) == 800.0  # implausible ones go
        assert self.c.reference(np.array([400.0, 500.0, 600.0, 1200.0])) == pytest.approx(500.0)  # over twice the middle goes

    def test_wide_centres_take_the_median(self):
        rr = np.array([400.0, 410.0, 700.0, 710.0])
        p40, p50, p60 = np.percentile(rr, [40, 50, 60])
        assert p60 - p40 >= 100 and self.c.reference(rr) == p50

    @pytest.mark.parametrize("mean,bounds", [(100.0, (0.55, 1.17)), (374.9, (0.55, 1.17)), (375.0, (0.84, 1.11)), (500.0, (0.79, 1.26)), (800.0, (0.93, 1.15)), (1000.0, (0.87, 1.31))])
    def test_bands(self, mean, bounds):
        assert IntervalCorrector.factors(mean) == bounds

    def beats(self, at, n=1200, strong=1.0):
        x, bits = np.full(n, 0.01), np.zeros(n, np.int8)
        for p in at:
            x[p] = strong
        bits[list(at)] = 1
        return x, bits

    def test_the_weaker_of_two_close_beats_goes(self):
        x, bits = self.beats(range(100, 1100, 80))
        x[200], bits[200] = 0.5, 1  # 20 samples after a beat, under six tenths of it
        assert 200 not in np.flatnonzero(self.c.correct(x, bits))

    def test_two_close_beats_alike_stay(self):
        x, bits = self.beats(range(100, 1100, 80))
        x[210], bits[210] = 0.9, 1
        assert 210 in np.flatnonzero(self.c.correct(x, bits)).tolist()

    def test_a_missing_beat_is_put_at_the_maximum(self):
        x, bits = self.beats(range(100, 1100, 80))
        x[340], x[347], bits[340] = 0.01, 1.0, 0
        assert 347 in np.flatnonzero(self.c.correct(x, bits))

    def test_a_weak_place_stays_empty(self):
        x, bits = self.beats(range(100, 1100, 80))
        x[340], bits[340] = 0.3, 0  # under four tenths of the usual strength
        assert len(np.flatnonzero(self.c.correct(x, bits))) == 12

    def test_beats_snap_to_the_square(self):
        x, bits = self.beats(range(100, 1100, 80))
        x[260], x[265] = 0.01, -1.0
        assert 265 in np.flatnonzero(self.c.correct(x, bits))
