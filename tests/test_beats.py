"""Heartbeats in windows against a plain loop over one recording, resampling against numpy, and the chain of models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators.beats import IntervalCorrector, beat_intervals, close_runs, label_beats, model_chain, peak_scorer, peaks, resample_seconds
from tideline.operators.signals import clean_window

DAY = dt.datetime(2025, 1, 2)
FS, SIZE, HOP = 160.0, 480, 160


def plain_labels(x, *, settled, clean, correct):
    """The chain of windows in one loop: the rule that the rounds in Spark must end at."""
    n = len(x)
    labels, cleaned = np.zeros(n, int), np.full(n, np.nan)
    starts = [*range(0, n - SIZE, HOP), n - SIZE] if n >= SIZE else []
    for k, a in enumerate(starts):
        part = x[a : a + SIZE]
        smooth = clean_window(part, FS) if clean else part
        bits = close_runs(smooth, peak_scorer(smooth))
        if k:
            bits[:settled] = labels[a : a + settled]
        if correct:
            bits = IntervalCorrector(FS).correct(part, bits)
        keep = 0 if k in (0, len(starts) - 1) else SIZE - HOP
        labels[a + keep : a + SIZE] = bits[keep:]
        cleaned[a : a + SIZE] = smooth
    return labels, cleaned


def beating(n, seed):
    rng = np.random.default_rng(seed)
    x, at = 0.05 * rng.normal(size=n), 30
    while at < n - 3:
        x[at - 2 : at + 3] += [0.3, 0.7, 1.0, 0.7, 0.3]
        at += int(rng.choice([90, 100, 110, 45, 210]))
    return x


@pytest.mark.parametrize("clean,correct", [(True, True), (False, True), (False, False)])
def test_labels_equal_the_chain(spark, clean, correct):
    """Long, odd, exactly one window, one sample short, a null key; nulls go."""
    series = {"a": beating(3333, 1), "b": beating(SIZE, 2), "c": beating(SIZE - 1, 3), None: beating(1000, 4), "e": beating(2 * SIZE, 5)}
    rows = [(k, DAY + dt.timedelta(microseconds=6250 * i), float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("a", None, 1.0), ("a", DAY, None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").repartition(5)
    out = label_beats(df, key="k", ts="ts", value="v", clean=clean, correct=correct, fs=FS, size=SIZE, hop=HOP, settled=208).orderBy("k", "us").collect()
    for k, x in series.items():
        own = [r for r in out if r.k == k]
        labels, cleaned = plain_labels(x, settled=208, clean=clean, correct=correct)
        assert [r.value for r in own] == x.tolist() and [r.label for r in own] == labels.tolist()
        assert np.allclose([np.nan if r.clean is None else r.clean for r in own], cleaned, atol=1e-9, equal_nan=True)
    assert sum(r.label for r in out) > 20


def plain_second(t, x, rate, keep):
    grid = np.arange(rate) / rate
    if keep and len(t) <= rate and len(t) > 1:
        if t[0] >= 0.001:
            t, x = np.append(0.0, t), np.append(x[0] - (x[1] - x[0]), x)
        if 0.999 - t[-1] >= 0.001:
            t, x = np.append(t, 0.999), np.append(x, x[-1] + (x[-1] - x[-2]))
        if len(t) < rate:
            each, more = divmod(rate - len(t), len(t) - 1)
            points = [(t[-1], x[-1])]
            for j in range(len(t) - 1):
                k = each + (j < more)
                points += [(t[j], x[j])] + [(round(t[j] + (t[j + 1] - t[j]) * i / (k + 1), 3), x[j] + (x[j + 1] - x[j]) * i / (k + 1)) for i in range(1, k + 1)]
            return sorted(points)
    return list(zip(grid, np.interp(grid, t, x)))


@pytest.mark.parametrize("keep", [False, True])
def test_resampled_seconds(spark, keep):
    rng = np.random.default_rng(7)
    rows, want = [], []
    for s, n in enumerate([48, 64, 70, 12, 63, 62, 50]):
        us = np.sort(rng.choice(1_000_000, n, replace=False))
        if s == 6:
            us[[0, -1]] = 0, 999_500
        x = rng.normal(size=n)
        rows += [("a", DAY + dt.timedelta(seconds=s, microseconds=int(u)), float(v)) for u, v in zip(us, x)]
        found = list(zip(us / 1e6, x)) if n in (64, 12) else plain_second(us / 1e6, x, 64, keep)
        want += [(s, t, v) for t, v in found]
    out = resample_seconds(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), key="k", ts="ts", value="v", rate=64, least=45, keep_times=keep)
    base = int((DAY - dt.datetime(1970, 1, 1)).total_seconds())
    got = sorted((r.us // 1_000_000 - base, r.us % 1_000_000 / 1e6, r.value) for r in out.collect())
    assert len(got) == len(want)
    assert np.allclose(np.array(got), np.array(sorted(want)), atol=2e-6)


def test_intervals(spark):
    rows = [(k, i, DAY + dt.timedelta(milliseconds=ms)) for k, at in (("a", [0, 800, 1600, 2400, 2700]), ("b", [0])) for i, ms in enumerate(at)]
    out = {(r.k, r.i): (r.rr_ms, r.reference_ms, r.abnormal) for r in beat_intervals(spark.createDataFrame(rows, "k string, i int, ts timestamp_ntz"), key="k", ts="ts", tie="i", chunk_us=1_000_000).collect()}
    assert out == {("a", 0): (None, 675.0, False), ("a", 1): (800.0, 675.0, False), ("a", 2): (800.0, 675.0, False), ("a", 3): (800.0, 675.0, False), ("a", 4): (300.0, 675.0, True), ("b", 0): (None, None, False)}


class Model:
    """A session with one input and named outputs, computed by a function."""

    def __init__(self, f, outputs):
        self.f, self.outputs, self.seen = f, outputs, []

    def get_inputs(self):
        return [type("Input", (), {"name": "x"})]

    def get_outputs(self):
        return [type("Output", (), {"name": n}) for n in self.outputs]

    def run(self, names, feed):
        assert names == self.outputs and feed["x"].dtype == np.float32
        self.seen.append(feed["x"])
        return self.f(feed["x"])


def test_chain_of_models():
    n, x = 64, np.random.default_rng(0).normal(size=(3, 64))
    mark = lambda at: np.where(np.arange(n) == at, 5.0, -5.0)[None, None]
    models = {
        "gan": Model(lambda t: [2 * t[:, :1], np.repeat(mark(10), len(t), 0)], ["clean", "logit"]),
        "base": Model(lambda t: [np.repeat(mark(20), len(t), 0)], ["out"]),
        "ganbase": Model(lambda t: [np.where(t[:, 3:] > 0, -5.0, mark(30))], ["out"]),
    }
    clean, bits = model_chain("gan", "base", "ganbase", size=n, load=models.get)(x)
    assert np.allclose(clean, 2 * x, atol=1e-5) and [np.flatnonzero(b).tolist() for b in bits] == [[10, 20, 30]] * 3
    wide = models["ganbase"].seen[0]
    assert wide.shape == (3, 4, n) and np.allclose(wide[:, 0], clean) and np.allclose(wide[:, 3], mark(10)[0])
    assert models["gan"].seen[0].shape == (3, 3, n) and np.allclose(models["gan"].seen[0][:, 1].std(1), 1, atol=1e-3)
    with pytest.raises(ValueError, match="expected"):
        model_chain("gan", "base", "ganbase", size=65, load=models.get)(x)
    models["gan"].f = lambda t: [t[:, :1, :-1], t[:, :1]]
    with pytest.raises(ValueError):
        model_chain("gan", "base", "ganbase", size=n, load=models.get)(x)


def test_stand_in_scores_windows():
    x = np.stack([beating(480, s) for s in range(3)])
    same, bits = peaks(x)
    assert same is x and bits.shape == x.shape and (bits.sum(1) > 1).all()


def test_resampling_takes_no_frame_that_ends_with_its_partition(spark):
    """Spark goes through such a frame again for every row: a second of n rows took n * n steps."""
    rows = spark.range(3000).select(F.lit("a").alias("k"), F.timestamp_micros(F.col("id") * 300).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("v"))
    out = resample_seconds(rows, key="k", ts="ts", value="v", rate=64, least=40)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")
    got = {r.us: r.value for r in out.collect()}
    assert len(got) == 64 and abs(got[500_000] - 500_000 / 300) < 1e-6 and got[984_375] == 2999
