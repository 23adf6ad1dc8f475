"""Heartbeats: resampling to a fixed rate, overlapping windows with committed labels, interval correction."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..scratch import materialize
from .scans import null_safe, running_sums
from .signals import clean_window, standardised, stationary
from .timeline import HOUR, beside, time_chunk

#: Mean interval in ms from which a band holds, and its lower and upper factors.
INTERVAL_BANDS = ((0, 0.55, 1.17), (375, 0.84, 1.11), (500, 0.79, 1.26), (800, 0.93, 1.15), (1000, 0.87, 1.31))

#: Windows (one a row) to the cleaned windows and to bits that mark their beats.
Scorer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def beat_intervals(beats: DataFrame, *, key: str, ts: str, tie: str, unit_us: float = 1000.0, chunk_us: int = HOUR) -> DataFrame:
    """``rr_ms`` to the beat before, ``reference_ms`` (mean of 200-3000 ms, by key) and ``abnormal`` by its band's factors; a millisecond lasts ``unit_us``."""
    near = beside(beats, {"us": micros(ts)}, key=key, ts=ts, tie=tie, chunk_us=chunk_us, after=False)
    step = (micros(ts) - F.col("before_us")) / F.lit(unit_us)
    return judge_intervals(near.select(*beats.columns, step.alias("rr_ms")), key=key)


def judge_intervals(rows: DataFrame, *, key: str) -> DataFrame:
    """``reference_ms`` and ``abnormal`` of rows that have ``rr_ms``."""
    mean = rows.filter("rr_ms between 200 and 3000").groupBy(key).agg(F.avg("rr_ms").alias("reference_ms"))
    low = high = None
    for start, a, b in INTERVAL_BANDS:
        low = F.lit(a) if low is None else F.when(F.col("reference_ms") >= start, a).otherwise(low)
        high = F.lit(b) if high is None else F.when(F.col("reference_ms") >= start, b).otherwise(high)
    joined = null_safe(rows, mean, [key], "left")
    off = (F.col("rr_ms") < low * F.col("reference_ms")) | (F.col("rr_ms") > high * F.col("reference_ms"))
    return joined.withColumn("abnormal", F.coalesce(off, F.lit(False)))


def _interpolated(points: DataFrame, at: DataFrame, by: list[str]) -> DataFrame:
    """``at`` (``by, t``) with the ``value`` of ``points`` (``by, t, x``) at t, straight between the two around it and level beyond the ends; 0 for fewer than two points."""
    none = F.lit(None).cast("double")
    known, asked = points.select(*by, "t", "x", F.lit(0).alias("_o")), at.select(*by, "t", none.alias("x"), F.lit(1).alias("_o"))
    # the rows ahead as those behind in the other direction: Spark goes through a frame that ends with its partition again for every row
    w, back = Window.partitionBy(*by).orderBy("t", "_o", "x"), Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("_o"), F.desc("x"))
    point = F.when(F.col("_o") == 0, F.struct("t", "x"))
    merged = known.unionByName(asked).select(
        *by, "t", "_o",
        F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"),
        F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"),
        F.count_if(F.col("_o") == 0).over(Window.partitionBy(*by)).alias("_n"),
    )
    b, a = F.col("_b"), F.col("_a")
    between = b["x"] + (F.col("t") - b["t"]) * (a["x"] - b["x"]) / F.nullif(a["t"] - b["t"], F.lit(0.0))
    value = F.when(F.col("_n") < 2, 0.0).when(b.isNull(), a["x"]).when(a.isNull() | (b["t"] == F.col("t")), b["x"]).otherwise(between)
    return merged.filter("_o = 1").select(*by, "t", value.alias("value"))


def _spread_between(points: DataFrame, by: list[str], rate: int) -> DataFrame:
    """``points`` (``by, t, x, i, m``: place from 0, and their number) and as many between them as ``rate`` lacks, the first intervals taking what is left over."""
    w = Window.partitionBy(*by).orderBy("i")
    spare, intervals = F.lit(rate) - F.col("m"), F.col("m") - 1
    extra = F.floor(spare / intervals) + (F.col("i") < spare % intervals).cast("long")
    ahead = points.select(*by, "t", "x", F.lead("t").over(w).alias("_t"), F.lead("x").over(w).alias("_x"), extra.alias("_e")).filter("_t is not null and _e > 0")
    part = F.col("_k") / (F.col("_e") + 1)
    new = ahead.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "_e")).alias("_k"))
    new = new.select(*by, F.round(F.col("t") + part * (F.col("_t") - F.col("t")), 3).alias("t"), (F.col("x") + part * (F.col("_x") - F.col("x"))).alias("value"))
    return points.select(*by, "t", F.col("x").alias("value")).unionByName(new)


def _with_ends(points: DataFrame, by: list[str]) -> DataFrame:
    """``points`` (``by, t, x``) with a point at 0 and one at 0.999 s, each a step further, where none lies within a millisecond; ``i`` and ``m`` number them."""
    w, whole = Window.partitionBy(*by).orderBy("t", "x"), Window.partitionBy(*by)
    near = points.select(*by, "t", "x", F.lag("x").over(w).alias("_b"), F.lead("x").over(w).alias("_a"), F.count("*").over(whole).alias("_n"))
    step = lambda c, when, t: F.when(when & (F.col("_n") > 1), F.struct(F.lit(t).alias("t"), (2 * F.col("x") - F.col(c)).alias("x")))
    first = step("_a", F.col("_b").isNull() & (F.col("t") >= 0.001), 0.0)
    last = step("_b", F.col("_a").isNull() & (F.lit(0.999) - F.col("t") >= 0.001), 0.999)
    listed = F.filter(F.array(first, F.struct("t", "x"), last), lambda x: x.isNotNull())
    wide = near.select(*by, F.inline(listed))
    return wide.select(*by, "t", "x", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(whole).alias("m"))


def resample_seconds(samples: DataFrame, *, key: str, ts: str, value: str, rate: int = 512, least: int = 460, keep_times: bool = False) -> DataFrame:
    """``key, us, value, resampled``: seconds of ``least`` samples or more, other than ``rate``, get exactly ``rate``.

    Values are interpolated on an even grid; with ``keep_times``, seconds of too few samples keep theirs, and the
    missing ones are spread between them.  Thinner seconds and exact ones pass through.  Joins and
    windows within a second do it all.
    """
    rows = samples.select(key, micros(ts).alias("us"), F.col(value).cast("double").alias("x")).na.drop(subset=["us", "x"]).withColumn("second", F.floor(F.col("us") / 1_000_000))
    by = [key, "second"]
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    passed = (F.col("n") < least) | (F.col("n") == rate)
    same = counted.filter(passed).select(key, "us", F.col("x").alias("value"), F.lit(False).alias("resampled"))
    points = counted.filter(~passed).select(*by, ((F.col("us") - F.col("second") * 1_000_000) / 1e6).alias("t"), "x", "n")
    kept = None
    if keep_times:
        wide = _with_ends(points.filter(F.col("n") <= rate), by)
        kept = _spread_between(wide.filter((F.col("m") < rate) & (F.col("m") > 1)), by, rate)
        points = points.filter(F.col("n") > rate).select(*by, "t", "x").unionByName(wide.filter((F.col("m") >= rate) | (F.col("m") < 2)).select(*by, "t", "x"))
    grid = points.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(rate - 1))).alias("_k")).select(*by, (F.col("_k") / rate).alias("t"))
    new = _interpolated(points, grid, by)
    new = new if kept is None else new.unionByName(kept)
    return same.unionByName(new.select(key, (F.col("second") * 1_000_000 + F.floor(F.col("t") * 1e6)).alias("us"), "value", F.lit(True).alias("resampled")))


def peak_scorer(x: np.ndarray, fs: float = 512.0, height: float = 0.5) -> np.ndarray:
    """Stand-in for a trained model: maxima of the squared slope over a share of the window's strongest, a quarter of a second apart."""
    energy = np.gradient(x) ** 2
    reach = int(fs / 8)
    bits = np.zeros(len(x), np.int8)
    top = np.sort(energy)[-max(1, len(x) // 500)]
    for i in np.flatnonzero(energy >= height * top):
        a, b = max(0, i - reach), i + reach + 1
        if energy[i] == energy[a:b].max() and not bits[a:i].any():
            bits[max(0, i - 10) + int(np.argmax(x[max(0, i - 10) : i + 11] ** 2))] = 1
    return bits


def peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stand-in as a scorer: windows as they are, and their beats."""
    return x, np.stack([peak_scorer(w) for w in x])


@lru_cache(8)
def _session(path: str):
    """A model, loaded once by each worker, on the fastest device there is."""
    import onnxruntime

    there = onnxruntime.get_available_providers()
    fast = next((p for p in ("CUDAExecutionProvider", "DmlExecutionProvider", "CoreMLExecutionProvider") if p in there), None)
    return onnxruntime.InferenceSession(path, providers=[*([fast] if fast else []), "CPUExecutionProvider"])


def _coarse_and_fine(x: np.ndarray) -> np.ndarray:
    """Of each window its coarse approximation and finest detail, standardised: (windows, 2, samples)."""
    return np.stack([np.stack([standardised(levels[0][0]), standardised(levels[-1][1])]) for levels in map(stationary, x)])


def model_chain(cleaner: str, plain: str, second: str, *, size: int = 15360, load: Callable[[str], object] = _session) -> Scorer:
    """Three models as a scorer; a sample is a beat if any of the three passes one half.

    ``cleaner`` and ``plain`` take the window with its coarse and fine parts (three channels).  The cleaner gives a
    cleaned window and a logit, which ``second`` takes as four channels: the cleaned window, its coarse and fine
    parts, and that logit.  Tensors of any other shape are refused.
    """

    def ask(path: str, x: np.ndarray, channels: int) -> list[np.ndarray]:
        if x.ndim != 3 or x.shape[1:] != (channels, size):
            raise ValueError(f"{path}: expected (windows, {channels}, {size}), got {x.shape}")
        model = load(path)
        return model.run([o.name for o in model.get_outputs()], {model.get_inputs()[0].name: x.astype(np.float32)})

    def score(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        wide = np.concatenate([x[:, None], _coarse_and_fine(x)], axis=1)
        clean, logit = ask(cleaner, wide, 3)
        first = ask(plain, wide, 3)[0]
        clean = clean.reshape(n, -1)
        third = ask(second, np.concatenate([clean[:, None], _coarse_and_fine(clean), logit.reshape(n, 1, -1)], axis=1), 4)[0]
        beats = [1 / (1 + np.exp(-y.reshape(n, -1).astype(float))) > 0.5 for y in (logit, first, third)]
        return clean, np.any(beats, axis=0).astype(np.int8)

    return score


@dataclass
class IntervalCorrector:
    """Repairs beats of one window: surplus beats go, missing ones are inserted, all snap to the local maximum."""

    fs: float = 512.0
    notes: list[str] = field(default_factory=list)

    def reference(self, rr: np.ndarray) -> float:
        """Typical interval in ms: mean of a tight centre, else the median of plausible intervals."""
        if not len(rr):
            return 600.0
        sane = rr[(rr >= 200) & (rr <= 3000)]
        sane = sane if len(sane) >= 2 else rr
        if len(sane) < 3:
            return float(sane.mean())
        mid = np.median(sane)
        near = sane[(sane >= 0.5 * mid) & (sane <= 2 * mid)]
        near = near if len(near) >= 2 else sane
        points = [np.percentile(near, 40), np.median(near), np.percentile(near, 60)]
        return float(np.mean(points) if max(points) - min(points) < 100 else points[1])

    @staticmethod
    def factors(mean_ms: float) -> tuple[float, float]:
        return next((a, b) for start, a, b in reversed(INTERVAL_BANDS) if mean_ms >= start or start == 0)

    @staticmethod
    def _strength(x: np.ndarray, i: int, reach: int) -> float:
        return float(np.abs(x[max(0, i - reach) : i + reach + 1]).max())

    @staticmethod
    def _snap(x: np.ndarray, i: int, reach: int = 20) -> int:
        a = max(0, i - reach)
        return a + int(np.argmax(x[a : i + reach + 1] ** 2))

    def _fill(self, x: np.ndarray, a: int, b: int, ref: float, usual: float) -> list[int]:
        """Beats to insert between two, and between those in turn."""
        gap = (b - a) / self.fs * 1000
        if gap <= 1.3 * ref:
            return []
        edge = int(0.15 * self.fs)
        wanted = max(int(gap / ref) - 1, 1 if gap > 1.5 * ref else 0)
        places = [int(a + (b - a) / (wanted + 1) * k) for k in range(1, wanted + 1)]
        snapped = {self._snap(x, p) for p in places if a + edge < p < b - edge}  # the margin holds before the snap
        new = sorted(p for p in snapped if a < p < b and self._strength(x, p, 10) >= 0.4 * usual)
        if not new:
            return []
        stops = [a, *new, b]
        return sorted({*new, *(p for s, t in zip(stops, stops[1:]) for p in self._fill(x, s, t, ref, usual))})

    def correct(self, x: np.ndarray, bits: np.ndarray) -> np.ndarray:
        beats = np.flatnonzero(bits).tolist()
        if len(beats) < 3:
            self.notes.append("too few peaks")
            return bits.copy()
        ref = self.reference(np.diff(beats) / self.fs * 1000)
        low = self.factors(ref)[0] * ref
        k = len(beats) - 1
        while k > 0:
            if (beats[k] - beats[k - 1]) / self.fs * 1000 < low:
                pair = [self._strength(x, beats[j], 5) for j in (k - 1, k)]
                if min(pair) < 0.6 * max(pair):
                    del beats[k - 1 + int(np.argmin(pair))]
            k = min(k, len(beats)) - 1
        if len(beats) > 1:
            ref = self.reference(np.diff(beats) / self.fs * 1000)
            usual = float(np.median([self._strength(x, b, 5) for b in beats]))
            beats = sorted({*beats, *(p for a, b in zip(beats, beats[1:]) for p in self._fill(x, a, b, ref, usual))})
        out = np.zeros_like(bits)
        for b in beats:
            p = self._snap(x, b)
            out[p if not out[p] else b] = 1
        return out


def close_runs(x: np.ndarray, bits: np.ndarray, near: int = 50) -> np.ndarray:
    """Marks under ``near`` samples apart are one beat, at the run's strongest sample."""
    at = np.flatnonzero(bits)
    out = np.zeros_like(bits)
    if len(at):
        for run in np.split(at, np.flatnonzero(np.diff(at) >= near) + 1):
            a, b = int(run[0]), int(run[-1])
            out[a + int(np.argmax(x[a : b + 1] ** 2))] = 1
    return out


def windows(samples: DataFrame, *, key: str, ts: str, value: str, size: int, hop: int, chunk_us: int = HOUR) -> DataFrame:
    """``key, window, start, last, us, x``: overlapping windows of ``size`` samples every ``hop``, the last one flush with the end.

    Recordings under one window have none.  A sample goes to each window that holds it.
    """
    rows = samples.select(key, ts, micros(ts).alias("us"), F.col(value).cast("double").alias("x")).na.drop(subset=["us", "x"])
    placed = running_sums(rows, {"pos": F.lit(1).cast("long")}, key=[key], chunk=time_chunk(ts, chunk_us), by=[F.col(ts), F.col("x")])
    total = null_safe(placed, rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= size), [key], "inner")
    pos, last = F.col("pos") - 1, F.ceil((F.col("n") - size) / hop)
    low, high = F.greatest(F.ceil((pos - size + 1) / hop), F.lit(0)), F.least(F.floor(pos / hop), last - 1)
    regular = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(pos >= F.col("n") - size, F.array(last)).otherwise(F.array().cast("array<bigint>"))
    each = total.select(key, "us", "x", "pos", "n", last.alias("last"), F.explode(F.concat(regular, tail)).alias("window"))
    held = each.groupBy(key, "window").agg(F.max("n").alias("n"), F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("pos", "us", "x"))).alias("_s"))
    start = F.when(F.col("window") == F.col("last"), F.col("n") - size).otherwise(F.col("window") * hop)
    return held.select(key, "window", start.alias("start"), "last", F.col("_s.us").alias("us"), F.col("_s.x").alias("x"))


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scored_windows(cut: DataFrame, scorer: Scorer, *, key: str, clean: bool, fs: float) -> DataFrame:
    """``cut`` with the cleaned window and the places of its beats, window by window."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                x = _rows_of(part.column("x"))
                smooth, bits = scorer(np.stack([clean_window(w, fs) for w in x]) if clean else x)
                beats = [np.flatnonzero(close_runs(w, b)) for w, b in zip(smooth, bits)]
                yield pa.record_batch([*part.columns, pa.array(list(np.asarray(smooth, float)), pa.list_(pa.float64())), pa.array(beats, pa.list_(pa.int64()))], [*part.schema.names, "clean", "beats"])

    return cut.mapInArrow(run, f"{schema}, clean array<double>, beats array<bigint>")


def _same_key(a: str, b: str, key: str) -> Column:
    return F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}")) & (F.col(f"{a}.window") == F.col(f"{b}.window"))


def commit_labels(scored: DataFrame, *, key: str, size: int, hop: int, settled: int, correct: bool, fs: float) -> DataFrame:
    """``key, window, beats``: the places in the recording at which each window commits a beat.

    A window takes over, in its first ``settled`` samples, what the windows before it have committed; the first
    and the last commit all of theirs, others their final ``hop`` samples.  That is a chain, but a short one:
    all windows are computed side by side from what the last round has committed, and again those whose input
    changed, until nothing does.  By induction from the first window this ends at the labels of the chain.
    """
    kind = scored.schema[key].dataType.simpleString()
    own = scored.select(key, "window", "start", "last", "x", "beats")
    reach = -(-size // hop)
    edge = lambda: F.when((F.col("window") == 0) | (F.col("window") == F.col("last")), 0).otherwise(size - hop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, columns = [], [batch.column(c).to_pylist() for c in ("window", "start", "last", "beats", "before")]
            for x, window, start, last, beats, before in zip(_rows_of(batch.column("x")), *columns):
                bits = np.zeros(size, np.int8)
                bits[beats] = 1
                if window:
                    bits[:settled] = 0
                    bits[[p - start for p in before or [] if 0 <= p - start < settled]] = 1
                if correct:
                    bits = IntervalCorrector(fs).correct(x, bits)
                keep = 0 if window in (0, last) else size - hop
                out.append(start + keep + np.flatnonzero(bits[keep:]))
            yield pa.record_batch([batch.column(key), batch.column("window"), pa.array(out, pa.list_(pa.int64()))], [key, "window", "beats"])

    first = F.transform(F.filter("beats", lambda p: p >= edge()), lambda p: p + F.col("start"))
    now = materialize(own.select(key, "window", first.alias("beats"), F.lit(True).alias("changed")), "beats-committed")
    heirs = F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_k")
    every = True
    while every or now.filter("changed").take(1):
        given = now.select(key, "window", "beats", "changed", heirs).select(key, (F.col("window") + F.col("_k")).alias("window"), "beats", "changed")
        given = given.groupBy(key, "window").agg(F.array_sort(F.flatten(F.collect_list("beats"))).alias("before"), F.bool_or("changed").alias("again"))  # of so many windows at most
        joined = own.alias("o").join(given.alias("g"), _same_key("o", "g", key), "left").select("o.*", "g.before", "g.again")
        todo = joined if every else joined.filter("again")
        done = todo.mapInArrow(run, f"`{key}` {kind}, window bigint, beats array<bigint>")
        new = F.coalesce("d.beats", "n.beats")
        now = materialize(now.alias("n").join(done.alias("d"), _same_key("n", "d", key), "left").select(f"n.{key}", "n.window", new.alias("beats"), (new != F.col("n.beats")).alias("changed")), "beats-committed")
        every = False
    return now.select(key, "window", "beats")


def label_beats(samples: DataFrame, *, key: str, ts: str, value: str, scorer: Scorer = peaks, clean: bool = True, correct: bool = True, fs: float = 512.0, size: int = 15360, hop: int = 5120, settled: int | None = None) -> DataFrame:
    """``key, us, value, clean, label`` of every sample; no task holds more of a recording than a few windows.

    ``clean`` of a sample is that of the last window that holds it.  Recordings under one window are left
    unlabelled, with ``clean`` null.  Rows without time or value go; samples of one time are ordered by value.
    """
    settled = size * 13 // 30 if settled is None else settled
    cut = windows(samples, key=key, ts=ts, value=value, size=size, hop=hop)
    scored = materialize(scored_windows(cut, scorer, key=key, clean=clean, fs=fs), "beats-scored")
    committed = commit_labels(scored, key=key, size=size, hop=hop, settled=settled, correct=correct, fs=fs)
    # each sample once: a window up to where the next one begins
    tail = F.max(F.when(F.col("window") == F.col("last"), F.col("start"))).alias("tail")
    ends = scored.groupBy(key).agg(tail, F.max("last").alias("last"))
    upto = F.when(F.col("window") == F.col("last"), F.lit(size)).otherwise(F.least((F.col("window") + 1) * hop, F.col("tail")) - F.col("start"))
    shown = null_safe(scored, ends.select(key, "tail"), [key], "inner").select(key, "start", F.posexplode(F.slice(F.arrays_zip("us", "x", "clean"), F.lit(1), upto.cast("int"))).alias("_i", "_s"))
    each = shown.select(key, (F.col("start") + F.col("_i")).alias("pos"), F.col("_s.us").alias("us"), F.col("_s.x").alias("value"), F.col("_s.clean").alias("clean"))
    # what the last window commits replaces what others have there
    marks = null_safe(committed, ends, [key], "inner").select(key, "window", "last", "tail", F.explode("beats").alias("pos"))
    marks = marks.filter((F.col("window") == F.col("last")) | (F.col("pos") < F.col("tail"))).select(key, "pos", F.lit(1).alias("label"))
    labelled = null_safe(each, marks, [key, "pos"], "left").select(key, "us", "value", "clean", F.coalesce("label", F.lit(0)).alias("label"))
    rows = samples.select(key, micros(ts).alias("us"), F.col(value).cast("double").alias("value")).na.drop(subset=["us", "value"])
    short = null_safe(rows, rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") < size), [key], "inner").select(key, "us", "value", F.lit(None).cast("double").alias("clean"), F.lit(0).alias("label"))
    return labelled.unionByName(short)
