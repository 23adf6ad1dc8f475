"""Filters of recordings: Butterworth, zero-phase filtering in blocks, wavelets.

A linear recurrence is computed block by block with matrices (the block's answer to its samples, and to the
state it begins with), so there is no loop per sample, and blocks of one recording are filtered in
parallel once a scan over their end states has given their start states.  No filter library is here to compare
with; the tests hold these to a plain recurrence and to their defining properties.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from ..scratch import materialize
from .scans import null_safe, running_sums
from .timeline import HOUR, time_chunk


@lru_cache(16)
def daubechies(vanishing: int) -> np.ndarray:
    """Low-pass filter of an orthogonal wavelet with so many vanishing moments, by spectral factorisation."""
    y = np.roots([comb(vanishing - 1 + k, k) for k in range(vanishing - 1, -1, -1)]) if vanishing > 1 else np.array([])
    roots = []
    for r in y:  # y = (2 - z - 1/z) / 4
        pair = np.roots([1, 4 * r - 2, 1])
        roots.append(pair[np.argmin(np.abs(pair))])
    h = np.real(np.poly(np.concatenate([-np.ones(vanishing), roots])))
    return h * np.sqrt(2) / h.sum()


@lru_cache(64)
def butterworth(low: float, high: float, fs: float, order: int, stop: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digital band-pass (or band-stop) coefficients b, a by the bilinear transform with pre-warped edges."""
    warp = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    scaled = (width / poles if stop else width * poles) / 2
    root = np.sqrt(scaled**2 - centre**2 + 0j)
    analog = np.concatenate([scaled + root, scaled - root])
    digital = (2 * fs + analog) / (2 * fs - analog)
    if stop:
        angle = 2 * np.arctan(centre / (2 * fs))
        zeros = np.tile([np.exp(1j * angle), np.exp(-1j * angle)], order)
        at = 1.0 + 0j
    else:
        zeros = np.concatenate([np.ones(order), -np.ones(order)])
        at = np.exp(2j * np.arctan(centre / (2 * fs)))
    b, a = np.real(np.poly(zeros)), np.real(np.poly(digital))
    return b * np.abs(np.polyval(a, at) / np.polyval(b, at)), a


class Recurrence:
    """The filter b, a as a sum of its modes: w <- p w + x for every pole p, and y = d x + the real part of sum r w.

    Modes decay apart from each other, so a run of samples needs powers of poles alone, which never grow.  A run
    of ``step`` samples is a product of matrices: y = H x + O w.  Repeated poles are refused.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray, step: int = 256):
        n = max(len(a), len(b))
        b, a = (np.pad(np.asarray(c, np.longdouble), (0, n - len(c))) / a[0] for c in (b, a))
        slope = np.polyder(a)
        poles = np.roots(a.astype(float)).astype(np.clongdouble)
        for _ in range(8):  # to more digits than a state has
            poles = poles - np.polyval(a, poles) / np.polyval(slope, poles)
        if np.abs(np.polyval(slope, poles)).min() < 1e-14 or np.abs(poles).max() >= 1:
            raise ValueError("the filter is unstable or has repeated poles")
        weights = np.polyval(b, poles) / np.polyval(slope, poles)
        times = np.arange(step)
        grown = poles[:, None] ** times
        self.order, self.step, self.poles = n - 1, step, poles.astype(complex)
        self.reach = grown[:, ::-1].astype(complex)  # of a run's samples into the modes at its end
        self.seen = (weights[:, None] * grown).T.astype(complex)
        impulse = np.concatenate([b[:1], (weights @ grown).real[: step - 1]]).astype(float)
        at = times[:, None] - times
        self.direct = np.where(at >= 0, impulse[np.maximum(at, 0)], 0.0)
        self.settled = (1 / (1 - poles)).astype(complex)  # the modes under a constant 1

    def power(self, n: int) -> np.ndarray:
        return self.poles**n

    def end(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The modes after ``x``."""
        whole, jump = len(x) // self.step, self.power(self.step)
        for r in x[: whole * self.step].reshape(whole, self.step) @ self.reach.T:
            state = jump * state + r
        rest = x[whole * self.step :]
        return self.power(len(rest)) * state + self.reach[:, self.step - len(rest) :] @ rest if len(rest) else state

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        whole, jump = -(-len(x) // self.step), self.power(self.step)
        parts = np.zeros(whole * self.step)
        parts[: len(x)] = x
        parts = parts.reshape(whole, self.step)
        states = np.empty((whole, self.order), complex)
        for k, r in enumerate(parts @ self.reach.T):
            states[k] = state
            state = jump * state + r
        return (parts @ self.direct.T + (states @ self.seen.T).real).reshape(-1)[: len(x)]


def _kept(state: np.ndarray) -> np.ndarray:
    """Modes as twice as many doubles."""
    return np.ascontiguousarray(state, complex).view(float)


def _again(kept) -> np.ndarray:
    return np.asarray(kept, float).view(complex)


@lru_cache(16)
def _recurrence(b: tuple[float, ...], a: tuple[float, ...]) -> Recurrence:
    return Recurrence(np.array(b), np.array(a))


def recurrence(b: np.ndarray, a: np.ndarray) -> Recurrence:
    return _recurrence(tuple(map(float, b)), tuple(map(float, a)))


def padding(b: np.ndarray, a: np.ndarray, n: int) -> int:
    """Samples of odd extension at either end."""
    return max(0, min(3 * max(len(a), len(b)), n - 1))


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One piece filtered forwards and backwards, with odd extension and settled initial states."""
    x = np.asarray(x, float)
    pad = padding(b, a, len(x))
    if pad < 1:
        return x.copy()
    f = recurrence(b, a)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    ahead = f.run(wide, f.settled * wide[0])
    return f.run(ahead[::-1], f.settled * ahead[-1])[::-1][pad : pad + len(x)]


def _start_states(ends: DataFrame, f: Recurrence, key: str, kind: str, group: int) -> DataFrame:
    """``key, block, state``: the state in which each block begins, from every block's length and end state.

    Two levels: groups of ``group`` blocks are summed up into one each, these are followed in order,
    and then the blocks within a group; so no task holds more than ``group`` blocks' states, or one row per group.
    """
    def follow(rows: pd.DataFrame, state: np.ndarray) -> list[np.ndarray]:
        """The state before each row and after the last."""
        out = [state]
        for length, end in zip(rows["n"], rows["end"]):
            out.append(f.power(int(length)) * out[-1] + _again(end))
        return out

    def summed(group_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return pd.DataFrame({key: [group_key[0]], "part": [group_key[1]], "n": [int(rows["n"].sum())], "end": [_kept(follow(rows, np.zeros(f.order, complex))[-1])]})

    def tops(group_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({key: group_key[0], "part": rows["part"], "state": list(map(_kept, follow(rows, np.zeros(f.order, complex))[:-1]))})

    def within(group_key: tuple, rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return pd.DataFrame({key: group_key[0], "block": rows["block"], "state": list(map(_kept, follow(rows, _again(top["state"].iloc[0]))[:-1]))})

    ends = ends.withColumn("part", F.floor(F.col("block") / group))
    parts = ends.groupBy(key, "part").applyInPandas(summed, f"`{key}` {kind}, part long, n long, end array<double>")
    begun = parts.groupBy(key).applyInPandas(tops, f"`{key}` {kind}, part long, state array<double>")
    return ends.groupBy(key, "part").cogroup(begun.groupBy(key, "part")).applyInPandas(within, f"`{key}` {kind}, block long, state array<double>")


def _one_way(blocks: DataFrame, b: np.ndarray, a: np.ndarray, key: str, back: bool, group: int) -> DataFrame:
    """``blocks`` (``key, block, x``) filtered in order, or backwards from the last block; ``block`` counts from 0 that way."""
    f, kind = recurrence(b, a), blocks.schema[key].dataType.simpleString()
    way = -1 if back else 1

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x in batch.column("x"):
            yield x.values.to_numpy(zero_copy_only=False)[::way]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, out = batch.column("block").to_pylist(), []
            for k, x in zip(numbers, values(batch)):
                out.append(_kept(f.end(x, f.settled * x[0] if k == 0 else np.zeros(f.order, complex))))
            yield pa.record_batch([batch.column(key), batch.column("block"), pa.array([len(x) for x in batch.column("x")], pa.int64()), pa.array(out, pa.list_(pa.float64()))], [key, "block", "n", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, x, state in zip(batch.column("block").to_pylist(), values(batch), batch.column("state").to_pylist()):
                out.append(f.run(x, f.settled * x[0] if k == 0 else _again(state))[::way])
            yield pa.record_batch([batch.column(key), batch.column("block"), pa.array(out, pa.list_(pa.float64()))], [key, "block", "y"])

    states = blocks.select(key, "block", "x").mapInArrow(ends, f"`{key}` {kind}, block long, n long, end array<double>")
    starts = _start_states(states, f, key, kind, group)
    joined = null_safe(blocks.select(key, "block", "x"), starts, [key, "block"], "inner")
    return joined.mapInArrow(run, f"`{key}` {kind}, block long, y array<double>")


def signal_blocks(samples: DataFrame, *, key: str, ts: str, value: str, size: int, chunk_us: int = HOUR) -> DataFrame:
    """``key, block, last, us, x``: a recording's samples in order of time, in arrays of ``size`` values, twice that in the last one at most."""
    rows = samples.select(key, ts, micros(ts).alias("us"), F.col(value).cast("double").alias("x")).na.drop(subset=["us", "x"])
    placed = running_sums(rows, {"pos": F.lit(1).cast("long")}, key=[key], chunk=time_chunk(ts, chunk_us), by=[F.col(ts), F.col("x")])
    sized = null_safe(placed, rows.groupBy(key).agg(F.count("*").alias("total")), [key], "left")
    last = F.greatest(F.floor(F.col("total") / size) - 1, F.lit(0))
    cut = sized.select(key, "us", "x", "pos", last.alias("_last"), F.least(F.floor((F.col("pos") - 1) / size), last).alias("block"))
    blocks = cut.groupBy(key, "block").agg(F.max("_last").alias("last"), F.sort_array(F.collect_list(F.struct("pos", "us", "x"))).alias("_s"))
    return blocks.select(key, "block", "last", F.col("_s.us").alias("us"), F.col("_s.x").alias("x"))


def zero_phase_series(samples: DataFrame, b: np.ndarray, a: np.ndarray, *, key: str, ts: str, value: str, size: int = 1 << 16, group: int = 1024) -> DataFrame:
    """``key, us, value, filtered``: ``zero_phase`` over recordings of any length, in blocks of ``size`` samples.

    Rows without time or value take no part; samples of one time are ordered by value.  A recording of one
    sample is left as it is.
    """
    size = max(size, 4 * (3 * max(len(a), len(b)) + 1))
    blocks = materialize(signal_blocks(samples, key=key, ts=ts, value=value, size=size), "filter-blocks")
    pad = F.least(F.lit(3 * max(len(a), len(b))), F.size("x") - 1)
    first, final = F.col("block") == 0, F.col("block") == F.col("last")
    mirrored = lambda at, towards: F.transform(F.sequence(F.lit(1), F.col("_pad")), lambda k: 2 * F.get("x", at) - F.get("x", towards(k)))
    ahead = F.reverse(mirrored(F.lit(0), lambda k: k))
    after = mirrored(F.size("x") - 1, lambda k: F.size("x") - 1 - k)
    none = F.array().cast("array<double>")
    filtered = blocks.withColumn("_pad", pad).filter("_pad >= 1")
    wide = filtered.select(key, "block", "last", F.concat(F.when(first, ahead).otherwise(none), "x", F.when(final, after).otherwise(none)).alias("x"))
    forward = materialize(null_safe(_one_way(wide, b, a, key, False, group).withColumnRenamed("y", "x"), blocks.select(key, "block", "last"), [key, "block"], "inner"), "filter-forward")
    turned = forward.select(key, (F.col("last") - F.col("block")).alias("block"), "last", "x")
    back = null_safe(_one_way(turned, b, a, key, True, group), blocks.select(key, (F.col("last") - F.col("block")).alias("block"), "last", "us", F.col("x").alias("value"), pad.alias("_pad")), [key, "block"], "inner")
    start = F.when(F.col("block") == F.col("last"), F.col("_pad") + 1).otherwise(1)  # the first block of the recording
    trimmed = back.select(key, F.inline(F.arrays_zip("us", "value", F.slice("y", start, F.size("us")).alias("filtered"))))
    alone = blocks.filter(F.size("x") == 1).select(key, F.inline(F.arrays_zip("us", F.col("x").alias("value"), F.col("x").alias("filtered"))))
    return trimmed.toDF(key, "us", "value", "filtered").unionByName(alone.toDF(key, "us", "value", "filtered"))


def _pair(vanishing: int) -> tuple[np.ndarray, np.ndarray]:
    low = daubechies(vanishing)
    return low, low[::-1] * (-1) ** np.arange(len(low))


def analyse(x: np.ndarray, vanishing: int = 4, levels: int = 4) -> list[np.ndarray]:
    """Wavelet transform with half-sample symmetric ends: the approximation, then details from coarse to fine.

    A level of n values gives (n + filter - 1) // 2 of each kind.
    """
    filters = _pair(vanishing)
    out, now = [], np.asarray(x, float)
    for _ in range(levels):
        wide = np.pad(now, len(filters[0]) - 1, mode="symmetric")
        # the filters run backwards in time, which a correlation with them does
        now, detail = (np.convolve(wide, f[::-1], "valid")[1::2] for f in filters)
        out.append(detail)
    return [now, *out[::-1]]


def synthesise(parts: list[np.ndarray], vanishing: int = 4) -> np.ndarray:
    """Inverse of ``analyse``; a signal of odd length comes back with one value more."""
    filters = _pair(vanishing)
    reach, now = len(filters[0]), parts[0]
    for detail in parts[1:]:
        now = now[: len(detail)]
        wide = np.zeros((2, 2 * len(detail) - 1))
        wide[:, ::2] = now, detail
        both = sum(np.convolve(w, f) for w, f in zip(wide, filters))
        now = both[reach - 2 : len(both) - reach + 2]
    return now


def wavelet_denoise(x: np.ndarray, method: str = "hard", threshold: float | None = None, factor: float = 0.6745) -> np.ndarray:
    """Details under the level's threshold (``median |d| * factor`` unless given) go (hard) or shrink (soft)."""
    if method not in ("hard", "soft"):
        raise ValueError(f"unknown method {method}")
    parts = analyse(x)
    for k, d in enumerate(parts[1:], 1):
        t = np.median(np.abs(d)) * factor if threshold is None else threshold
        parts[k] = np.where(np.abs(d) >= t, d, 0.0) if method == "hard" else np.sign(d) * np.maximum(np.abs(d) - t, 0)
    return synthesise(parts)[: len(x)]


def stationary(x: np.ndarray, vanishing: int = 4, levels: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Undecimated transform: (approximation, detail) of every level, coarsest first."""
    low, high = _pair(vanishing)
    out, now = [], np.asarray(x, float)
    for level in range(levels):
        at = (np.arange(len(now))[:, None] + (np.arange(len(low)) - len(low) // 2) * 2**level) % len(now)
        out.append((now[at] @ low, now[at] @ high))
        now = out[-1][0]
    return out[::-1]


def standardised(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    return x - x.mean() if sd < 1e-6 else (x - x.mean()) / sd


def channels(x: np.ndarray) -> np.ndarray:
    """The signal with its coarse approximation and finest detail, standardised."""
    levels = stationary(x)
    return np.stack([x, standardised(levels[0][0]), standardised(levels[-1][1])]).astype(np.float32)


def second_difference(x: np.ndarray, limit: float = 20.0) -> np.ndarray:
    """Of the clipped signal, as long as the signal (edges repeat)."""
    d = np.diff(np.clip(x, -limit, limit), 2)
    return np.pad(d, (1, 1), mode="edge") if len(d) else np.zeros(len(x))


def clean_ecg(x: np.ndarray, fs: float = 512.0) -> np.ndarray:
    """Band-pass 3-70 Hz, band-stop 48-52 Hz, wavelet denoising."""
    x = zero_phase(*butterworth(3.0, 70.0, fs, 4), x)
    return wavelet_denoise(zero_phase(*butterworth(48.0, 52.0, fs, 2, True), x))


def clean_window(x: np.ndarray, fs: float = 512.0) -> np.ndarray:
    """What a window goes through before it is scored: clipped second difference, wavelet denoising, ``clean_ecg``."""
    return clean_ecg(wavelet_denoise(second_difference(x)), fs)
