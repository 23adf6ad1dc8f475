import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.operators.beats import IntervalCorrector, close_runs
from tideline.operators.features import sample_entropy, spectrum, turns
from tideline.operators.signals import analyse, butterworth, daubechies, recurrence, second_difference, synthesise, wavelet_denoise, zero_phase, zero_phase_series


def gain(b, a, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


def test_butterworth_edges():
    b, a = butterworth(3.0, 70.0, 512.0, 4)
    assert np.allclose([gain(b, a, f, 512) for f in (3, 70)], np.sqrt(0.5), atol=1e-3) and gain(b, a, 15, 512) == pytest.approx(1, abs=1e-3) and gain(b, a, 0.5, 512) < 0.01
    b, a = butterworth(48.0, 52.0, 512.0, 2, True)
    assert np.allclose([gain(b, a, f, 512) for f in (48, 52)], np.sqrt(0.5), atol=1e-3) and gain(b, a, 50, 512) < 1e-2 and gain(b, a, 20, 512) == pytest.approx(1, abs=1e-3)


def test_zero_phase_keeps_peaks_in_place():
    t = np.arange(2048) / 512
    x = np.sin(2 * np.pi * 10 * t)
    y = zero_phase(*butterworth(3.0, 70.0, 512.0, 4), x)
    assert np.abs(y[300:-300] - x[300:-300]).max() < 0.02


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_daubechies_is_orthonormal(n):
    h = daubechies(n)
    assert len(h) == 2 * n and h.sum() == pytest.approx(np.sqrt(2))
    assert [h[: len(h) - 2 * k] @ h[2 * k :] for k in range(n)] == pytest.approx([1, *[0] * (n - 1)], abs=1e-7)


def test_wavelets_reconstruct():
    x = np.random.default_rng(0).normal(size=512)
    assert np.allclose(synthesise(analyse(x)), x) and np.allclose(wavelet_denoise(x, threshold=0.0), x)
    for n in (9, 100, 301, 333):  # odd lengths on several levels
        assert np.allclose(synthesise(analyse(x[:n]))[:n], x[:n]) and len(analyse(x[:n], levels=1)[0]) == (n + 7) // 2
    assert len(wavelet_denoise(x[:301])) == 301 and len(second_difference(x)) == 512
    with pytest.raises(ValueError):
        wavelet_denoise(x, "other")


def test_wavelet_edges_are_symmetric():
    """Two-value filters of one level, by hand: the signal is mirrored with its last value repeated."""
    low, high = analyse(np.array([1.0, 3.0, 6.0]), vanishing=1, levels=1)
    assert np.allclose(low, np.array([1 + 3, 6 + 6]) / np.sqrt(2)) and np.allclose(high, np.array([1 - 3, 6 - 6]) / np.sqrt(2))
    h = daubechies(2)
    low, _ = analyse(np.array([1.0, 2.0, 4.0, 8.0]), vanishing=2, levels=1)
    # x[2k + 1 - j] for k = 0: 2, 1 and the mirrored 1, 2; for k = 1: 8, 4, 2, 1; for k = 2: mirrored 4, 8, then 8, 4
    assert np.allclose(low, [h[::-1] @ [2, 1, 1, 2], h[::-1] @ [8, 4, 2, 1], h[::-1] @ [4, 8, 8, 4]])


def plain_filter(b, a, x):
    """Direct form, sample by sample, from the state that a constant x[0] settles at; in long doubles."""
    b, a = b.astype(np.longdouble), a.astype(np.longdouble)
    n = len(b) - 1
    z, seen = np.zeros(n, np.longdouble), np.longdouble(x[0]) * b.sum() / a.sum()
    for k in range(n - 1, -1, -1):
        z[k] = (z[k + 1] if k + 1 < n else 0) + b[k + 1] * x[0] - a[k + 1] * seen
    out = np.empty(len(x), np.longdouble)
    for i, v in enumerate(x):
        y = b[0] * v + z[0]
        z = np.append(z[1:], 0) + b[1:] * v - a[1:] * y
        out[i] = y
    return out


@pytest.mark.parametrize("design", [(3.0, 70.0, 512.0, 4), (48.0, 52.0, 512.0, 2, True)])
def test_blocks_equal_the_plain_recurrence(design):
    b, a = butterworth(*design)
    f, x = recurrence(b, a), np.random.default_rng(1).normal(size=3001)
    assert np.abs(f.run(x, f.settled * x[0]) - plain_filter(b, a, x)).max() < 1e-9


def test_a_day_in_50_blocks_equals_one_piece():
    """A day at 512 Hz: end states carried from block to block give the filter of the whole."""
    b, a = butterworth(3.0, 70.0, 512.0, 4)
    f, x = recurrence(b, a), np.random.default_rng(2).normal(size=86_400 * 512)
    whole = f.run(x, f.settled * x[0])
    state = f.settled * x[0]
    for part, want in zip(np.array_split(x, 50), np.array_split(whole, 50)):
        assert np.abs(f.run(part, state) - want).max() < 1e-9
        state = f.power(len(part)) * state + f.end(part, np.zeros(f.order, complex))


@pytest.mark.parametrize("n,size", [(5000, 300), (1000, 100_000), (20, 10), (1, 10)])
def test_filtered_series_equals_one_piece(spark, n, size):
    """In Spark, in blocks and groups of blocks, with nulls and a recording of one block beside."""
    b, a = butterworth(3.0, 70.0, 512.0, 4)
    x = np.random.default_rng(n).normal(size=n)
    at = lambda i: dt.datetime(2025, 1, 1) + dt.timedelta(microseconds=int(i * 1e6 / 512))
    rows = [("a", at(i), float(v)) for i, v in enumerate(x)] + [("b", at(i), float(v)) for i, v in enumerate(x[:200])] + [("a", at(3), None), ("b", None, 1.0)]
    got = zero_phase_series(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").repartition(3), b, a, key="k", ts="ts", value="v", size=size, group=4).orderBy("k", "us").collect()
    for k, want in (("a", x), ("b", x[:200])):
        own = [r for r in got if r.k == k]
        assert [r.value for r in own] == want.tolist() and np.abs(np.array([r.filtered for r in own]) - zero_phase(b, a, want)).max() < 1e-9


def test_corrector_drops_surplus_and_fills_gaps():
    x = np.full(15360, 0.01)
    beats = list(range(400, 15000, 409))
    for b in beats:
        x[b - 2 : b + 3] = [0.3, 0.7, 1.0, 0.7, 0.3]
    bits = np.zeros(15360, np.int8)
    bits[[b for k, b in enumerate(beats) if k != 5]] = 1
    bits[beats[10] + 102] = 1
    assert np.flatnonzero(IntervalCorrector().correct(x, bits)).tolist() == beats
    few = np.zeros(15360, np.int8)
    few[[5, 9]] = 1
    c = IntervalCorrector()
    assert (c.correct(x, few) == few).all() and c.notes == ["too few peaks"]


def test_runs_close():
    bits = np.zeros(300, np.int8)
    bits[[10, 20, 200]] = 1
    x = np.zeros(300)
    x[15] = -3
    assert np.flatnonzero(close_runs(x, bits)).tolist() == [15, 200]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-100, 100, width=16), max_size=24))
def test_spectrum_and_entropy_are_bounded(values):
    x = np.array(values, float)
    entropy, frequency, *shares = spectrum(x[None], 10.0)[0]
    assert -1e-6 <= entropy <= np.log2(max(len(x), 1)) + 1e-6 and 0 <= frequency < 5 + 1e-9
    assert sum(shares) == pytest.approx(1) or sum(shares) == 0
    assert np.isfinite(sample_entropy(x[None])).all() and np.isfinite(turns(x[None])[:, :2]).all()


def test_margin_holds_before_the_snap():
    """A place just inside the margin stays although its maximum lies within it."""
    c, x = IntervalCorrector(), np.full(2000, 0.01)
    a, b = 400, 400 + 2 * 77 + 1  # the middle lies 77 samples off, the margin is 76
    x[a + 70] = 1.0
    assert c._fill(x, a, b, 150.0, 1.0) == [a + 70]
    assert c._fill(x, a, a + 2 * 76, 150.0, 1.0) == []
