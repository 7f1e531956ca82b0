"""NumPy kernels against slow definitions; no Spark."""

import numpy as np
import pytest
import sounds as S

from pulselake.functions import descriptors as D
from pulselake.functions import signal as G
from pulselake.functions import tracks as T
from pulselake.operators.matching import dtw_distances


def test_highpass_keeps_the_band_and_its_phase():
    y = S.tone(47, 20)
    assert np.abs(G.highpass(y) - y)[500:-500].max() < 1e-3
    low = S.tone(3, 20)
    assert np.abs(G.highpass(low))[500:-500].max() < 1e-4
    t = np.arange(50_000) / S.SR
    edge = np.sin(2 * np.pi * 15_000 * t)
    assert np.abs(G.highpass(edge))[20_000:30_000].max() == pytest.approx(0.5, abs=0.01)  # -3 dB twice
    assert (G.highpass(np.ones(20)) == 1).all() and len(G.highpass(np.ones(40))) == 40


def test_stft_inverts():
    y = np.random.default_rng(1).normal(size=3001)
    for n, hop, w in ((1024, 32, 256), (256, 16, 256)):
        z = G.stft(y, n, hop, w)
        assert np.allclose(G.istft(z, n, hop, w, len(y)), y, atol=1e-9)
    power = np.abs(G.stft(y, 256, 16)[:, G.band(256)]) ** 2
    assert np.allclose(G.band_power(y, 256, 16, block=7), power.sum(axis=1))


def test_resample():
    t = np.arange(5000) / 500_000
    y = np.sin(2 * np.pi * 40_000 * t) * np.hanning(5000)
    got = G.resample(y, 500_000)
    assert len(got) == 2500 and np.abs(got - y[::2]).max() < 1e-3
    assert G.resample(y, 250_000) is y


def test_worth_reading():
    quiet = np.full(1000, 1e-3)
    assert not G.worth_reading(quiet, 1e-3) and not G.worth_reading(np.zeros(10), 1)
    assert G.worth_reading(np.append(quiet, 0.002), 1) and G.worth_reading(np.append(quiet, 0.02), 1) and G.worth_reading(quiet, 1e-4) and G.worth_reading(np.zeros(0), 1)


def slow_peaks(x, height, prominence, distance):
    at = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] >= height]
    kept = []
    for i in sorted(at, key=lambda i: (x[i], i), reverse=True):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for p in sorted(kept):
        a = max([i for i in range(p) if x[i] > x[p]], default=-1) + 1
        b = min([i for i in range(p + 1, len(x)) if x[i] > x[p]], default=len(x))
        if x[p] - max(min(x[a : p + 1]), min(x[p:b])) >= prominence:
            out.append(p)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_local_peaks(seed):
    x = np.random.default_rng(seed).normal(0, 5, 120)
    for args in ((-3.0, 2.5, 1), (0.0, 4.0, 6), (2.0, 0.0, 3)):
        assert G.local_peaks(x, *args).tolist() == slow_peaks(x, *args)
    assert G.local_peaks(np.array([0, 1, 1, 1, 0.0]), 0, 0, 1).tolist() == [2]


def slow_dtw(a, b, radius=4):
    n, m = len(a), len(b)
    r = max(radius, abs(n - m))
    cost, steps = {(0, 0): 0.0}, {(0, 0): 0}
    for i in range(1, n + 1):
        for j in range(max(1, i - r), min(m, i + r) + 1):
            best = min(((cost.get(c, np.inf), k, c) for k, c in enumerate(((i - 1, j - 1), (i - 1, j), (i, j - 1)))), key=lambda x: x[:2])
            cost[i, j], steps[i, j] = abs(a[i - 1] - b[j - 1]) + best[0], steps.get(best[2], 0) + 1
    return cost[n, m] / steps[n, m]


@pytest.mark.parametrize("n,m", [(32, 32), (10, 10), (12, 19)])
def test_dtw(n, m):
    r = np.random.default_rng(n + m)
    a, b = r.normal(50, 10, (6, n)), r.normal(50, 10, (6, m))
    a[0, : min(n, m)] = b[0, : min(n, m)]
    assert np.allclose(dtw_distances(a, b), [slow_dtw(x, y) for x, y in zip(a, b)])


def test_features_of_known_pulses():
    f = D.pulse_features(S.tone(47, 5))
    assert abs(f["peak_freq_khz"] - 47) < 0.5 and abs(f["frequency_drop_khz"]) < 1 and f["bandwidth_90_khz"] < 3
    g = D.pulse_features(S.tone(90, 8, to_khz=40))
    assert g["slope_khz_per_ms"] == pytest.approx(-50 / 8, rel=0.15) and 30 < g["frequency_drop_khz"] < 50
    assert D.pulse_features(np.zeros(1000)) is None and D.pulse_features(np.ones(20)) is None
    track = D.frequency_track(S.tone(90, 8, to_khz=40))
    assert len(track) == 32 and track[0] > track[-1] + 25
    assert D.template_descriptor(S.tone(47))["duration_ms"] == pytest.approx(5)


def test_running_medians():
    x = np.array([5.0, 1, 4, 2, 3, 9])
    assert D.padded_median(x, 5, "constant").tolist() == [1, 2, 3, 3, 3, 2]
    assert D.padded_median(x, 3, "edge").tolist() == [5, 4, 2, 3, 3, 9]


def test_tracks_of_two_tones():
    found = T.link_peaks(T.spectral_peaks(S.tone(47, 10) + S.tone(67, 10, 0.4), 256))
    assert [round(float(np.median(t["hz"])) / 1000) for t in found[:2]] == [47, 67]
    for t in found:
        assert t["frames"] == sorted(set(t["frames"])) and len(t["frames"]) >= 3


def test_masks_share_everything_once():
    a, b = S.tone(47, 10), S.tone(67, 10, 0.4)
    y = a + b
    window = 256
    z = G.stft(y, T.N_FFT, T.HOP, window)
    tracks = T.link_peaks(T.spectral_peaks(y, window))[:2]
    masks = T.source_masks(z.shape, [[t] for t in tracks])
    total = masks.sum(axis=0)
    assert np.all((total < 1e-9) | (np.abs(total - 1) < 1e-9))
    parts = [G.istft(z * m, T.N_FFT, T.HOP, window, len(y)) for m in masks]
    for got, want in zip(parts, (a, b)):
        assert np.corrcoef(got, want)[0, 1] > 0.98
