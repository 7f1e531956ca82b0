"""Spectral peaks of a pulse and the tracks that they form from frame to frame."""

from __future__ import annotations

import numpy as np

from ..config import SAMPLE_RATE
from .signal import band, local_peaks, stft

# Results depend on them.
N_FFT, HOP = 1024, 32
MAX_PEAKS = 5
MIN_GAP_HZ, MAX_JUMP_HZ = 1500.0, 5000.0
PROMINENCE_DB, FRAME_RANGE_DB, FLOOR_DB = 2.5, 22.0, -38.0
MAX_GAP_FRAMES = 2
MIN_TRACK_MS, MIN_COVERAGE = 0.55, 0.50


def spectral_peaks(y: np.ndarray, window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(frame, frequencies, powers) of the loudest peaks of each frame that is loud enough, the loudest first."""
    bins = band(N_FFT)
    hz, power = bins * (SAMPLE_RATE / N_FFT), np.abs(stft(y, N_FFT, HOP, window)[:, bins]) ** 2
    top = power.max() if power.size else 0.0
    if top <= 0:
        return []
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(top, 1e-10))
    db = np.maximum(db, db.max() - 80)
    apart = max(1, round(MIN_GAP_HZ / (SAMPLE_RATE / N_FFT)))
    out = []
    for i in np.flatnonzero(db.max(axis=1) >= FLOOR_DB):
        at = local_peaks(db[i], max(FLOOR_DB, db[i].max() - FRAME_RANGE_DB), PROMINENCE_DB, apart)
        at = at if len(at) else np.array([db[i].argmax()])
        at = at[np.argsort(power[i, at])[::-1][:MAX_PEAKS]]
        out.append((int(i), hz[at], power[i, at]))
    return out


def link_peaks(peaks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[dict]:
    """Tracks of peaks, the strongest first.

    In each frame the open tracks (seen at most MAX_GAP_FRAMES + 1 frames ago) are continued along
    their last step; pairs of track and peak are taken from the nearest on, each side once, within
    MAX_JUMP_HZ a frame. Peaks that are left open tracks. Short or sparse tracks are left out.
    """
    tracks: list[dict] = []
    for frame, hz, power in peaks:
        live = [t for t in tracks if frame - t["frames"][-1] <= MAX_GAP_FRAMES + 1]
        free = np.ones(len(hz), bool)
        if live:
            ago = np.array([frame - t["frames"][-1] for t in live])
            last = np.array([t["hz"][-1] for t in live])
            pace = np.array([(t["hz"][-1] - t["hz"][-2]) / max(1, t["frames"][-1] - t["frames"][-2]) if len(t["hz"]) > 1 else 0.0 for t in live])
            miss = np.abs(hz[None, :] - (last + pace * ago)[:, None])
            miss[miss > MAX_JUMP_HZ * np.maximum(ago, 1)[:, None]] = np.inf
            idle = np.ones(len(live), bool)
            for cell in np.argsort(miss, axis=None, kind="stable"):
                t, p = divmod(int(cell), len(hz))
                if miss[t, p] == np.inf:
                    break
                if idle[t] and free[p]:
                    idle[t] = free[p] = False
                    for name, value in (("frames", frame), ("hz", float(hz[p])), ("power", float(power[p]))):
                        live[t][name].append(value)
        tracks += [{"frames": [frame], "hz": [float(hz[p])], "power": [float(power[p])]} for p in np.flatnonzero(free)]
    least = max(3, int(np.ceil(MIN_TRACK_MS / (HOP / SAMPLE_RATE * 1000))))
    whole = [t for t in tracks if len(t["frames"]) >= least and len(t["frames"]) >= MIN_COVERAGE * (t["frames"][-1] - t["frames"][0] + 1)]
    return sorted(whole, key=lambda t: -sum(t["power"]))


def source_masks(shape: tuple[int, int], components: list[list[dict]]) -> np.ndarray:
    """Components x frames x bins: shares of each source, by Gaussians around its tracks weighed by their level."""
    frames, hz = np.arange(shape[0]), np.arange(shape[1]) * (SAMPLE_RATE / N_FFT)
    inside = np.zeros(shape[1], bool)
    inside[band(N_FFT)] = True
    out = np.zeros((len(components), *shape))
    for weight, members in zip(out, components):
        for t in members:
            level = np.interp(frames, t["frames"], t["power"])
            level = np.sqrt(np.maximum(level / max(level.max(), 1e-18), 1e-6))
            bell = np.exp(-0.5 * ((hz[None, :] - np.interp(frames, t["frames"], t["hz"])[:, None]) / 1200.0) ** 2) * level[:, None]
            bell[(frames < t["frames"][0]) | (frames > t["frames"][-1])] = 0
            np.maximum(weight, bell * inside, out=weight)
    total = out.sum(axis=0)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-12)
