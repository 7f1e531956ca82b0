"""Synthetic recordings with known pulses."""

import struct

import numpy as np

from pulselake.functions.signal import wav_bytes

SR = 250_000


def tone(khz: float, ms: float = 5.0, level: float = 0.5, to_khz: float | None = None) -> np.ndarray:
    """A tone or sweep with Hann edges."""
    n = round(ms / 1000 * SR)
    t = np.arange(n) / SR
    end = khz if to_khz is None else to_khz
    phase = 2 * np.pi * 1000 * (khz * t + (end - khz) * t * t / (2 * n / SR))
    return level * np.sin(phase) * np.hanning(n)


def recording(seconds: float, pulses: list[tuple[float, np.ndarray]], noise: float = 0.0, seed: int = 42) -> np.ndarray:
    """Silence or white noise with pulses that are centred at the given seconds."""
    y = np.random.default_rng(seed).normal(0, 1, round(seconds * SR)) * noise
    for at, p in pulses:
        first = round(at * SR) - len(p) // 2
        y[first : first + len(p)] += p
    return y


def write(path, y: np.ndarray, sr: int = SR) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(wav_bytes(y, sr))
    return str(path)


def stereo(y: np.ndarray) -> bytes:
    """Two equal channels."""
    body = np.repeat(np.rint(y * 32767).astype("<i2"), 2).tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 2, SR, 4 * SR, 4, 16, b"data", len(body)) + body
