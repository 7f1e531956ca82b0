"""Small NumPy kernels that have no column form; operators call them on Arrow batches inside tasks."""

from __future__ import annotations

import struct

import numpy as np

from ..config import BAND_HZ, FASTSKIP_FACTOR, FASTSKIP_MARGIN_DB, FASTSKIP_PEAK, SAMPLE_RATE

#: Samples that the ends of a piece are mirrored by before filtering.
MIRROR = 4096


def wav_header(head: bytes, size: int) -> dict:
    """Format and place of the samples of a RIFF/WAVE file from its first bytes. Raises ValueError."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(head):
        tag, n = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if tag == b"fmt ":
            code, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            code = struct.unpack_from("<H", head, at + 32)[0] if code == 0xFFFE and n >= 26 else code  # extensible: the subformat
            form = code, channels, rate, align, bits
        elif tag == b"data":
            if form is None or form[0] not in (1, 3) or not form[2] or not form[3] or form[4] not in (8, 16, 24, 32, 64):
                raise ValueError("samples in an unknown format")
            frames = min(n, size - at - 8) // form[3]
            if frames <= 0:
                raise ValueError("no samples")
            return {"code": form[0], "channels": form[1], "sr": form[2], "align": form[3], "bits": form[4], "start": at + 8, "frames": frames}
        at += 8 + n + n % 2
    raise ValueError("no samples in the first bytes")


def wav_samples(data: bytes, h: dict) -> np.ndarray:
    """Samples of whole frames as doubles in -1 to 1, the mean over channels (Q18)."""
    bits = h["bits"]
    if h["code"] == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = (raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8 | raw[:, 2].view(np.int8).astype(np.int32) << 16) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{bits // 8}").astype(np.float64) / 2.0 ** (bits - 1)
    return x.reshape(-1, h["channels"]).mean(axis=1)


def wav_bytes(samples: np.ndarray, sr: int = SAMPLE_RATE) -> bytes:
    """A mono PCM-16 WAV file; louder samples than full scale are clipped."""
    body = np.clip(np.rint(np.asarray(samples, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, sr, 2 * sr, 2, 16, b"data", len(body))
    return head + body


def resample(y: np.ndarray, sr: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Band-limited by its spectrum; the same samples if the rates agree."""
    if sr == to or not len(y):
        return y
    n = int(round(len(y) * to / sr))
    spectrum = np.fft.rfft(y)
    keep = min(len(spectrum), n // 2 + 1)
    out = np.zeros(n // 2 + 1, complex)
    out[:keep] = spectrum[:keep]
    return np.fft.irfft(out, n) * (n / len(y))


def highpass(y: np.ndarray, sr: int = SAMPLE_RATE, cutoff: float = BAND_HZ[0]) -> np.ndarray:
    """G1: fourth-order Butterworth high-pass, forward and backward.

    Both passes together have no phase and the gain 1 / (1 + (tan(c) / tan(w)) ** 8), so they are one
    multiplication of the spectrum of the piece, its ends continued by odd reflection.
    """
    if len(y) < 32 or sr / 2 <= cutoff:
        return y
    k = min(MIRROR, len(y) - 1)
    x = np.concatenate((2 * y[0] - y[k:0:-1], y, 2 * y[-1] - y[-2 : -k - 2 : -1]))
    n = 1 << (len(x) - 1).bit_length()
    w = np.pi * np.arange(n // 2 + 1) / n
    with np.errstate(divide="ignore", over="ignore"):
        gain = 1 / (1 + (np.tan(np.pi * cutoff / sr) / np.abs(np.tan(w))) ** 8)
    return np.fft.irfft(np.fft.rfft(x, n) * gain, n)[k : k + len(y)]


def hann(n: int, size: int) -> np.ndarray:
    """A periodic Hann window of n points in the middle of size."""
    out, at = np.zeros(size), (size - n) // 2
    out[at : at + n] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return out


def stft(y: np.ndarray, n_fft: int, hop: int, window: int | None = None) -> np.ndarray:
    """Frames x bins; frame i is centred on sample i * hop, with zeros beyond the ends."""
    x = np.pad(y, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.fft.rfft(frames * hann(window or n_fft, n_fft), axis=1)


def istft(z: np.ndarray, n_fft: int, hop: int, window: int, length: int) -> np.ndarray:
    """Overlap-add of the frames, divided by the summed squares of the window."""
    w = hann(window, n_fft)
    frames = np.fft.irfft(z, n_fft, axis=1) * w
    at = (np.arange(len(z)) * hop)[:, None] + np.arange(n_fft)
    size = max(int(at.max()) + 1, n_fft // 2 + length)
    out = np.bincount(at.ravel(), frames.ravel(), size)
    norm = np.bincount(at.ravel(), np.broadcast_to(w * w, at.shape).ravel(), size)
    out = np.where(norm > 1e-10, out / np.maximum(norm, 1e-10), 0)
    return out[n_fft // 2 : n_fft // 2 + length]


def band(n_fft: int, sr: int = SAMPLE_RATE) -> np.ndarray:
    """Indices of the bins of the analysed band."""
    hz = np.arange(n_fft // 2 + 1) * (sr / n_fft)
    return np.flatnonzero((hz >= BAND_HZ[0]) & (hz <= min(BAND_HZ[1], sr / 2)))


def envelope(y: np.ndarray, sr: int = SAMPLE_RATE) -> np.ndarray:
    """The largest absolute sample of each whole millisecond."""
    n = max(1, round(sr / 1000))
    return np.abs(y[: len(y) // n * n]).reshape(-1, n).max(axis=1)


def worth_reading(env: np.ndarray, block_peak_median: float) -> bool:
    """P4 on one chunk, before any spectrum is computed; doubts keep the chunk."""
    if not len(env):
        return True
    peak, middle = float(env.max()), float(np.median(env))
    if peak <= 0:
        return False
    usual = block_peak_median > 0 and peak >= FASTSKIP_FACTOR * block_peak_median
    return peak >= FASTSKIP_PEAK or peak >= 10 ** (FASTSKIP_MARGIN_DB / 20) * max(middle, 1e-12) or usual


def local_peaks(x: np.ndarray, height: float, prominence: float, distance: int) -> np.ndarray:
    """Indices of local maxima (middles of plateaus) of at least so much height and prominence.

    Of two that lie nearer than distance, the higher stays; of equal ones the later. Prominence is
    the drop to the higher of the two lowest points on the way to higher ground on either side.
    """
    change = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(x)]))
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (starts[top] + ends[top] - 1) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    at = at[keep]
    out = []
    for p in at:
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p], higher[higher > p]
        a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(x))
        if x[p] - max(x[a : p + 1].min(), x[p:b].min()) >= prominence:
            out.append(p)
    return np.array(out, np.int64)


def band_power(y: np.ndarray, n_fft: int, hop: int, block: int = 2048) -> list[float]:
    """A1 on one piece: the band's power in each frame, some frames at a time."""
    bins, out = band(n_fft), []
    x = np.pad(y, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] if len(x) >= n_fft else np.zeros((0, n_fft))
    for first in range(0, len(frames), block):
        z = np.fft.rfft(frames[first : first + block] * hann(n_fft, n_fft), axis=1)[:, bins]
        out.append((z.real**2 + z.imag**2).sum(axis=1))
    return np.concatenate(out).tolist() if out else []
