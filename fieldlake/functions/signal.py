"""Signal kernels on NumPy arrays, and their pandas UDFs.

Constants are part of each kernel's contract. Silent input gives the floor, not
NaN; wrong shapes and rates raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed values of the display spectrogram: rate, window, hop, transform length, highest frequency, floor in dB.
RATE, WINDOW, HOP, LENGTH, HIGHEST, FLOOR = 48_000, 512, 96, 1024, 16_000, -70.0


def spectrogram(samples: np.ndarray, rate: int) -> dict:
    """dB below the panel's peak in [FLOOR, 0] by frequency and frame; no padding, so some of the tail may be uncovered."""
    samples = np.asarray(samples, dtype=np.float64)
    if rate != RATE or samples.ndim != 1 or len(samples) < WINDOW or not np.isfinite(samples).all():
        raise ValueError(f"expected at least {WINDOW} finite samples of one channel at {RATE} Hz")
    frames = 1 + (len(samples) - WINDOW) // HOP
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    cut = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    power = np.abs(np.fft.rfft(cut * hann, LENGTH, axis=1)).T ** 2
    frequency = np.fft.rfftfreq(LENGTH, 1 / rate)
    power, frequency = power[frequency <= HIGHEST], frequency[frequency <= HIGHEST]
    peak = power.max()
    db = np.full_like(power, FLOOR) if peak == 0 else np.clip(10 * np.log10(np.maximum(power, np.finfo(float).tiny) / peak), FLOOR, 0)
    stop = (frames - 1) * HOP + WINDOW
    return {"db": db, "frequency": frequency, "frames": frames, "last_stop": stop, "uncovered": len(samples) - stop}


def framed(samples: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """Windows of size samples, each overlapping the one before; the last one is padded with zeros."""
    hop = size - overlap
    starts = np.arange(0, len(samples), hop)
    padded = np.concatenate([samples, np.zeros(size, dtype=np.asarray(samples).dtype)])
    return np.stack([padded[s : s + size] for s in starts]) if len(starts) else np.zeros((0, size))


def cut(samples: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The frames [start, stop); bounds outside the samples raise."""
    if not 0 <= start < stop <= len(samples):
        raise ValueError("frames out of bounds")
    return samples[start:stop]


def pcm_digest(samples: np.ndarray) -> str:
    """SHA-256 of little-endian 32-bit floats in order."""
    from hashlib import sha256

    return sha256(np.ascontiguousarray(samples, dtype="<f4").tobytes()).hexdigest()


class PcmStatistics:
    """Statistics of a sample stream; the result does not depend on how the stream is cut into chunks.

    Bytes of interleaved 32-bit floats come through feed(); a chunk may end
    inside a sample. Runs and window sums are carried over.
    """

    def __init__(self, channels: int, rate: int):
        self.channels, self.rate, self.rest = channels, rate, b""
        self.window, self.hop = rate // 10, rate // 20
        self.frames = self.finite = self.nonfinite = self.eq1 = self.gt1 = 0
        self.peak, self.total, self.square = 0.0, np.zeros(channels), 0.0
        self.zero_run, self.run, self.longest_zero, self.longest = np.zeros(channels, int), np.zeros(channels, int), 0, 0
        self.last = np.full(channels, np.nan)
        self.energy: list[np.ndarray] = []
        self.pending, self.windows, self.partial, self.least_rms, self.most_rms = np.zeros((0, channels)), 0, 0, np.inf, 0.0

    def feed(self, chunk: bytes) -> None:
        data = self.rest + chunk
        size = 4 * self.channels
        whole = len(data) // size * size
        self.rest = data[whole:]
        x = np.frombuffer(data[:whole], dtype="<f4").reshape(-1, self.channels).astype(np.float64)
        if not len(x):
            return
        ok = np.isfinite(x)
        self.frames, self.finite, self.nonfinite = self.frames + len(x), self.finite + int(ok.sum()), self.nonfinite + int((~ok).sum())
        good = np.where(ok, x, 0.0)
        self.peak = max(self.peak, float(np.abs(good).max()))
        self.eq1, self.gt1 = self.eq1 + int((np.abs(good) == 1).sum()), self.gt1 + int((np.abs(good) > 1).sum())
        self.total, self.square = self.total + good.sum(axis=0), self.square + float((good**2).sum())
        for c in range(self.channels):
            self._runs(x[:, c], c)
        self.pending = np.concatenate([self.pending, x])
        self._slide(False)

    def _runs(self, v: np.ndarray, c: int) -> None:
        same = np.concatenate([[v[0] == self.last[c]], v[1:] == v[:-1]])  # NaN never joins a run
        for is_zero in (False, True):
            hit = v == 0 if is_zero else same
            carry = self.zero_run[c] if is_zero else self.run[c]
            place = np.arange(len(v))
            broken = np.where(hit, -1, place)
            since = place - np.maximum.accumulate(broken)
            length = since + np.where(np.maximum.accumulate(broken) < 0, carry, 0) + (0 if is_zero else 0)
            if is_zero:
                self.zero_run[c] = length[-1] if hit[-1] else 0
                self.longest_zero = max(self.longest_zero, int(np.where(hit, length, 0).max()))
            else:
                length = np.where(np.maximum.accumulate(broken) < 0, length, since + 1)
                length = np.where(np.isfinite(v), length, 0)
                self.run[c] = length[-1]
                self.longest = max(self.longest, int(length.max()))
        self.last[c] = v[-1]

    def _slide(self, end: bool) -> None:
        at = 0
        while len(self.pending) - at >= self.window or (end and at < len(self.pending)):
            part = self.pending[at : at + self.window]
            self.windows, self.partial = self.windows + 1, self.partial + (len(part) < self.window)
            if np.isfinite(part).all():
                rms = float(np.sqrt((part**2).mean()))
                self.least_rms, self.most_rms = min(self.least_rms, rms), max(self.most_rms, rms)
            at += self.hop
        self.pending = self.pending[at:]

    def result(self) -> dict:
        self._slide(True)
        return {
            "frames": self.frames, "finite": self.finite, "nonfinite": self.nonfinite, "peak": self.peak, "dc": (self.total / max(1, self.frames)).tolist(), "rms": float(np.sqrt(self.square / max(1, self.finite))),
            "eq1": self.eq1, "gt1": self.gt1, "ge1": self.eq1 + self.gt1, "longest_zero": self.longest_zero, "longest_constant": self.longest, "windows": self.windows, "partial": self.partial, "least_rms": self.least_rms, "most_rms": self.most_rms,
        }


def spectrogram_summary(batches: Iterator) -> Iterator:
    """For mapInPandas over (path, samples): frames, uncovered samples and the loudest frequency."""
    import pandas as pd

    for part in batches:
        rows = []
        for path, samples in zip(part["path"], part["samples"]):
            try:
                s = spectrogram(np.asarray(samples), RATE)
                rows.append((path, s["frames"], s["uncovered"], float(s["frequency"][s["db"].max(axis=1).argmax()]), None))
            except (TypeError, ValueError) as e:
                rows.append((path, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "frames", "uncovered", "peak_hz", "error"])
