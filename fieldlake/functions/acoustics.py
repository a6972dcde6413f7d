"""Acoustic features of short clips, on NumPy arrays: mel patches, cepstra, band-pass, spectral measures, alignment.

Filter banks, transforms and filters are built from their public definitions.
Kernels take one channel of finite samples. Silent or too short clips give a
defined result, stated at each kernel.
"""

from __future__ import annotations

import numpy as np

#: The analysed band in Hz.
LOW, HIGH = 1_000.0, 15_000.0


def hann(n: int) -> np.ndarray:
    """The periodic window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def power_frames(x: np.ndarray, size: int, hop: int, centred: bool = True) -> np.ndarray:
    """(frequencies, frames) of power; centred frames see zeros beyond both ends, others leave a tail uncovered."""
    x = np.asarray(x, dtype=np.float64)
    if centred:
        x = np.pad(x, size // 2)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    cut = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(cut * hann(size), axis=1)).T ** 2


def mel(hz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear below 1 kHz, logarithmic above."""
    hz = np.asarray(hz, dtype=np.float64)
    return np.where(hz < 1000, 3 * hz / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def hz(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    return np.where(m < 15, 200 * m / 3, 1000 * np.exp(np.log(6.4) * (np.maximum(m, 15) - 15) / 27))


def mel_bank(rate: int, size: int, bands: int, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """(bands, frequencies) triangles of unit area."""
    corner = hz(np.linspace(mel(low), mel(high), bands + 2))[:, None]
    f = np.fft.rfftfreq(size, 1 / rate)[None, :]
    up, down = (f - corner[:-2]) / (corner[1:-1] - corner[:-2]), (corner[2:] - f) / (corner[2:] - corner[1:-1])
    return np.maximum(0, np.minimum(up, down)) * 2 / (corner[2:] - corner[:-2])


def decibels(power: np.ndarray, reference: float | None = None, floor: float = 1e-10, depth: float = 80.0) -> np.ndarray:
    """10 log10(power / reference), at most depth below its own peak. The reference is the peak where it is None."""
    reference = float(power.max(initial=0.0)) if reference is None else reference
    db = 10 * np.log10(np.maximum(power, floor)) - 10 * np.log10(max(reference, floor))
    return np.maximum(db, db.max() - depth) if db.size else db


def log_mel_patch(x: np.ndarray, rate: int, bands: int = 64, columns: int = 32) -> np.ndarray:
    """(bands, columns) of standardised log-mel power; time is resampled linearly. A clip of constant level is all zeros."""
    db = decibels(mel_bank(rate, 1024, bands) @ power_frames(x, 1024, 256))
    at = np.linspace(0, db.shape[1] - 1, columns)
    lower = np.floor(at).astype(int)
    upper = np.minimum(lower + 1, db.shape[1] - 1)
    patch = db[:, lower] * (1 - (at - lower)) + db[:, upper] * (at - lower)
    spread = patch.std()
    return (patch - patch.mean()) / spread if spread > 1e-12 else np.zeros_like(patch)


def cosine_transform(rows: int, n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix's first rows."""
    out = np.cos(np.pi * np.arange(rows)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def cepstra(x: np.ndarray, rate: int, count: int = 20, bands: int = 128, size: int = 2048, hop: int = 512) -> np.ndarray:
    """(count, frames) mel cepstra; a short clip is padded to one frame."""
    x = np.pad(np.asarray(x, dtype=np.float64), (0, max(0, size - len(x))))
    return cosine_transform(count, bands) @ decibels(mel_bank(rate, size, bands) @ power_frames(x, size, hop), 1.0)


def slopes(rows: np.ndarray, most: int = 9) -> np.ndarray:
    """Least-squares slopes over an odd width of at most `most` frames, whole windows only at the ends; zeros for fewer than 3 frames."""
    frames = rows.shape[1]
    if frames < 3:
        return np.zeros_like(rows)
    width = min(most, frames if frames % 2 else frames - 1)
    reach = np.arange(width) - width // 2
    fit = np.lib.stride_tricks.sliding_window_view(rows, width, axis=1) @ reach / (reach**2).sum()
    return np.concatenate([np.repeat(fit[:, :1], width // 2, axis=1), fit, np.repeat(fit[:, -1:], frames - fit.shape[1] - width // 2, axis=1)], axis=1)


def cepstral_vector(x: np.ndarray, rate: int) -> np.ndarray:
    """80 numbers: means and deviations of 20 cepstra, then of their slopes."""
    c = cepstra(x, rate)
    d = slopes(c)
    return np.concatenate([c.mean(axis=1), c.std(axis=1), d.mean(axis=1), d.std(axis=1)])


def butterworth(order: int, low: float, high: float, rate: int) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital band-pass, by the bilinear transform."""
    if not 0 < low < high < rate / 2:
        raise ValueError("the band must lie between 0 and half the rate")
    edge = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = edge[1] - edge[0], np.sqrt(edge[0] * edge[1])
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(prototype**2 - centre**2 + 0j)
    pole = (2 * rate + np.concatenate([prototype + root, prototype - root])) / (2 * rate - np.concatenate([prototype + root, prototype - root]))
    upper = sorted(pole[pole.imag > 1e-12], key=abs)
    real = np.sort(pole[np.abs(pole.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    sections = np.array([(1.0, 0.0, -1.0, 1.0, a1, a2) for a1, a2 in pairs])
    z = np.exp(2j * np.arctan(centre / (2 * rate)))
    gain = np.abs(np.prod([(1 - z**-2) / (1 + a1 / z + a2 / z**2) for a1, a2 in pairs]))
    sections[:, :3] *= gain ** (-1 / len(sections))
    return sections


def _section(x: np.ndarray, s: np.ndarray, block: int = 256) -> np.ndarray:
    """One section over x, block by block: products within blocks, and a state of two numbers between them. It begins as after an endless x[0]."""
    b0, b1, b2, _, a1, a2 = s.tolist()
    step, push = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    power = [np.eye(2)]
    for _ in range(block):
        power.append(power[-1] @ step)
    seen = np.array([m[0] for m in power[:block]])
    answer = np.concatenate([[b0], seen[:-1] @ push])
    at = np.arange(block)[:, None] - np.arange(block)[None, :]
    inside = np.where(at >= 0, answer[np.maximum(at, 0)], 0.0)
    rows = np.concatenate([x, np.zeros(-len(x) % block)]).reshape(-1, block)
    gained = rows @ np.array([m @ push for m in power[block - 1 :: -1]])
    state = np.empty((len(rows), 2))
    now = np.linalg.solve(np.eye(2) - step, push) * x[0]
    for k in range(len(rows)):
        state[k] = now
        now = power[block] @ now + gained[k]
    return (rows @ inside.T + state @ seen.T).ravel()[: len(x)]


def band_pass(x: np.ndarray, rate: int, low: float = 1_500.0, high: float = HIGH, order: int = 5) -> np.ndarray:
    """Zero-phase: forward and backward over an odd extension of both ends. Clips of up to the extension's length are errors."""
    sections = butterworth(order, low, high, rate)
    x = np.asarray(x, dtype=np.float64)
    reach = 3 * (2 * len(sections) + 1)
    if len(x) <= reach:
        raise ValueError(f"expected more than {reach} samples")
    y = np.concatenate([2 * x[0] - x[reach:0:-1], x, 2 * x[-1] - x[-2 : -reach - 2 : -1]])
    for _ in range(2):
        for s in sections:
            y = _section(y, s)
        y = y[::-1]
    return y[reach:-reach]


def spectral_measures(power: np.ndarray, frequency: np.ndarray) -> dict:
    """Peak, centroid and the interpolated 5 and 95 % points of a power spectrum; all None for silence."""
    total = float(power.sum())
    if not total > 0:
        return {"peak": None, "centroid": None, "low": None, "high": None, "bandwidth": None}
    share = np.cumsum(power) / total
    low, high = (float(np.interp(q, share, frequency)) for q in (0.05, 0.95))
    return {"peak": float(frequency[power.argmax()]), "centroid": float((power * frequency).sum() / total), "low": low, "high": high, "bandwidth": high - low}


def welch(x: np.ndarray, rate: int, size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, mean power) over half-overlapping frames, each without its mean."""
    cut = np.lib.stride_tricks.sliding_window_view(np.asarray(x, dtype=np.float64), size)[:: size // 2]
    power = np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * hann(size), axis=1)) ** 2
    power = power.mean(axis=0) / (rate * (hann(size) ** 2).sum())
    power[1:-1] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def lag(a: np.ndarray, b: np.ndarray, most: int = 2400) -> int:
    """By how many samples b comes after a, from -most to most: the highest cross-correlation; the smallest lag of ties."""
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    n = 1 << int(np.ceil(np.log2(len(a) + len(b))))
    full = np.fft.irfft(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), n)
    lags = np.arange(-most, most + 1)
    return int(lags[full[lags % n].argmax()])


def compared(a: np.ndarray, b: np.ndarray, rate: int, most: int = 2400, edge: int = 2400) -> dict:
    """Two recordings of one sound: lag over the first 3 s, then both spectra over what they share without its edges."""
    by = lag(a[: 3 * rate], b[: 3 * rate], most)
    a, b = (a[: len(a)], b[by:]) if by >= 0 else (a[-by:], b)
    n = min(len(a), len(b))
    a, b = a[edge : n - edge], b[edge : n - edge]
    out: dict = {"lag": by, "samples": len(a)}
    for name, x in (("a", a), ("b", b)):
        out |= {f"{name}_{k}": v for k, v in spectral_measures(*welch(x, rate)[::-1]).items()}
    out["correlation"] = float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else None
    return out


def onset_envelope(x: np.ndarray, rate: int, bands: int = 128, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Spectral flux: the mean rise of each mel band in dB against the frame before; delayed by what a centred frame sees ahead."""
    db = decibels(mel_bank(rate, size, bands, 0.0, rate / 2) @ power_frames(x, size, hop), 1.0)
    rise = np.maximum(0, np.diff(db, axis=1)).mean(axis=0)
    return np.concatenate([np.zeros(1 + size // (2 * hop)), rise])[: db.shape[1]]


def spectral_shape(magnitude: np.ndarray, frequency: np.ndarray, roll: float = 0.85) -> np.ndarray:
    """(4, frames): centroid, bandwidth, roll-off and flatness of each frame; a silent frame has 0, 0, 0 and 1."""
    total = magnitude.sum(axis=0)
    share = magnitude / np.where(total > 0, total, 1)
    centroid = frequency @ share
    bandwidth = np.sqrt((share * (frequency[:, None] - centroid) ** 2).sum(axis=0))
    rolloff = frequency[(np.cumsum(magnitude, axis=0) >= roll * total).argmax(axis=0)]
    power = np.maximum(magnitude**2, 1e-10)
    return np.stack([centroid, bandwidth, rolloff, np.exp(np.log(power).mean(axis=0)) / power.mean(axis=0)])


def spectral_contrast(magnitude: np.ndarray, frequency: np.ndarray, lowest: float = LOW, octaves: int = 6, quantile: float = 0.02) -> np.ndarray:
    """(octaves + 1, frames) of dB between the strongest and weakest share of each octave; the first band ends at lowest.

    A neighbouring bin joins each band's lower edge, and the last band takes all
    above it. Zeros if an octave would start beyond the highest frequency.
    """
    edges = np.concatenate([[0.0], lowest * 2.0 ** np.arange(octaves + 1)])
    if edges[-2] >= frequency[-1]:
        return np.zeros((octaves + 1, magnitude.shape[1]))
    peaks, valleys = [], []
    for band in range(octaves + 1):
        inside = np.flatnonzero((frequency >= edges[band]) & (frequency <= edges[band + 1]))
        first = inside[0] - (band > 0)
        last = len(frequency) if band == octaves else inside[-1] + 1
        n = max(1, int(np.rint(quantile * (last - first))))
        ordered = np.sort(magnitude[first : last - (band < octaves)], axis=0)
        valleys.append(ordered[:n].mean(axis=0))
        peaks.append(ordered[-n:].mean(axis=0))
    return decibels(np.array(peaks), 1.0) - decibels(np.array(valleys), 1.0)


def temporal(x: np.ndarray, rate: int, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Duration, mean and deviation of the rate of sign changes, mean and deviation of the level, over centred frames."""
    frames = lambda y: np.lib.stride_tricks.sliding_window_view(y, size)[::hop]
    edged = np.pad(x, size // 2, mode="edge")
    negative = np.signbit(np.where(np.abs(edged) <= 1e-10, 0.0, edged))
    turns = (np.diff(frames(negative).astype(np.int8), axis=1) != 0).sum(axis=1) / size
    level = np.sqrt((frames(np.pad(x, size // 2)) ** 2).mean(axis=1))
    return np.array([len(x) / rate, turns.mean(), turns.std(), level.mean(), level.std()])


def clip_vector(x: np.ndarray, rate: int, size: int = 2048, hop: int = 512) -> np.ndarray:
    """105 numbers: 5 of the onset envelope, 80 cepstral, 15 spectral, 5 temporal. A short clip is padded to one frame, also in its duration."""
    x = np.pad(np.asarray(x, dtype=np.float64), (0, max(0, size - len(x))))
    envelope = onset_envelope(x, rate, size=size, hop=hop)
    change = np.abs(np.diff(envelope))
    magnitude, frequency = np.sqrt(power_frames(x, size, hop)), np.fft.rfftfreq(size, 1 / rate)
    shape = spectral_shape(magnitude, frequency)
    return np.concatenate(
        [
            [envelope.max(), envelope.mean(), envelope.std(), np.ptp(envelope), change.mean() if len(change) else 0.0],
            cepstral_vector(x, rate),
            np.stack([shape.mean(axis=1), shape.std(axis=1)], axis=1).ravel(),
            spectral_contrast(magnitude, frequency).mean(axis=1),
            temporal(x, rate, size, hop),
        ]
    )


def tukey(n: int, taper: float = 0.25) -> np.ndarray:
    """The periodic window that is flat but for a cosine taper of this share, half at each end."""
    at = np.arange(n) / n
    edge = np.minimum(at, 1 - at)
    return np.where(edge < taper / 2, 0.5 - 0.5 * np.cos(2 * np.pi * edge / taper), 1.0)


def frame_peaks(a: np.ndarray, b: np.ndarray, rate: int, size: int = 1024, hop: int = 256, low: float = LOW, high: float = HIGH) -> dict:
    """How far the peaks of aligned recordings differ in Hz, over the frames where a has a tenth of its highest band energy; None without energy."""
    n = min(len(a), len(b))
    f = np.fft.rfftfreq(size, 1 / rate)
    band = (f >= low) & (f <= high)

    def power(x: np.ndarray) -> np.ndarray:
        cut = np.lib.stride_tricks.sliding_window_view(np.asarray(x[:n], dtype=np.float64), size)[::hop]
        return np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * tukey(size), axis=1))[:, band] ** 2

    if n < size:
        raise ValueError(f"expected at least {size} samples")
    p, q = power(a), power(b)
    energy = p.sum(axis=1)
    active = (energy >= energy.max() * 0.1) & (energy > 0)
    if not active.any():
        return {"frames": 0, "median": None, "p95": None, "max": None, "over_100": None}
    away = np.abs(f[band][p.argmax(axis=1)] - f[band][q.argmax(axis=1)])[active]
    return {"frames": int(active.sum()), "median": float(np.median(away)), "p95": float(np.percentile(away, 95)), "max": float(away.max()), "over_100": float((away > 100).mean())}


def vectors(batches, kernel: str):
    """For mapInPandas over (path, rate, samples): path, vector and the error of a clip that the kernel refuses."""
    import pandas as pd

    made = {"log_mel": lambda x, rate: log_mel_patch(x, rate).ravel(), "cepstra": cepstral_vector, "clip": clip_vector, "band_pass": band_pass}[kernel]
    for part in batches:
        rows = []
        for path, rate, samples in zip(part["path"], part["rate"], part["samples"]):
            try:
                x = np.asarray(samples, dtype=np.float64)
                if not len(x) or not np.isfinite(x).all():
                    raise ValueError("expected finite samples")
                rows.append((path, made(x, int(rate)).astype(np.float32), None))
            except (TypeError, ValueError) as e:
                rows.append((path, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "vector", "error"])
