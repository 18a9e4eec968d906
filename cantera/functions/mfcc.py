"""Cepstral coefficients of WAV audio with numpy alone, by the usual public definition: mel spectrum in decibels, then a cosine transform."""

from __future__ import annotations

import io
import wave

import numpy as np

#: Fixed values of the usual definition.
RATE, FRAME, HOP, BANDS = 22_050, 2048, 512, 128
LEAST_POWER, RANGE_DB = 1e-10, 80.0
LINEAR_HZ, LINEAR_BANDS, OCTAVE_STEP = 1000.0, 15.0, np.log(6.4) / 27
#: Frames that are transformed at once.
BLOCK = 2048


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and their rate; PCM of 8 to 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(1), rate


def at_rate(x: np.ndarray, rate: int, wanted: int = RATE) -> np.ndarray:
    """The signal at another rate: its spectrum cut off or continued with zeros."""
    if rate == wanted or not len(x):
        return x
    n = max(1, round(len(x) * wanted / rate))
    spectrum = np.zeros(n // 2 + 1, complex)
    own = np.fft.rfft(x)
    keep = min(len(own), len(spectrum))
    spectrum[:keep] = own[:keep]
    return np.fft.irfft(spectrum, n) * n / len(x)


def to_mel(hz: np.ndarray) -> np.ndarray:
    """Linear below LINEAR_HZ, logarithmic above."""
    low = hz * LINEAR_BANDS / LINEAR_HZ
    return np.where(hz < LINEAR_HZ, low, LINEAR_BANDS + np.log(np.maximum(hz, LINEAR_HZ) / LINEAR_HZ) / OCTAVE_STEP)


def to_hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < LINEAR_BANDS, mel * LINEAR_HZ / LINEAR_BANDS, LINEAR_HZ * np.exp(OCTAVE_STEP * (np.maximum(mel, LINEAR_BANDS) - LINEAR_BANDS)))


def bands(rate: int = RATE) -> np.ndarray:
    """Triangles of equal area over the spectrum, evenly spaced in mel: BANDS x (FRAME / 2 + 1)."""
    edge = to_hz(np.linspace(0, to_mel(np.array(rate / 2)), BANDS + 2))
    hz = np.linspace(0, rate / 2, FRAME // 2 + 1)
    low, middle, high = (edge[i : BANDS + i, None] for i in range(3))
    rising, falling = (hz - low) / (middle - low), (high - hz) / (high - middle)
    return np.maximum(0, np.minimum(rising, falling)) * 2 / (high - low)


def coefficients(x: np.ndarray, count: int, rate: int = RATE) -> np.ndarray:
    """Frames x count. Frames are HOP apart and centred, with silence beyond both ends."""
    padded = np.pad(x, FRAME // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] if len(padded) >= FRAME else np.zeros((0, FRAME))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
    filters = bands(rate).T
    power = [np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)) ** 2 @ filters for at in range(0, len(frames), BLOCK)]
    if not power:
        return np.zeros((0, count))
    db = 10 * np.log10(np.maximum(LEAST_POWER, np.concatenate(power)))
    db = np.maximum(db, db.max() - RANGE_DB)
    k, n = np.arange(count), np.arange(BANDS)
    basis = np.cos(np.pi * (n[:, None] + 0.5) * k / BANDS) * np.where(k == 0, np.sqrt(1 / BANDS), np.sqrt(2 / BANDS))
    return db @ basis


def mfcc_of_wav(content: bytes, count: int) -> np.ndarray:
    return coefficients(at_rate(*read_wav(content)), count)
