"""Mel-frequency cepstral coefficients with numpy, for uncompressed WAV files."""

from __future__ import annotations

import io
import wave

import numpy as np

RATE, SECONDS, FRAME, HOP, BANDS, COEFFICIENTS = 22_050, 30, 2048, 512, 128, 13


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(mono samples from -1 to 1, rate)."""
    with wave.open(io.BytesIO(content)) as f:
        raw, width, channels, rate = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels(), f.getframerate()
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width in (2, 4):
        samples = np.frombuffer(raw, f"<i{width}").astype(float) / 2 ** (8 * width - 1)
    else:
        raise ValueError(f"{8 * width}-bit samples aren't read")
    return samples.reshape(-1, channels).mean(axis=1), rate


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    if rate == to or not len(samples):
        return samples
    places = np.arange(0, len(samples) - 1, rate / to)
    return np.interp(places, np.arange(len(samples)), samples)


def _mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz, float) / 700)


def _bands(rate: int) -> np.ndarray:
    edges = 700 * (10 ** (np.linspace(_mel(0), _mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(content: bytes) -> np.ndarray:
    """(frames, COEFFICIENTS) of the first SECONDS."""
    samples, rate = read_wav(content)
    x = resample(samples[: SECONDS * rate], rate)
    x = np.pad(x, FRAME // 2)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ _bands(RATE).T
    decibels = 10 * np.log10(np.maximum(power, 1e-10))
    decibels = np.maximum(decibels, decibels.max() - 80)
    k, n = np.arange(COEFFICIENTS)[:, None], np.arange(BANDS)
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * BANDS)) * np.sqrt(np.where(k == 0, 1, 2) / BANDS)
    return decibels @ basis.T


def extract_audio(path: str) -> list[float]:
    """An extractor for AUDIO columns: the mean coefficients."""
    with open(path, "rb") as f:
        return mfcc(f.read()).mean(axis=0).tolist()
