"""Waveforms: the finishing chain over ``array<float>`` columns, and what headers tell.

Signals are numeric vectors in which every step needs its neighbours, so the chain is one Arrow UDF
over numpy; a row is one clip and nothing is shuffled.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _seconds(b: bytes | None) -> float | None:
    if b is None:
        return None
    try:
        with wave.open(io.BytesIO(bytes(b))) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError, ValueError):
        return None


@F.pandas_udf(T.DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    """Length of a WAV file in seconds; null if it cannot be read (29)."""
    return content.map(_seconds)


def biquads(cutoff: float, rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two high-pass sections that make a Butterworth filter of order four (bilinear transform)."""
    k = np.tan(np.pi * min(cutoff, 0.49 * rate) / rate)
    out = []
    for q in (1 / (2 * np.cos(np.pi / 8)), 1 / (2 * np.cos(3 * np.pi / 8))):
        norm = 1 / (1 + k / q + k * k)
        out.append((np.array([norm, -2 * norm, norm]), np.array([2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm])))
    return out


def _section(x: np.ndarray, b: np.ndarray, a: np.ndarray, block: int = 256) -> np.ndarray:
    """One filter section over a signal, block by block.

    Within a block the output is the convolution with the impulse response and the response to the state left by
    the block before; both are worked out once for a block's length.
    """
    step = np.array([[-a[0], 1.0], [-a[1], 0.0]])  # what becomes of the state without input
    drive = np.array([b[1] - a[0] * b[0], b[2] - a[1] * b[0]])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    free = np.array([p[0] for p in powers[:block]])  # output for each part of the state
    impulse = np.concatenate([[b[0]], free[:-1] @ drive])
    left = np.array([p @ drive for p in powers[:block]])[::-1]  # state that each input of a block leaves
    out, state = np.empty_like(x), np.zeros(2)
    for k in range(0, len(x), block):
        v = x[k : k + block]
        out[k : k + block] = np.convolve(v, impulse)[: len(v)] + free[: len(v)] @ state
        state = powers[len(v)] @ state + v @ left[block - len(v) :]
    return out


def high_pass(x: np.ndarray, rate: int, cutoff: float = 60.0) -> np.ndarray:
    """Signal without what lies below the cutoff (153)."""
    y = x.astype(np.float64)
    for b, a in biquads(cutoff, rate):
        y = _section(y, b, a)
    return y.astype(np.float32)


def trim_silence(x: np.ndarray, rate: int, below_db: float = 40.0, pad_ms: int = 50) -> np.ndarray:
    """Signal from the first to the last frame that is not far below the loudest (154)."""
    frame = max(1, rate // 100)
    n = len(x) // frame
    if not n:
        return x
    rms = np.sqrt((x[: n * frame].reshape(n, frame).astype(np.float64) ** 2).mean(1))
    loud = np.flatnonzero(rms > max(rms.max() * 10 ** (-below_db / 20), 1e-9))
    if not len(loud):
        return x
    pad = rate * pad_ms // 1000
    return x[max(0, loud[0] * frame - pad) : min(len(x), (loud[-1] + 1) * frame + pad)]


def reverb(x: np.ndarray, rate: int, mix: float = 0.05, seconds: float = 0.12, seed: int = 7) -> np.ndarray:
    """A little of a decaying noise response mixed in (155)."""
    if mix <= 0 or not len(x):
        return x
    n = max(1, int(rate * seconds))
    ir = np.random.default_rng(seed).standard_normal(n) * np.exp(-6.0 * np.arange(n) / n)
    ir /= np.sqrt((ir**2).sum())
    size = 1 << (len(x) + n - 1).bit_length()
    wet = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(ir, size), size)[: len(x)]
    return ((1 - mix) * x + mix * wet).astype(np.float32)


def joined(parts: list[np.ndarray], rate: int, pauses_ms: list[int] | None = None, fade_ms: int = 0) -> np.ndarray:
    """Signals one after another, with the pause after each; where there is none, a short linear crossfade."""
    out = np.zeros(0, dtype=np.float32)
    for k, x in enumerate(parts):
        pause = rate * (pauses_ms[k - 1] if k and pauses_ms else 0) // 1000
        n = 0 if pause or not k else min(rate * fade_ms // 1000, len(out), len(x))
        if n:
            up = np.arange(1, n + 1, dtype=np.float32) / (n + 1)
            out[-n:] = out[-n:] * (1 - up) + x[:n] * up
        out = np.concatenate([out, np.zeros(pause, dtype=np.float32), x[n:].astype(np.float32)])
    return out


def resampled(x: np.ndarray, rate: int, new_rate: int) -> np.ndarray:
    """Signal at another rate: its spectrum cut off or continued with zeros."""
    n = max(1, round(len(x) * new_rate / rate)) if len(x) else 0
    if not n or rate == new_rate:
        return x
    spectrum = np.fft.rfft(x.astype(np.float64))[: n // 2 + 1]
    return (np.fft.irfft(spectrum, n) * (n / len(x))).astype(np.float32)


def room_tone(x: np.ndarray, level_db: float = -70.0, seed: int = 7) -> np.ndarray:
    """Faint seeded noise under the signal (155)."""
    return (x + np.random.default_rng(seed).standard_normal(len(x)) * 10 ** (level_db / 20)).astype(np.float32)


# Fixed values of ITU-R BS.1770: the two stages of the weighting (gain in decibels, quality, frequency), the offset, and
# length, step and gates of the blocks.
SHELF, ROLL_OFF = (4.0, 1 / np.sqrt(2), 1500.0), (0.0, 0.5, 38.0)
OFFSET, BLOCK, STEP, SILENT, QUIET = -0.691, 0.4, 0.1, -70.0, -10.0


def _weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections of the loudness weighting: a high shelf and a high pass."""
    gain, q, f = SHELF
    w, g = 2 * np.pi * f / rate, 10 ** (gain / 40)
    c, r = np.cos(w), 2 * np.sqrt(g) * np.sin(w) / (2 * q)
    a0 = (g + 1) - (g - 1) * c + r
    shelf = (g * np.array([(g + 1) + (g - 1) * c + r, -2 * ((g - 1) + (g + 1) * c), (g + 1) + (g - 1) * c - r]) / a0, np.array([2 * ((g - 1) - (g + 1) * c), (g + 1) - (g - 1) * c - r]) / a0)
    _, q, f = ROLL_OFF
    w = 2 * np.pi * f / rate
    c, r = np.cos(w), np.sin(w) / (2 * q)
    high = (np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]) / (1 + r), np.array([-2 * c, 1 - r]) / (1 + r))
    return [shelf, high]


def lufs(x: np.ndarray, rate: int) -> float:
    """Integrated loudness of a mono signal, gated; minus infinity for silence and for less than a block."""
    n, step = int(BLOCK * rate), int(STEP * rate)
    if len(x) < n or not step:
        return -np.inf
    y = x.astype(np.float64)
    for b, a in _weighting(rate):
        y = _section(y, b, a)
    power = np.concatenate([[0.0], np.cumsum(y * y)])
    at = np.arange(0, len(x) - n + 1, step)
    mean = np.maximum(power[at + n] - power[at], 0.0) / n
    level = OFFSET + 10 * np.log10(np.maximum(mean, 1e-20))
    loud = level > SILENT
    if not loud.any():
        return -np.inf
    loud &= level > OFFSET + 10 * np.log10(mean[loud].mean()) + QUIET
    return float(OFFSET + 10 * np.log10(mean[loud].mean()))


def loudness(x: np.ndarray, target_db: float = -23.0, rate: int | None = None) -> np.ndarray:
    """Signal at a target loudness in LUFS (156); by its RMS level without a rate or where it is too short; silence stays."""
    own = lufs(x, rate) if rate else -np.inf
    if np.isfinite(own):
        return (x * 10 ** ((target_db - own) / 20)).astype(np.float32)
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) if len(x) else 0.0
    return x if rms < 1e-9 else (x * (10 ** (target_db / 20) / rms)).astype(np.float32)


def peak_limit(x: np.ndarray, peak: float = 0.97) -> np.ndarray:
    """Signal scaled down if its peak is over the limit, then clipped (157)."""
    top = float(np.abs(x).max()) if len(x) else 0.0
    return np.clip(x * (peak / top) if top > peak else x, -peak, peak).astype(np.float32)


def finish(x: np.ndarray, rate: int, cutoff: float = 60.0, mix: float = 0.05, tone_db: float = -70.0, target_db: float = -23.0, peak: float = 0.97, seed: int = 7) -> np.ndarray:
    """The chain: high-pass, trim, reverb, tone, loudness, limit (158)."""
    y = trim_silence(high_pass(x, rate, cutoff), rate)
    return peak_limit(loudness(room_tone(reverb(y, rate, mix, seed=seed), tone_db, seed), target_db, rate), peak)


def finished(signal: Column, rate: Column, **kw) -> Column:
    """The chain over a column of signals; null stays null."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else finish(np.asarray(x, dtype=np.float32), int(k), **kw) for x, k in zip(s, r)])

    return run(signal, rate)


def rms_db(signal: Column) -> Column:
    """RMS level in decibels, natively; null for silence."""
    n = F.size(signal)
    mean = F.aggregate(signal, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.when(n > 0, n)
    return F.when(mean > 0, 10 * F.log10(mean))


def level_db(value: Column) -> Column:
    """RMS level in decibels of the rows of a group as a signal, added up before they are shuffled; null for silence."""
    mean = F.avg(value.cast("double") * value)
    return F.when(mean > 0, 10 * F.log10(mean))


def _over_signals(fn) -> object:  # noqa: ANN001
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(np.asarray(x, dtype=np.float32)) for x in s])

    return run


def levelled(signal: Column) -> Column:
    """A column of signals at the target level."""
    return _over_signals(loudness)(signal)


def limited(signal: Column) -> Column:
    """A column of signals with limited peaks."""
    return _over_signals(peak_limit)(signal)


def silent_wav(samples: Column, rate: Column) -> Column:
    """WAV files of silence, mono and of 16 bits."""

    @F.pandas_udf(T.BinaryType())
    def make(n: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for k, hz in zip(n, r):
            held = io.BytesIO()
            with wave.open(held, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(int(hz))
                w.writeframes(bytes(2 * int(k)))
            out.append(held.getvalue())
        return pd.Series(out)

    return make(samples, rate)


def joined_signals(signals: Column, rate: int, pauses_ms: Column | None = None, fade_ms: int = 0) -> Column:
    """A column of arrays of signals, each joined to one."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        one = lambda x, ms: joined([np.asarray(y, dtype=np.float32) for y in x], rate, None if ms is None else list(ms), fade_ms)
        return pd.Series([None if x is None else one(x, ms) for x, ms in zip(s, p)])

    return run(signals, F.lit(None).cast("array<int>") if pauses_ms is None else pauses_ms)


def resampled_signals(signal: Column, rate: int, new_rate: int) -> Column:
    """A column of signals at another rate."""
    return _over_signals(lambda x: resampled(x, rate, new_rate))(signal)
