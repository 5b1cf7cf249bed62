"""Audio as binary rows: WAV to mono samples at one rate, and windows of them with digests."""

from __future__ import annotations

import hashlib
import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RATE = 16_000


def read_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(samples x channels as int16, rate) of a 16-bit PCM file."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        return np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()), w.getframerate()


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def mono(samples: np.ndarray) -> np.ndarray:
    """The channels' mean, rounded to even and clipped to 16 bits."""
    return np.clip(np.rint(samples.astype(np.float64).mean(axis=1)), -32768, 32767).astype(np.int16)


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate, by a windowed-sinc filter at the lower of both rates' limits."""
    if rate == to or not len(samples):
        return samples.astype(np.float64)
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    half = 10 * max(up, down)
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / max(up, down)) * np.kaiser(len(n), 5.0)
    taps *= up / taps.sum()
    at = np.arange(-(-len(samples) * up // down)) * down  # outputs, in steps of the raised rate
    out = np.zeros(len(at))
    first = -((half - at) // up)
    for k in range(2 * half // up + 1):
        i = first + k
        tap = half + at - i * up
        ok = (i >= 0) & (i < len(samples)) & (tap >= 0) & (tap < len(taps))
        out[ok] += samples[i[ok]] * taps[tap[ok]]
    return out


def canonical(content: bytes, to: int = RATE) -> np.ndarray:
    """Mono 16-bit samples at one rate."""
    samples, rate = read_wav(content)
    return np.clip(np.rint(resample(mono(samples), rate, to)), -32768, 32767).astype(np.int16)


def window_digests(files: DataFrame, windows: DataFrame) -> DataFrame:
    """SHA-256 of each window's samples: files (video_id, content) by windows (video_id, window_id, sample_start,
    sample_end). Files and windows of a video meet in one group; a video's audio is one row."""

    def f(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"window_id": right["window_id"], "pcm_sha256": None, "duration_samples": 0})
        samples = canonical(bytes(left["content"].iloc[0]))
        parts = [samples[a:b] for a, b in zip(right["sample_start"], right["sample_end"], strict=True)]
        return pd.DataFrame({"window_id": right["window_id"], "pcm_sha256": [hashlib.sha256(p.astype("<i2").tobytes()).hexdigest() for p in parts], "duration_samples": [len(p) for p in parts]})

    return files.groupBy("video_id").cogroup(windows.groupBy("video_id")).applyInPandas(f, "window_id string, pcm_sha256 string, duration_samples long")


def probe(files: DataFrame) -> DataFrame:
    """Rate, channels, samples and seconds of WAV rows (path, content); a file that can't be read has an error."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    s, rate = read_wav(bytes(content))
                    rows.append((path, rate, s.shape[1], len(s), len(s) / rate, None))
                except Exception as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples", "duration_s", "error"])

    return files.select("path", "content").mapInPandas(f, "path string, rate int, channels int, samples long, duration_s double, error string")


def command(program: str, *arguments: str, seconds: float = 60.0, content: bytes = b"") -> bytes:
    """Output of an external program that reads standard input; an error if it is not there, fails or takes too long."""
    import shutil
    import subprocess

    if shutil.which(program) is None:
        raise FileNotFoundError(f"{program} is not installed")
    done = subprocess.run([program, *arguments], input=content, capture_output=True, timeout=seconds, check=False)
    if done.returncode:
        raise ValueError(f"{program} failed: {done.stderr.decode(errors='replace')[-500:]}")
    return done.stdout


def wav_by_ffmpeg(content: bytes, rate: int = RATE, seconds: float = 600.0) -> bytes:
    """A container's first audio track as mono 16-bit WAV, by ffmpeg."""
    return command("ffmpeg", "-v", "error", "-i", "pipe:0", "-map", "0:a:0", "-ac", "1", "-ar", str(rate), "-c:a", "pcm_s16le", "-f", "wav", "pipe:1", seconds=seconds, content=content)


def extract(files: DataFrame, decode: Callable[[bytes], bytes] = wav_by_ffmpeg) -> DataFrame:
    """WAV of media rows (path, content): path, content, error. WAV files are taken as they are and others go through
    decode; a file that cannot be decoded is a row with an error and no content."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    raw = bytes(content)
                    rows.append((path, raw if raw[:4] == b"RIFF" else decode(raw), None))
                except Exception as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(f, "path string, content binary, error string")
