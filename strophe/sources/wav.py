"""WAV files: decoding to mono samples, a reader of audio blocks, and encoding of 16-bit PCM."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .generator import AUDIO, as_blocks

# Format tags of the file format.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class WavError(ValueError):
    """The bytes are no WAV file that can be read."""


def _values(raw: bytes, tag: int, bits: int) -> np.ndarray:
    if tag == FLOAT and bits in (32, 64):
        return np.frombuffer(raw, f"<f{bits // 8}").astype(float)
    if tag == PCM and bits == 8:
        return (np.frombuffer(raw, "u1").astype(float) - 128) / 128
    if tag == PCM and bits in (16, 32):
        return np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    if tag == PCM and bits == 24:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    raise WavError(f"format {tag} with {bits} bits")


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples, channels averaged, and the rate. A data chunk that says too much, or nothing, ends with the file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise WavError("not RIFF/WAVE")
    form, raw, at = None, None, 12
    while at + 8 <= len(data) and raw is None:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"fmt ":
            if body + 16 > len(data):
                raise WavError("the fmt chunk is cut off")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            if tag == EXTENSIBLE and size >= 26 and body + 26 <= len(data):
                tag = struct.unpack_from("<H", data, body + 24)[0]
            form = tag, channels, rate, bits
        elif name == b"data":
            raw = data[body : body + size] if size else data[body:]
        at = body + size + size % 2
    if form is None:
        raise WavError("no fmt chunk before the data")
    if raw is None:
        raise WavError("no data chunk")
    tag, channels, rate, bits = form
    if channels < 1:
        raise WavError("no channels")
    whole = len(raw) // (channels * bits // 8 or 1) * (channels * bits // 8)
    return _values(raw[:whole], tag, bits).reshape(-1, channels).mean(axis=1), rate


def encode_wav(samples: np.ndarray, rate: int, scale: str = "symmetric") -> bytes:
    """16-bit mono. symmetric: one factor, clamped; asymmetric: each sign has its own full scale."""
    x = np.asarray(samples, dtype=float)
    if scale == "asymmetric":
        x = np.clip(x, -1, 1)
        x = x * np.where(x < 0, 32768, 32767)
    elif scale == "symmetric":
        x = x * 32768
    else:
        raise ValueError(f"scale is symmetric or asymmetric, not {scale!r}")
    raw = np.clip(np.floor(x + 0.5), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(raw)) + raw


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Audio blocks of the files under path, and error. A file that cannot be read is one row with its error."""
    schema = AUDIO + ", error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    samples, rate = decode_wav(content)
                except WavError as e:
                    yield pd.DataFrame({"take_id": [name], "sample_rate": [0], "block_no": [0], "start_sample": [0], "samples": [None], "error": [str(e)]})
                else:
                    yield as_blocks(name, samples, rate).assign(error=None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


# Weights of the six channels of 5.1, and the longest take in seconds.
SURROUND = [0.7071, 0.7071, 1.0, 0.0, 0.5, 0.5]
MOST_SEC = 60.0


def mixed(channels: list[np.ndarray]) -> np.ndarray:
    """One channel of several: flat weights, or those of 5.1 for six; as long as the shortest."""
    if not channels:
        return np.zeros(0)
    n = min(len(c) for c in channels)
    weights = SURROUND if len(channels) == len(SURROUND) else [1.0] * len(channels)
    return sum(w * np.asarray(c, float)[:n] for w, c in zip(weights, channels)) / sum(weights)


def capped(samples: np.ndarray, rate: int, most_sec: float = MOST_SEC) -> np.ndarray:
    return samples[: int(most_sec * rate)]
