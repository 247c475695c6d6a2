"""Waveforms in WAV files (16-bit, one channel), written so that a file is there whole or not at all.

Paths are in their canonical form (config.canonical): absolute paths on a file system
that all executors share, or URIs of a store that Arrow's file systems know.
"""

from __future__ import annotations

import io
import os
import posixpath
import uuid
import wave

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import canonical, exists

SAMPLE_RATE = 24000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def wav_bytes(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def write_wav(path: str, samples: np.ndarray, rate: int = SAMPLE_RATE) -> None:
    store, place = _place(path)
    store.create_dir(posixpath.dirname(place), recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(wav_bytes(samples, rate))
    store.move(part, place)


def read_wav(path: str, rate: int = SAMPLE_RATE) -> np.ndarray:
    """Samples as 32-bit floats; a file at another rate is an error."""
    store, place = _place(path)
    with store.open_input_file(place) as f, wave.open(io.BytesIO(f.read()), "rb") as sound:
        if sound.getframerate() != rate:
            raise ValueError(f"{path} has {sound.getframerate()} samples a second, not {rate}")
        return np.frombuffer(sound.readframes(sound.getnframes()), "<i2").astype(np.float32) / 32767


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """audio_path (canonical) of every WAV file below a folder, by listing alone."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "audio_path string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(canonical(spark, folder))
    return files.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("audio_path"))
