"""Speech for chunks, behind a provider.

The iterator form lets a task load one model and keep it for all of its chunks;
chunks are dealt by model and hash, so a task seldom needs more than one model.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.audio import SAMPLE_RATE, write_wav
from .cast import model_id

LANGUAGE = "French"
#: Waveforms that a task holds at a time.
AT_ONCE = 64


class Voice(Protocol):
    name: str  # audio is kept apart by it

    def load(self, model: str) -> object: ...

    def speak(self, model: object, text: str, voice: str, instruct: str, language: str) -> np.ndarray: ...


class ToneVoice:
    """A deterministic stand-in for a speech model: a tone whose length and pitch come from the text and voice."""

    name = "tone"

    def load(self, model: str) -> object:
        return 1.0 if "0.6B" in model else 1.5

    def speak(self, model: float, text: str, voice: str, instruct: str, language: str) -> np.ndarray:
        n = 24 * max(1, len(text))
        pitch = 110 * model * (1 + sum(voice.encode()) % 12 / 12)
        return (0.2 * np.sin(2 * np.pi * pitch * np.arange(n) / SAMPLE_RATE)).astype(np.float32)


_loaded: dict[tuple[str, str], object] = {}


def _model(voice: Voice, name: str) -> object:
    """Each model once in a Python worker."""
    key = (type(voice).__qualname__, name)
    if key not in _loaded:
        _loaded[key] = voice.load(name)
    return _loaded[key]


def waveforms(jobs: DataFrame, voice: Voice, keep: tuple[str, ...]) -> DataFrame:
    """keep columns, sample_rate, n_samples and samples (32-bit floats as bytes) of every job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p[k : k + AT_ONCE] for p in batches for k in range(0, len(p), AT_ONCE)):
            sound = [voice.speak(_model(voice, j.model_id), j.text, j.voice, j.instruct or "", LANGUAGE) for j in part.itertuples()]
            yield part[list(keep)].assign(sample_rate=SAMPLE_RATE, n_samples=[len(s) for s in sound], samples=[s.astype("<f4").tobytes() for s in sound])

    routed = jobs.withColumn("model_id", model_id())
    schema = ", ".join([*(f"{c} {routed.schema[c].dataType.simpleString()}" for c in keep), "sample_rate int, n_samples long, samples binary"])
    return routed.select(*{*keep, "text", "voice", "instruct", "model_id"}).mapInPandas(run, schema)


def synthesize(jobs: DataFrame, voice: Voice, tasks: int | None = None) -> DataFrame:
    """Writes the audio file of every job, executor side, and returns audio_path and n_samples.

    Paths are addresses of content, so a job that runs twice writes the same file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            lengths = []
            for j in part.itertuples():
                sound = voice.speak(_model(voice, j.model_id), j.text, j.voice, j.instruct or "", LANGUAGE)
                write_wav(j.audio_path, sound)
                lengths.append(len(sound))
            yield part[["audio_path"]].assign(n_samples=lengths)

    routed = jobs.withColumn("model_id", model_id()).select("audio_path", "text", "voice", "instruct", "model_id")
    dealt = routed.repartition(tasks, "model_id", F.xxhash64("audio_path")) if tasks else routed.repartition("model_id", F.xxhash64("audio_path"))
    return dealt.mapInPandas(run, "audio_path string, n_samples long")
