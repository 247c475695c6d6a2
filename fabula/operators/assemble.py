"""Chunks' audio in chapter order, with a gap between consecutive ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.audio import SAMPLE_RATE, read_wav, write_wav

GAP_SECONDS = 0.7
GAP_SAMPLES = int(GAP_SECONDS * SAMPLE_RATE)
CHAPTER = ("book_id", "chapter_number")


def start_sample(keys: tuple[str, ...] = CHAPTER, order: str = "chunk_idx", size: str = "n_samples") -> Column:
    """Where a chunk begins: all chunks before it and a gap after each."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.col(size) + GAP_SAMPLES).over(before), F.lit(0)).cast("long")


def timeline(chunks: DataFrame, keys: tuple[str, ...] = CHAPTER) -> DataFrame:
    """chunks with start_sample and end_sample."""
    return chunks.withColumn("start_sample", start_sample(keys)).withColumn("end_sample", F.col("start_sample") + F.col("n_samples"))


def assemble_chapters(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes one file for each chapter and returns its path and length.

    chunks: book_id, chapter_number, filename, chunk_idx, audio_path.  Only paths are
    gathered; the task that writes a chapter reads one chunk after another.  A chapter
    whose only row has a null path gets an empty file.
    """
    ordered = chunks.groupBy(*CHAPTER, "filename").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "audio_path"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = np.zeros(GAP_SAMPLES, np.float32)
        for part in batches:
            sizes, paths = [], []
            for c in part.itertuples():
                pieces: list[np.ndarray] = []
                for p in c.parts:
                    if p["audio_path"] is not None:
                        pieces += [gap, read_wav(p["audio_path"])] if pieces else [read_wav(p["audio_path"])]
                sound = np.concatenate(pieces) if pieces else np.zeros(0, np.float32)
                path = f"{folder}/{c.book_id}/{c.filename}"
                write_wav(path, sound)
                sizes.append(len(sound))
                paths.append(path)
            yield part[[*CHAPTER]].assign(path=paths, n_samples=sizes)

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    return ordered.mapInPandas(run, f"book_id {kinds['book_id']}, chapter_number {kinds['chapter_number']}, path string, n_samples long")
