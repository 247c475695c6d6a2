"""Chunks: a dialogue line, or a run of consecutive narrator lines, as one piece of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

KEYS = ("book_id", "chapter_number")


def island(order: str, keys: tuple[str, ...] = KEYS) -> Column:
    """How many dialogue lines there are up to here: with is_narrator, it tells runs apart."""
    return F.sum(F.when(F.col("is_narrator"), 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(order))


def merge_chunks(lines: DataFrame, folder: Column | str, order: str = "line_idx", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each chunk: keys, chunk_idx, text, is_narrator, voice, instruct, role, n_lines, content_hash, audio_path.

    Texts of a run get their sentence ends and are joined by spaces; voice and
    instruct are those of the run's last line.  The runs' grouping reuses the
    partitioning by chapter that numbered them.
    """
    runs = lines.withColumn("__run", island(order, keys)).withColumn("__text", X.sentence_end("text"))
    merged = runs.groupBy(*keys, "__run", "is_narrator").agg(
        F.min(order).alias("__first"),
        F.expr(f"listagg(__text, ' ') within group (order by {order})").alias("text"),
        F.max_by("voice", order).alias("voice"),
        F.max_by("instruct", order).alias("instruct"),
        F.max_by("role", order).alias("role"),
        F.count("*").alias("n_lines"),
    )
    digest = X.chunk_hash("text", "voice", "instruct", "is_narrator")
    numbered = merged.withColumn("role", F.when(F.col("is_narrator"), "narrator").otherwise(F.col("role"))).withColumn("chunk_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("__first")) - 1).cast("int"))
    hashed = numbered.withColumn("content_hash", digest)
    number = F.col("chapter_number").cast("int") if "chapter_number" in keys else F.lit(1)
    return hashed.withColumn("audio_path", X.chunk_path(folder, number, "role", F.col("content_hash"))).select(*keys, "chunk_idx", "text", "is_narrator", "voice", "instruct", "role", "n_lines", "content_hash", "audio_path")
