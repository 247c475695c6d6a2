"""Incremental recomputation: what is cached, what is stale, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

CHAPTER = ("book_id", "chapter_number")
PASSAGE = (*CHAPTER, "passage_idx")


def is_valid() -> Column:
    """A cached annotation still holds: same text, and it has lines."""
    return F.coalesce((F.col("text_hash") == F.col("__cached_hash")) & (F.size("lines") > 0), F.lit(False))


def with_cache(passages: DataFrame, cache: DataFrame) -> DataFrame:
    """passages with text_hash, valid, and lines and roster of their cache entry (null if there is none)."""
    entries = cache.select(*PASSAGE, F.col("text_hash").alias("__cached_hash"), "lines", "roster")
    hashed = passages.withColumn("text_hash", X.passage_hash("text"))
    return hashed.join(entries, list(PASSAGE), "left").withColumn("valid", is_valid()).drop("__cached_hash")


def first_pending(checked: DataFrame) -> DataFrame:
    """Each chapter's first passage without a valid annotation (null if all are done), and its number of passages."""
    return checked.groupBy(*CHAPTER).agg(F.min(F.when(~F.col("valid"), F.col("passage_idx"))).alias("first_pending"), F.count("*").alias("n_passages"))


def invalidate(cache: DataFrame, pending: DataFrame) -> DataFrame:
    """The cache without each chapter's entries from its first pending passage on; chapters that aren't in pending keep theirs."""
    return cache.join(pending.select(*CHAPTER, "first_pending"), list(CHAPTER), "left").where(F.col("first_pending").isNull() | (F.col("passage_idx") < F.col("first_pending"))).drop("first_pending")


def roster_at_resume(cache: DataFrame, pending: DataFrame) -> DataFrame:
    """The roster before the first pending passage (or after the last one), empty where there is none."""
    at = pending.select(*CHAPTER, (F.coalesce("first_pending", "n_passages") - 1).cast("int").alias("passage_idx"))
    found = at.join(cache.select(*PASSAGE, "roster"), list(PASSAGE), "left")
    return found.select(*CHAPTER, F.coalesce("roster", F.array().cast("array<string>")).alias("roster"))


def pending_jobs(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks whose audio isn't there; a path that several of a chapter's chunks share is one job, that of the first."""
    missing = chunks.join(existing.select("audio_path"), "audio_path", "left_anti")
    first = F.row_number().over(Window.partitionBy("audio_path").orderBy(*CHAPTER, "chunk_idx"))
    return missing.withColumn("__n", first).where("__n = 1").drop("__n")


def job_totals(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each chapter's number of chunks, and of jobs that are left for it."""
    left = jobs.groupBy(*CHAPTER).agg(F.count("*").alias("n_jobs"))
    return chunks.groupBy(*CHAPTER).agg(F.count("*").alias("n_chunks")).join(left, list(CHAPTER), "left").select(*CHAPTER, "n_chunks", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


def chapters_to_do(chapters: DataFrame, finished: DataFrame) -> DataFrame:
    """Chapters whose output file isn't there."""
    named = chapters.withColumn("filename", X.chapter_filename(F.col("chapter_number").cast("int"), "title"))
    return named.join(finished.select("book_id", "filename"), ["book_id", "filename"], "left_anti")


def run_summary(chapters: DataFrame, finished: DataFrame) -> DataFrame:
    """book_id, completed (to be done in this run), skipped and total chapters."""
    named = chapters.withColumn("filename", X.chapter_filename(F.col("chapter_number").cast("int"), "title"))
    marked = named.join(finished.select("book_id", "filename").distinct().withColumn("__done", F.lit(True)), ["book_id", "filename"], "left")
    return marked.groupBy("book_id").agg(F.count_if(F.col("__done").isNull()).alias("completed"), F.count_if(F.col("__done")).alias("skipped"), F.count("*").alias("total"))
