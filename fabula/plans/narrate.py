"""Books to chapters of audio: one plan over all chapters that aren't done.

Annotation goes in waves of chapters, each committed before the next begins, and a
chapter that a provider fails at doesn't take others with it: what was annotated is
kept, and the run ends with that error.  Everything else is one plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotate, assemble, cast, chunk, resume, structure, synth
from ..sources import audio, cache, config, epub

CHAPTER = ("book_id", "chapter_number")


@dataclass
class Settings:
    books: str
    provider: annotate.Provider
    voice: synth.Voice | None = None  # not needed if speech is skipped
    work: str = "work"  # caches, chunk audio
    output: str = "output"
    voices: str = "voices.json"
    cast: str = "cast.json"
    chapter: int | None = None  # None: all chapters
    skip_tts: bool = False
    narrator_tone: bool = True
    workers: int = 2
    wave: int = 256  # chapters annotated, about, from one commit to the next
    say: Callable[[str], None] = lambda _: None

    @property
    def caches(self) -> str:
        """Answers of different providers are never taken for each other."""
        return f"{self.work}/cache-{self.provider.name}"

    @property
    def audio(self) -> str:
        return f"{self.work}/audio-{self.voice.name}"


@dataclass
class Books:
    """Chapters, their body, and what of it is narrated; chapters with an output file are left out of the last three."""

    every: DataFrame
    finished: DataFrame
    chapters: DataFrame
    body: DataFrame
    passages: DataFrame


def _settled(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession, s: Settings, run: str) -> Books:
    """Books are parsed once, into the run's folder."""
    elements = _settled(epub.read_books(spark, s.books), f"{run}/elements")
    every, body = (d.withColumn("chapter_number", F.col("chapter_number").cast("int")) for d in structure.read_structure(elements))
    place = F.split("audio_path", "/")
    finished = audio.existing(spark, s.output).select(F.element_at(place, -2).alias("book_id"), F.element_at(place, -1).alias("filename"))
    if s.chapter is not None:
        chapters = structure.one_chapter(every, s.chapter)
    else:
        chapters = resume.chapters_to_do(every, finished).drop("filename")
    chapters = _settled(chapters.select(*CHAPTER, "heading", "title"), f"{run}/chapters")
    body = _settled(body.join(chapters.select(*CHAPTER), list(CHAPTER), "left_semi"), f"{run}/body")
    return Books(every, finished, chapters, body, structure.narration_passages(chapters, body))


def _raise(rows: DataFrame) -> None:
    failed = rows.where("error is not null").orderBy(*CHAPTER).select(*CHAPTER, "error").limit(5).collect()
    if failed:
        raise annotate.AnnotationError("; ".join(f"{r['book_id']}, chapter {r['chapter_number']}: {r['error']}" for r in failed))


def annotated(spark: SparkSession, s: Settings, books: Books, run: str) -> tuple[DataFrame, DataFrame]:
    """Annotations and tones of all chapters to do, committed to the caches wave by wave before anything else uses them.

    What a provider answers is written down at once, good answers are committed, and only then does a failure end the run.
    """
    waves = max(1, -(-books.chapters.count() // s.wave))
    for k in range(waves):
        mine: Column = F.pmod(F.xxhash64(*CHAPTER), F.lit(waves)) == k
        if s.narrator_tone:
            known = cache.read(spark, s.caches, "tones")
            lacking = books.chapters.where(mine).join(known, list(CHAPTER), "left_anti")
            if not lacking.isEmpty():
                found = _settled(annotate.tones(structure.tone_samples(lacking, books.body.where(mine)), known, s.provider), f"{run}/tones-{k}")
                cache.commit(found.where("error is null"), s.caches, "tones")
                _raise(found)
        checked = resume.with_cache(books.passages.where(mine), cache.read(spark, s.caches, "annotations"))
        pending = resume.first_pending(checked).where("first_pending is not null").select(*CHAPTER)
        if not pending.isEmpty():
            fresh = _settled(annotate.annotate_chapters(checked.join(pending, list(CHAPTER), "left_semi"), s.provider), f"{run}/annotations-{k}")
            cache.commit(fresh.where("error is null"), s.caches, "annotations")
            _raise(fresh)
        s.say(f"annotated: wave {k + 1} of {waves}")
    annotations = cache.read(spark, s.caches, "annotations").join(books.passages.select(*CHAPTER, "passage_idx"), [*CHAPTER, "passage_idx"], "left_semi")
    return annotations, cache.read(spark, s.caches, "tones")


def chunks_of(spark: SparkSession, s: Settings, annotations: DataFrame, tones: DataFrame) -> DataFrame:
    lines = annotate.exploded_lines(annotations)
    if s.narrator_tone:
        lines = lines.join(tones.withColumnRenamed("instruct", "tone"), list(CHAPTER), "left")
    resolved = cast.resolve_lines(lines, config.overrides(spark, s.cast), config.voice_config(spark, s.voices), "tone" if s.narrator_tone else None)
    return chunk.merge_chunks(resolved, F.concat(F.lit(f"{s.audio}/"), F.col("book_id")))


def run(spark: SparkSession, s: Settings) -> DataFrame | None:
    """book_id, chapter_number, path and n_samples of every chapter written; None if speech is skipped."""
    # one form of paths, for files are told by them
    s = replace(s, work=config.canonical(spark, s.work), output=config.canonical(spark, s.output))
    folder = f"{s.work}/runs/{uuid.uuid4().hex}"
    try:
        return _run(spark, s, folder)
    finally:
        config.remove(spark, folder)


def _run(spark: SparkSession, s: Settings, folder: str) -> DataFrame | None:
    books = prepare(spark, s, folder)
    # one row for each book
    for r in resume.run_summary(books.every, books.finished).orderBy("book_id").toLocalIterator():
        s.say(f"{r['book_id']}: {r['total']} chapters, {r['skipped']} of them finished before")
    annotations, tones = annotated(spark, s, books, folder)
    if s.skip_tts:
        return None
    chunks = _settled(chunks_of(spark, s, annotations, tones), f"{folder}/chunks")
    jobs = _settled(resume.pending_jobs(chunks, audio.existing(spark, s.audio)), f"{folder}/jobs")
    total = resume.job_totals(chunks, jobs).agg(F.sum("n_chunks").alias("chunks"), F.sum("n_jobs").alias("jobs")).first()
    s.say(f"chunks: {total['chunks'] or 0}, {total['jobs'] or 0} of them to synthesize")
    synth.synthesize(jobs, s.voice, s.workers).write.format("noop").mode("overwrite").save()
    named = books.chapters.withColumn("filename", X.chapter_filename("chapter_number", "title")).select(*CHAPTER, "filename")
    written = assemble.assemble_chapters(named.join(chunks.select(*CHAPTER, "chunk_idx", "audio_path"), list(CHAPTER), "left"), s.output)
    # written once, and read as often as the caller likes
    report = _settled(written, f"{s.work}/reports/{uuid.uuid4().hex}")
    s.say(f"chapters written: {report.count()}")
    return report
