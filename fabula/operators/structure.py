"""Chapters and passages from a book's elements.

A book with chapter sections is read by them; any other by pairs of an h2 that is
a chapter heading and an h3 right after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ELEMENT_TAGS = (*HEADINGS, "p")


def by_sections(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters (book_id, chapter_number, heading, title) and body passages (…, body_idx, text, has_dialogue) of books with chapter sections."""
    inside = elements.where(F.col("kind") == "section")
    numbered = inside.withColumn("chapter_number", F.dense_rank().over(Window.partitionBy("book_id").orderBy("spine_idx", "section_idx")))
    is_heading = F.col("tag").isin(*HEADINGS)
    place = F.row_number().over(Window.partitionBy("book_id", "chapter_number", is_heading).orderBy("el_idx"))
    marked = numbered.withColumn("__place", F.when(is_heading, place)).withColumn("__text", X.normalize("raw_text"))
    named = lambda n: F.coalesce(F.max(F.when(F.col("__place") == n, F.col("__text"))), F.lit(""))
    chapters = marked.groupBy("book_id", "chapter_number").agg(named(1).alias("heading"), named(2).alias("title"))
    return chapters, _body(numbered.where(F.col("tag") == "p"), "el_idx")


def by_heading_pairs(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of books without: what stands before the first pair is left out, other headings are passages."""
    order = Window.partitionBy("book_id").orderBy("manifest_idx", "el_idx")
    body = elements.where((F.col("kind") == "body") & F.col("tag").isin(*ELEMENT_TAGS))
    ahead = body.select("*", F.lead("tag").over(order).alias("__next_tag"), F.lead("raw_text").over(order).alias("__next_text"))
    starts = (F.col("tag") == "h2") & X.is_chapter_heading("raw_text") & (F.coalesce(F.col("__next_tag"), F.lit("")) == "h3")
    marked = ahead.withColumn("__starts", starts)
    # the pair's own elements are no passages
    marked = marked.withColumn("chapter_number", F.sum(F.col("__starts").cast("int")).over(order).cast("int")).withColumn("__title", F.coalesce(F.lag("__starts").over(order), F.lit(False)))
    chapters = marked.where("__starts").select("book_id", "chapter_number", X.strip("raw_text").alias("heading"), X.strip("__next_text").alias("title"))
    rest = marked.where(~F.col("__starts") & ~F.col("__title") & (F.col("chapter_number") > 0))
    return chapters, _body(rest.select("book_id", "chapter_number", "manifest_idx", "el_idx", "raw_text"), "manifest_idx", "el_idx")


def _body(elements: DataFrame, *order: str) -> DataFrame:
    texts = elements.withColumn("text", X.normalize("raw_text")).withColumn("has_dialogue", X.has_dialogue("raw_text")).where(F.col("text") != "")
    place = F.row_number().over(Window.partitionBy("book_id", "chapter_number").orderBy(*order)) - 1
    return texts.withColumn("body_idx", place).select("book_id", "chapter_number", "body_idx", "text", "has_dialogue")


def read_structure(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters and body passages of all books, each by its own convention.

    `elements` is read several times: where parsing made it, give it settled or persisted.
    """
    kind = F.max((F.col("kind") == "section").cast("int")).over(Window.partitionBy("book_id"))
    known = elements.withColumn("__sections", kind)
    parts = [by_sections(known.where("__sections = 1")), by_heading_pairs(known.where("__sections = 0"))]
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


def narration_passages(chapters: DataFrame, body: DataFrame) -> DataFrame:
    """Everything that is narrated, in order: heading, title if there is one, body; headings and titles are never dialogue."""
    heads = chapters.select(
        "book_id", "chapter_number",
        F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("heading").alias("text")), F.struct(F.lit(1).alias("part"), F.col("title").alias("text")))).alias("e"),
    ).select("book_id", "chapter_number", F.col("e.part").alias("part"), F.lit(0).alias("at"), F.col("e.text").alias("text"), F.lit(False).alias("has_dialogue")).where((F.col("part") == 0) | (F.col("text") != ""))
    every = heads.unionByName(body.select("book_id", "chapter_number", F.lit(2).alias("part"), F.col("body_idx").alias("at"), "text", "has_dialogue"))
    place = (F.row_number().over(Window.partitionBy("book_id", "chapter_number").orderBy("part", "at")) - 1).cast("int")
    return every.select("book_id", "chapter_number", place.alias("passage_idx"), F.element_at(F.array(F.lit("heading"), F.lit("title"), F.lit("body")), F.col("part") + 1).alias("part"), "text", "has_dialogue")


def count_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters"))


def choose_chapters(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (book_id, chapter_number) with heading and title, and a problem where the book hasn't so many chapters."""
    found = wanted.join(count_chapters(chapters), "book_id", "left").join(chapters, ["book_id", "chapter_number"], "left")
    n = F.coalesce("n_chapters", F.lit(0))
    there = (F.col("chapter_number") >= 1) & (F.col("chapter_number") <= n)
    problem = F.when(~there, F.concat_ws("", F.lit("chapter "), F.col("chapter_number").cast("string"), F.lit(" not found; "), n.cast("string"), F.lit(" chapter boundaries detected")))
    return found.select("book_id", "chapter_number", "heading", "title", problem.alias("problem"))


def one_chapter(chapters: DataFrame, number: int) -> DataFrame:
    """That chapter of every book; ValueError if one hasn't so many."""
    wanted = chapters.select("book_id").distinct().withColumn("chapter_number", F.lit(number))
    chosen = choose_chapters(chapters, wanted)
    if problems := chosen.where("problem is not null").orderBy("book_id").limit(1).collect():
        raise ValueError(f"{problems[0]['problem']} in {problems[0]['book_id']}")
    return chosen.drop("problem")


TONE_PASSAGES, TONE_CHARS = 5, 800


def tone_samples(chapters: DataFrame, body: DataFrame) -> DataFrame:
    """Each chapter's heading, title and first passages, cut to TONE_CHARS, one a line; an empty title has its line."""
    first = body.where(F.col("body_idx") < TONE_PASSAGES).withColumn("__cut", F.substring("text", 1, TONE_CHARS))
    opening = first.groupBy("book_id", "chapter_number").agg(F.expr("listagg(__cut, '\n') within group (order by body_idx)").alias("__opening"))
    return chapters.join(opening, ["book_id", "chapter_number"], "left").select("book_id", "chapter_number", F.concat_ws("\n", "heading", "title", "__opening").alias("sample"))
