"""Schemas of the engine's tables.  Order is never implicit: every table has ordinals."""

from __future__ import annotations

from pyspark.sql import types as T

LINE = T.StructType([
    T.StructField("speaker", T.StringType()),
    T.StructField("is_narrator", T.BooleanType()),
    T.StructField("speaker_gender", T.StringType()),
    T.StructField("speaker_is_child", T.BooleanType()),
    T.StructField("text", T.StringType()),
    T.StructField("instruct", T.StringType()),
])
LINES = T.ArrayType(LINE)
ROSTER = T.ArrayType(T.StringType())

#: kind: `body` (a heading or paragraph below <body>) or `section` (one inside a chapter section; tag is null for the section itself).
ELEMENTS = T.StructType([
    T.StructField("book_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("spine_idx", T.IntegerType()),
    T.StructField("manifest_idx", T.IntegerType()),
    T.StructField("section_idx", T.IntegerType()),
    T.StructField("el_idx", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("raw_text", T.StringType()),
])

ANNOTATION_CACHE = T.StructType([
    T.StructField("book_id", T.StringType()),
    T.StructField("chapter_number", T.IntegerType()),
    T.StructField("passage_idx", T.IntegerType()),
    T.StructField("text_hash", T.StringType()),
    T.StructField("lines", LINES),
    T.StructField("roster", ROSTER),
])
TONE_CACHE = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("chapter_number", T.IntegerType()), T.StructField("instruct", T.StringType())])
