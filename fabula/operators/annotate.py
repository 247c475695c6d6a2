"""Attribution of passages to speakers, behind a provider.

A provider turns one passage, the roster so far and the line before it into
lines.  Passages of a chapter depend on each other and run in order in one task;
chapters run in parallel.  Where lines exist already, context and roster are
plain windows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DASH
from ..schemas import LINES, ROSTER

CHAPTER = ("book_id", "chapter_number")
FIELDS = ("speaker", "is_narrator", "speaker_gender", "speaker_is_child", "text", "instruct")
GENDERS = ("male", "female")
ATTEMPTS = 2


class AnnotationError(Exception):
    pass


class Provider(Protocol):
    name: str  # caches are kept apart by it

    def annotate(self, text: str, roster: list[str], preceding: str | None) -> dict: ...

    def tone(self, sample: str) -> str: ...


def check_annotation(answer: dict) -> list[dict]:
    """The lines of a provider's answer, or AnnotationError: at least one, each with all fields and a known gender."""
    lines = answer.get("lines") if isinstance(answer, dict) else None
    if not isinstance(lines, list) or not lines:
        raise AnnotationError("an annotation needs a non-empty list of lines")
    for line in lines:
        if missing := [f for f in FIELDS if f not in line]:
            raise AnnotationError(f"a line lacks {', '.join(missing)}: {line}")
        if line["speaker_gender"] not in GENDERS:
            raise AnnotationError(f"unknown gender: {line}")
    return lines


def _try(call: Callable[[], object], what: str) -> object:
    error: Exception | None = None
    for _ in range(ATTEMPTS):
        try:
            return call()
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is tried once more
            error = e
    raise AnnotationError(f"{what} failed {ATTEMPTS} times: {error}") from error


def annotate_one(provider: Provider, text: str, roster: list[str], preceding: str | None) -> list[dict]:
    return _try(lambda: check_annotation(provider.annotate(text, list(roster), preceding)), "annotation")


def guess_tone(provider: Provider, sample: str) -> str:
    def call() -> str:
        tone = provider.tone(sample)
        if not tone:
            raise AnnotationError("an empty tone")
        return tone

    return _try(call, "tone guess")


class RuleProvider:
    """A deterministic stand-in for a language model: dialogue goes to speakers by a rule, with no claim to quality."""

    name = "rule"
    names = ("Marc", "Léa", "Jean", "Cosette")

    def annotate(self, text: str, roster: list[str], preceding: str | None) -> dict:
        parts = [p.strip() for p in re.split(f"(?={DASH})", text) if p.strip()]
        lines = []
        for part in parts:
            if part.startswith(DASH):
                name = self.names[len(part) % len(self.names)]
                lines.append({"speaker": name, "is_narrator": False, "speaker_gender": "female" if name in ("Léa", "Cosette") else "male", "speaker_is_child": name == "Cosette", "text": part, "instruct": "Speak plainly."})
            else:
                lines.append(dict(zip(FIELDS, ("Narrator", True, "male", False, part, None), strict=True)))
        return {"lines": lines}

    def tone(self, sample: str) -> str:
        return "Read calmly." if len(sample) % 2 else "Read briskly."


def narrator_line(text: str | Column = "text") -> Column:
    """The one line of a passage without dialogue."""
    t = F.col(text) if isinstance(text, str) else text
    values = (F.lit("Narrator"), F.lit(True), F.lit("male"), F.lit(False), t, F.lit(None).cast("string"))
    return F.array(F.struct(*(v.alias(f) for f, v in zip(FIELDS, values, strict=True))))


_ANNOTATED = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("chapter_number", T.IntegerType()), T.StructField("passage_idx", T.IntegerType()), T.StructField("text_hash", T.StringType()), T.StructField("lines", LINES), T.StructField("roster", ROSTER), T.StructField("error", T.StringType())])


def annotate_chapters(checked: DataFrame, provider: Provider) -> DataFrame:
    """lines and roster of every passage: from the cache up to the first pending passage, from then on anew.

    checked has the columns of resume.with_cache.  A passage that a provider fails at (ATTEMPTS
    times, all in all) has its message in `error` and no lines, and its chapter ends
    there; as this is no failure of a task, Spark doesn't ask again, and what was
    annotated before it can be kept.
    """

    def chapter(passages: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        roster: list[str] = []
        preceding: str | None = None
        stale = False
        out = []
        for p in sorted(passages.to_pylist(), key=lambda p: p["passage_idx"]):
            stale = stale or not p["valid"]
            lines, error = p["lines"], None
            if not stale:
                roster = p["roster"] if p["roster"] is not None else roster
            else:
                try:
                    lines = annotate_one(provider, p["text"], roster, preceding) if p["has_dialogue"] else [dict(zip(FIELDS, ("Narrator", True, "male", False, p["text"], None), strict=True))]
                    roster = list(dict.fromkeys([*roster, *(x["speaker"] for x in lines)]))
                except AnnotationError as e:
                    lines, error = None, str(e)
            out.append({k: p[k] for k in ("book_id", "chapter_number", "passage_idx", "text_hash")} | {"lines": lines, "roster": None if error else roster, "error": error})
            if error:
                break
            preceding = lines[-1]["text"]
        return pa.Table.from_pylist(out, schema=to_arrow_schema(_ANNOTATED))

    ready = checked.select(F.col("book_id").cast("string"), F.col("chapter_number").cast("int"), F.col("passage_idx").cast("int"), "text", "has_dialogue", "text_hash", "valid", "lines", "roster")
    return ready.groupBy(*CHAPTER).applyInArrow(chapter, _ANNOTATED)


def tones(samples: DataFrame, cache: DataFrame, provider: Provider) -> DataFrame:
    """book_id, chapter_number and instruct: the cached tone where there is one, else the provider's; and its message in `error` where that failed."""

    def guess(sample: str) -> tuple[str | None, str | None]:
        try:
            return guess_tone(provider, sample), None
        except AnnotationError as e:
            return None, str(e)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [guess(s) for s in part["sample"]]
            yield part.assign(instruct=[t for t, _ in found], error=[e for _, e in found]).drop(columns="sample")

    todo = samples.join(cache, list(CHAPTER), "left_anti").select(*CHAPTER, "sample")
    asked = todo.mapInPandas(ask, T.StructType([*(todo.schema[c] for c in CHAPTER), T.StructField("instruct", T.StringType()), T.StructField("error", T.StringType())]))
    return cache.join(samples, list(CHAPTER), "left_semi").select(*CHAPTER, "instruct", F.lit(None).cast("string").alias("error")).unionByName(asked)


def exploded_lines(annotated: DataFrame) -> DataFrame:
    """One row for each line: passage keys, line_in_passage, line_idx (in its chapter) and the line's fields."""
    rows = annotated.select(*CHAPTER, "passage_idx", F.posexplode("lines").alias("line_in_passage", "l")).select(*CHAPTER, "passage_idx", "line_in_passage", "l.*")
    place = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("passage_idx", "line_in_passage")) - 1
    return rows.withColumn("line_idx", place.cast("int"))


def preceding_line(keys: tuple[str, ...] = CHAPTER, order: str = "passage_idx", last_text: str = "last_text") -> Column:
    """The last line of the passage before."""
    return F.lag(last_text).over(Window.partitionBy(*keys).orderBy(order))


def running_roster(lines: DataFrame, keys: tuple[str, ...], order: str, speaker: str = "speaker", name: str = "roster") -> DataFrame:
    """lines with the different speakers up to each, in order of their first line.

    Only a speaker's first line adds to what is collected, so a frame holds the roster and no more.
    """
    first = F.row_number().over(Window.partitionBy(*keys, speaker).orderBy(order)) == 1
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__new", F.when(first, F.col(speaker)))
    return marked.withColumn(name, F.collect_list("__new").over(upto)).drop("__new")


def answer_problem(answer: Column | str) -> Column:
    """What is wrong with an answer in JSON (as in check_annotation), null if nothing is."""
    loose = F.from_json(F.col(answer) if isinstance(answer, str) else answer, "lines array<map<string,string>>")["lines"]
    lacks = F.exists(loose, lambda x: x.isNull() | ~F.coalesce(F.forall(F.array(*map(F.lit, FIELDS)), lambda f: F.map_contains_key(x, f)), F.lit(False)))
    gender = F.exists(loose, lambda x: ~F.coalesce(x["speaker_gender"].isin(*GENDERS), F.lit(False)))
    return F.when(F.coalesce(F.size(loose), F.lit(0)) < 1, "no lines").when(F.coalesce(lacks, F.lit(True)), "a field is missing").when(gender, "unknown gender")


def parse_answer(answer: Column | str) -> Column:
    """Lines of an answer in JSON; an answer that doesn't hold fails the query."""
    parsed = F.from_json(F.col(answer) if isinstance(answer, str) else answer, T.StructType([T.StructField("lines", LINES)]))["lines"]
    return F.when(answer_problem(answer).isNull(), parsed).otherwise(F.raise_error(F.lit("an annotation doesn't hold")).cast(LINES))


def to_answer(lines: list[dict]) -> str:
    return json.dumps({"lines": lines}, ensure_ascii=False)
