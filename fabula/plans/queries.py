"""The engine's operators as queries over the test tables, and the same in SQL.

Test tables hold no books, so queries derive what they need by rule: documents are
chapters, their lines passages; a dash before some lines makes dialogue of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotate, assemble, cast, chunk, resume, structure, synth
from ..sources import audio, cache, config, epub

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _WITH + sql
        return f

    return add


# ---- shared derivations: documents as chapters of lines ---------------------------

# In the regular expressions of DuckDB. Fixed values as in functions.text.
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORM = f"trim(regexp_replace(raw, '{_S}+', ' ', 'g'))"
_END = r"regexp_matches(rs, '[!-/:-@\[-`{-~…»]$')"

_WITH = f"""
WITH raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
), marked AS (
  SELECT doc_id, pos, CASE WHEN length(line) % 4 = 0 THEN chr(160) || '— ' || line WHEN length(line) % 4 = 1 THEN line || chr(10) || chr(8239) || '—' || line ELSE chr(9) || line || chr(8239) END AS raw
  FROM raw_lines
), passages AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS passage_idx, text, has_dialogue
  FROM (SELECT doc_id, pos, {_NORM} AS text, regexp_matches(raw, '(^|\n){_S}*—') AS has_dialogue FROM marked) WHERE text <> ''
), spoken AS (
  SELECT doc_id, passage_idx AS line_idx, text, length(text) % 3 <> 0 AS is_narrator,
    CASE WHEN length(text) % 2 = 0 THEN 'male' ELSE 'female' END AS speaker_gender, length(text) % 5 = 0 AS speaker_is_child,
    CASE WHEN length(text) % 3 <> 0 THEN 'Narrator' ELSE 'S' || (length(text) % 7) END AS speaker,
    CASE WHEN length(text) % 4 = 0 THEN NULL ELSE 'tone ' || (length(text) % 3) END AS own
  FROM passages
), resolved AS (
  SELECT doc_id, line_idx, text, is_narrator,
    CASE WHEN is_narrator THEN 'narrator' WHEN speaker_is_child THEN 'child' WHEN speaker_gender = 'male' THEN 'adult_male' ELSE 'adult_female' END AS role,
    CASE speaker WHEN 'S3' THEN 'Aiden' WHEN 'S6' THEN 'Dylan' ELSE CASE WHEN is_narrator THEN 'Ryan' WHEN speaker_is_child THEN 'Vivian' WHEN speaker_gender = 'male' THEN 'Ryan' ELSE 'Serena' END END AS voice,
    CASE WHEN is_narrator THEN CASE WHEN line_idx % 2 = 0 THEN 'calm' ELSE NULL END ELSE own END AS instruct
  FROM spoken
), ended AS (
  SELECT *, CASE WHEN rs = '' OR {_END} THEN rs ELSE rs || '.' END AS segment, sum(CASE WHEN is_narrator THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS run
  FROM (SELECT *, regexp_replace(text, '{_S}+$', '') AS rs FROM resolved)
), merged AS (
  SELECT doc_id, run, is_narrator, min(line_idx) AS first_line, string_agg(segment, ' ' ORDER BY line_idx) AS text, arg_max_null(voice, line_idx) AS voice, arg_max_null(instruct, line_idx) AS instruct, arg_max_null(role, line_idx) AS role, count(*) AS n_lines
  FROM ended GROUP BY doc_id, run, is_narrator
), chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS chunk_idx, text, is_narrator, voice, instruct, role, n_lines,
    sha256(text || chr(0) || voice || chr(0) || coalesce(instruct, '') || chr(0) || CASE WHEN is_narrator THEN '1' ELSE '0' END) AS content_hash
  FROM merged
), pathed AS (
  SELECT *, 'audio_cache/book/chapter_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(2, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '/chunk_' || role || '_' || content_hash || '.wav' AS audio_path FROM chunks
), elements AS (
  SELECT doc_id, pos, line AS body, CASE WHEN pos % 5 = 0 THEN 'h2' WHEN pos % 5 = 1 AND length(line) % 3 <> 0 THEN 'h3' WHEN pos % 5 = 3 THEN 'h4' ELSE 'p' END AS tag,
    CASE WHEN pos % 5 = 0 THEN CASE WHEN length(line) % 4 <> 0 THEN chr(160) || 'CHAPITRE dixième' || CAST(pos // 5 + 1 AS VARCHAR) || ' ' ELSE 'Livre ' || CAST(pos AS VARCHAR) END WHEN pos % 5 = 1 AND length(line) % 6 = 1 THEN ' ' ELSE line END AS raw
  FROM raw_lines
), ahead AS (
  SELECT *, tag = 'h2' AND regexp_full_match(regexp_replace(raw, '^{_S}+|{_S}+$', '', 'g'), '(?i)chapitre [\\p{{L}}\\p{{N}}_]+') AND coalesce(lead(tag) OVER w, '') = 'h3' AS starts, lead(raw) OVER w AS next_raw
  FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w AS chapter_number, coalesce(lag(starts) OVER w, false) AS is_title
  FROM ahead WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), chapters AS (
  SELECT doc_id, chapter_number, regexp_replace(raw, '^{_S}+|{_S}+$', '', 'g') AS heading, regexp_replace(next_raw, '^{_S}+|{_S}+$', '', 'g') AS title FROM numbered WHERE starts
), body AS (
  SELECT doc_id, chapter_number, row_number() OVER (PARTITION BY doc_id, chapter_number ORDER BY pos) - 1 AS body_idx, text
  FROM (SELECT doc_id, chapter_number, pos, {_NORM} AS text FROM numbered WHERE NOT starts AND NOT is_title AND chapter_number > 0) WHERE text <> ''
), narrated AS (
  SELECT doc_id, chapter_number, row_number() OVER (PARTITION BY doc_id, chapter_number ORDER BY part, place) - 1 AS passage_idx, part, text
  FROM (SELECT doc_id, chapter_number, 0 AS part, 0 AS place, heading AS text FROM chapters
    UNION ALL SELECT doc_id, chapter_number, 1, 0, title FROM chapters WHERE title <> ''
    UNION ALL SELECT doc_id, chapter_number, 2, body_idx, text FROM body)
), cached AS (
  SELECT doc_id, passage_idx, sha256(CASE WHEN length(text) % 17 = 0 THEN text || '!' ELSE text END) AS old_hash, length(text) % 23 <> 0 AS has_lines FROM passages WHERE length(text) % 29 <> 0
), checked AS (
  SELECT p.doc_id, p.passage_idx, coalesce(sha256(p.text) = c.old_hash AND c.has_lines, false) AS valid FROM passages p LEFT JOIN cached c USING (doc_id, passage_idx)
), pending AS (
  SELECT doc_id, min(CASE WHEN NOT valid THEN passage_idx END) AS first_pending, count(*) AS n_passages FROM checked GROUP BY doc_id
)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, which are chapters of one book.  Documents are dealt out before they become
    lines: less is shuffled, and all that goes by chapter from here on needs no other shuffle."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("book").alias("book_id"), F.col("doc_id").cast("int").alias("chapter_number")).repartition(tasks, "chapter_number")
    return docs.select("doc_id", "book_id", "chapter_number", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("line") % 4
    thin = F.lit(chr(8239))
    raw = F.when(n == 0, F.concat(F.lit(chr(160) + "— "), "line")).when(n == 1, F.concat("line", F.lit("\n"), thin, F.lit("—"), "line")).otherwise(F.concat(F.lit("\t"), "line", thin))
    return _raw_lines(spark, sf_dir).select("doc_id", "book_id", "chapter_number", "pos", raw.alias("raw"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _marked(spark, sf_dir).select("doc_id", "book_id", "chapter_number", "pos", X.normalize("raw").alias("text"), X.has_dialogue("raw").alias("has_dialogue")).where(F.col("text") != "")
    return texts.withColumn("passage_idx", F.row_number().over(Window.partitionBy("chapter_number").orderBy("pos")) - 1)


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return _passages(spark, sf_dir).select(
        "doc_id", "book_id", "chapter_number", F.col("passage_idx").alias("line_idx"), "text", (n % 3 != 0).alias("is_narrator"), F.when(n % 2 == 0, "male").otherwise("female").alias("speaker_gender"), (n % 5 == 0).alias("speaker_is_child"),
        F.when(n % 3 != 0, "Narrator").otherwise(F.concat(F.lit("S"), (n % 7).cast("string"))).alias("speaker"),
        F.when(n % 4 == 0, None).otherwise(F.concat(F.lit("tone "), (n % 3).cast("string"))).alias("instruct"),
        F.when((F.col("passage_idx") % 2) == 0, "calm").alias("tone"),
    )


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = spark.createDataFrame([("S3", "Aiden"), ("S6", "Dylan")], "speaker string, voice string")
    return cast.resolve_lines(_spoken(spark, sf_dir), pinned)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.merge_chunks(_resolved(spark, sf_dir), "audio_cache/book").withColumn("doc_id", F.col("chapter_number").cast("long"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = F.length("line"), F.col("pos")
    tag = F.when(at % 5 == 0, "h2").when((at % 5 == 1) & (n % 3 != 0), "h3").when(at % 5 == 3, "h4").otherwise("p")
    heading = F.when(n % 4 != 0, F.concat(F.lit(chr(160) + "CHAPITRE dixième"), (F.floor(at / 5) + 1).cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("Livre "), at.cast("string")))
    raw = F.when(at % 5 == 0, heading).when((at % 5 == 1) & (n % 6 == 1), " ").otherwise(F.col("line"))
    return _raw_lines(spark, sf_dir).select(F.col("chapter_number").alias("book_id"), F.lit("body").alias("kind"), F.lit(0).alias("spine_idx"), F.lit(0).alias("manifest_idx"), F.lit(None).cast("int").alias("section_idx"), at.alias("el_idx"), tag.alias("tag"), raw.alias("raw_text"))


def _structure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chapters, body = structure.by_heading_pairs(_elements(spark, sf_dir))
    return tuple(d.withColumn("book_id", F.col("book_id").cast("long")) for d in (chapters, body))


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    old = F.when(n % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    lines = F.when(n % 23 != 0, annotate.narrator_line()).otherwise(F.slice(annotate.narrator_line(), 1, 0))
    rows = _passages(spark, sf_dir).where(n % 29 != 0)
    return rows.select("book_id", "chapter_number", "passage_idx", X.passage_hash(old).alias("text_hash"), lines.alias("lines"), F.array(F.lit("Narrator"), F.concat(F.lit("S"), (n % 7).cast("string"))).alias("roster"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.with_cache(_passages(spark, sf_dir), _cached(spark, sf_dir))


def _doc(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("chapter_number").cast("long").alias("doc_id"), *columns)


# ---- queries ----------------------------------------------------------------------


@query("SELECT doc_id, CAST(passage_idx AS INTEGER) AS passage_idx, text FROM passages")
def normalize_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", "passage_idx", "text")


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_matches(raw, '(^|\\n){_S}*—') AS has_dialogue FROM marked")
def dialogue_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", "pos", X.has_dialogue("raw").alias("has_dialogue"))


@query("SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, segment FROM ended")
def sentence_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", F.col("passage_idx").alias("line_idx"), X.sentence_end("text").alias("segment"))


@query("SELECT doc_id, CAST(passage_idx AS INTEGER) AS passage_idx, sha256(text) AS text_hash FROM passages")
def passage_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("doc_id", "passage_idx", X.passage_hash("text").alias("text_hash"))


@query("SELECT doc_id, CAST(pos AS INTEGER) AS pos, starts FROM ahead")
def heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("book_id").orderBy("el_idx")
    starts = (F.col("tag") == "h2") & X.is_chapter_heading("raw_text") & (F.coalesce(F.lead("tag").over(order), F.lit("")) == "h3")
    return _elements(spark, sf_dir).select(F.col("book_id").cast("long").alias("doc_id"), F.col("el_idx").alias("pos"), starts.alias("starts"))


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 'narrator' WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'child' ELSE 'adult_female' END ELSE CASE WHEN turn % 4 = 1 THEN 'child' ELSE 'adult_male' END END AS role_name, CASE WHEN role = 'assistant' THEN 'Aiden' WHEN role = 'system' THEN 'Ryan' WHEN turn % 4 = 1 THEN 'Vivian' ELSE 'Ryan' END AS voice FROM conversations")
def role_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("speaker"), (F.col("role") == "system").alias("is_narrator"), F.when(F.col("role") == "assistant", "female").otherwise("male").alias("speaker_gender"),
        F.when(F.col("role") == "assistant", F.col("turn") % 3 == 0).otherwise(F.col("turn") % 4 == 1).alias("speaker_is_child"),
    )
    pinned = spark.createDataFrame([("assistant", "Aiden")], "speaker string, voice string")
    return cast.assign_voices(rows, pinned).select("conv_id", "turn", F.col("role").alias("role_name"), "voice")


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS preceding, CASE WHEN coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') = '' THEN text ELSE 'Immediately preceding line (for tone/situation only):' || chr(10) || lag(text) OVER (PARTITION BY conv_id ORDER BY turn) || chr(10) || chr(10) || 'Passage to annotate:' || chr(10) || text END AS message FROM conversations")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").withColumn("preceding", annotate.preceding_line(("conv_id",), "turn", "text"))
    return rows.select("conv_id", "turn", "preceding", X.user_message("text", "preceding").alias("message"))


@query("""SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, string_agg(speaker, ', ' ORDER BY f) AS roster FROM (
  SELECT a.doc_id, a.line_idx, b.speaker, min(b.line_idx) AS f FROM spoken a JOIN (SELECT doc_id, speaker, min(line_idx) AS line_idx FROM spoken GROUP BY ALL) b ON a.doc_id = b.doc_id AND b.line_idx <= a.line_idx GROUP BY ALL) GROUP BY doc_id, line_idx""")
def running_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.running_roster(_spoken(spark, sf_dir), ("chapter_number",), "line_idx").select("doc_id", "line_idx", X.roster_text("roster").alias("roster"))


@query("SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, role, voice, instruct FROM resolved")
def resolve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("doc_id", "line_idx", "role", "voice", "instruct")


@query("SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, text, is_narrator, voice, instruct, role, n_lines, content_hash FROM chunks")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_idx", "text", "is_narrator", "voice", "instruct", "role", "n_lines", "content_hash")


@query("SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, audio_path, CASE WHEN is_narrator THEN 'Qwen/Qwen3-TTS-12Hz-0.6B-CustomVoice' ELSE 'Qwen/Qwen3-TTS-12Hz-1.7B-CustomVoice' END AS model_id FROM pathed")
def chunk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_idx", "audio_path", cast.model_id().alias("model_id"))


@query("SELECT doc_id, CAST(chapter_number AS INTEGER) AS chapter_number, heading, title FROM chapters")
def chapter_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir)[0].select(F.col("book_id").alias("doc_id"), "chapter_number", "heading", "title")


@query("SELECT doc_id, count(*) AS n_chapters FROM chapters GROUP BY doc_id")
def chapter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.count_chapters(_structure(spark, sf_dir)[0]).withColumnRenamed("book_id", "doc_id")


@query("SELECT doc_id, CAST(chapter_number AS INTEGER) AS chapter_number, CAST(passage_idx AS INTEGER) AS passage_idx, CASE part WHEN 0 THEN 'heading' WHEN 1 THEN 'title' ELSE 'body' END AS part, text FROM narrated")
def narration_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.narration_passages(*_structure(spark, sf_dir)).select(F.col("book_id").alias("doc_id"), "chapter_number", "passage_idx", "part", "text")


@query("SELECT c.doc_id, CAST(c.chapter_number AS INTEGER) AS chapter_number, heading || chr(10) || title || coalesce(chr(10) || opening, '') AS sample FROM chapters c LEFT JOIN (SELECT doc_id, chapter_number, string_agg(substr(text, 1, 800), chr(10) ORDER BY body_idx) AS opening FROM body WHERE body_idx < 5 GROUP BY ALL) b USING (doc_id, chapter_number)")
def tone_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.tone_samples(*_structure(spark, sf_dir)).withColumnRenamed("book_id", "doc_id")


@query("SELECT doc_id, CAST(first_pending AS INTEGER) AS first_pending, n_passages FROM pending")
def first_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(resume.first_pending(_checked(spark, sf_dir)), "first_pending", "n_passages")


@query("SELECT doc_id, CAST(passage_idx AS INTEGER) AS passage_idx FROM cached JOIN pending USING (doc_id) WHERE first_pending IS NULL OR passage_idx < first_pending")
def invalidated_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(resume.invalidate(_cached(spark, sf_dir), resume.first_pending(_checked(spark, sf_dir))), "passage_idx")


@query("SELECT p.doc_id, CASE WHEN c.doc_id IS NULL THEN '(none yet)' ELSE 'Narrator, S' || (length(t.text) % 7) END AS roster FROM pending p LEFT JOIN cached c ON c.doc_id = p.doc_id AND c.passage_idx = coalesce(first_pending, n_passages) - 1 LEFT JOIN passages t ON t.doc_id = c.doc_id AND t.passage_idx = c.passage_idx")
def roster_at_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resume.roster_at_resume(_cached(spark, sf_dir), resume.first_pending(_checked(spark, sf_dir)))
    return _doc(found.withColumn("roster", X.roster_text("roster")), "roster")


@query("SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY audio_path ORDER BY doc_id, chunk_idx) AS n FROM pathed WHERE ascii(content_hash) % 3 <> 0) WHERE n = 1")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    existing = chunks.where(F.ascii("content_hash") % 3 == 0).select("audio_path")
    return resume.pending_jobs(chunks, existing).select("doc_id", "chunk_idx", "content_hash")


@query("SELECT doc_id, CAST(chapter_number AS INTEGER) AS chapter_number, title FROM chapters WHERE chapter_number % 2 = 1")
def chapters_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _structure(spark, sf_dir)[0]
    done = chapters.where(F.col("chapter_number") % 2 == 0).select("book_id", X.chapter_filename("chapter_number", "title").alias("filename"))
    return resume.chapters_to_do(chapters, done).select(F.col("book_id").alias("doc_id"), "chapter_number", "title")


@query("SELECT doc_id, count(*) FILTER (WHERE chapter_number % 2 = 1) AS completed, count(*) FILTER (WHERE chapter_number % 2 = 0) AS skipped, count(*) AS total FROM chapters GROUP BY doc_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _structure(spark, sf_dir)[0]
    done = chapters.where(F.col("chapter_number") % 2 == 0).select("book_id", X.chapter_filename("chapter_number", "title").alias("filename"))
    return resume.run_summary(chapters, done).withColumnRenamed("book_id", "doc_id")


@query("SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, n_samples, start_sample, start_sample + n_samples AS end_sample FROM (SELECT *, CAST(coalesce(sum(n_samples + 16800) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sample FROM (SELECT doc_id, chunk_idx, 240 * length(text) AS n_samples FROM chunks))")
def assembly_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _chunks(spark, sf_dir).withColumn("n_samples", (F.length("text") * 240).cast("long"))
    return assemble.timeline(sized).select("doc_id", "chunk_idx", "n_samples", "start_sample", "end_sample")


# Without accents and then without all that isn't ASCII: the same as compatibility decomposition for first lines
# without ligatures, fractions and the like; tests hold the operator itself against Python on these too.
@query("SELECT doc_id, 'chapitre_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(2, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '_' || lower(trim(regexp_replace(regexp_replace(strip_accents(title), '[^\\x00-\\x7f]', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_')) || '.wav' AS filename FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents)")
def title_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.chapter_filename(F.col("doc_id").cast("int"), F.split("text", "\n")[0]).alias("filename"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(\\.*[^.].*)\\.[^.]*$', '\\1')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'book') AS slug FROM pages")
def book_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", X.book_slug("url").alias("slug"))


@query()
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.page_elements(_table(spark, sf_dir, "pages"), "page_id", "html")


def _packed(documents: DataFrame) -> DataFrame:
    """An EPUB for each document: its lines are paragraphs, of two chapter sections for even ids, after a heading pair for odd ones."""
    from html import escape

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                books = []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    lines = [f"<p>{escape(x)}</p>" for x in (text or "").split("\n")]
                    half = (len(lines) + 1) // 2
                    if i % 2:
                        files = [("a.xhtml", f"<html><body><p>before</p><h2>Chapitre I</h2><h3>Un</h3>{''.join(lines[:half])}</body></html>"), ("b.xhtml", f"<html><body>{''.join(lines[half:])}</body></html>")]
                    else:
                        second = "<h2>Partie  double</h2><h3>perdu</h3>" if i % 4 == 0 else ""
                        files = [("0.xhtml", '<html><body><section epub:type="preface"><h1>avant</h1><p>non</p></section></body></html>')]
                        files += [(n, f'<html><body><section epub:type="chapter"><h1> {k}</h1>{second}<div>{"".join(x)}</div></section></body></html>') for k, (n, x) in enumerate((("a.xhtml", lines[:half]), ("b.xhtml", lines[half:])), 1)]
                    books.append(epub.pack_book(str(i), files, "<html><body><nav><h2>Chapitre I</h2><h3>nav</h3></nav></body></html>"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), pa.array(books, pa.binary())], names=["book_id", "content"])

    return documents.select("doc_id", "text").mapInArrow(pack, "book_id string, content binary")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the documents' books, kept, for several branches of a plan read them."""
    return epub.book_elements(_packed(_table(spark, sf_dir, "documents"))).persist()


@query("""SELECT doc_id, CAST(k AS INTEGER) AS chapter_number, CASE WHEN doc_id % 2 = 1 THEN 'Chapitre I' ELSE CAST(k AS VARCHAR) END AS heading, CASE WHEN doc_id % 2 = 1 THEN 'Un' WHEN doc_id % 4 = 0 THEN 'Partie double' ELSE '' END AS title
  FROM documents, (VALUES (1), (2)) AS t(k) WHERE k = 1 OR doc_id % 2 = 0""")
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, _ = structure.read_structure(_parsed(spark, sf_dir))
    return chapters.select(F.col("book_id").cast("long").alias("doc_id"), F.col("chapter_number").cast("int").alias("chapter_number"), "heading", "title")


@query("""SELECT doc_id, CAST(chapter_number AS INTEGER) AS chapter_number, CAST(row_number() OVER (PARTITION BY doc_id, chapter_number ORDER BY pos) - 1 AS INTEGER) AS body_idx, text FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 1 OR pos < (n + 1) // 2 THEN 1 ELSE 2 END AS chapter_number, pos, trim(regexp_replace(line, '""" + _S + """+', ' ', 'g')) AS text
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM raw_lines)) WHERE text <> ''""")
def epub_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, body = structure.read_structure(_parsed(spark, sf_dir))
    return body.select(F.col("book_id").cast("long").alias("doc_id"), F.col("chapter_number").cast("int").alias("chapter_number"), F.col("body_idx").cast("int").alias("body_idx"), "text")


@query("""SELECT doc_id, CAST(passage_idx AS INTEGER) AS passage_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY passage_idx, k) - 1 AS INTEGER) AS line_idx,
    CASE WHEN n = 0 THEN 'Narrator' ELSE ['Marc', 'Léa', 'Jean', 'Cosette'][length(part) % 4 + 1] END AS speaker, n = 0 AS is_narrator, CASE WHEN n > 0 AND length(part) % 2 = 1 THEN 'female' ELSE 'male' END AS speaker_gender,
    n > 0 AND length(part) % 4 = 3 AS speaker_is_child, part AS text, CASE WHEN n > 0 THEN 'Speak plainly.' END AS instruct
  FROM (SELECT doc_id, passage_idx, k, CASE WHEN spoken AND k > 1 THEN 1 ELSE 0 END AS n, trim(CASE WHEN spoken AND k > 1 THEN '—' || piece ELSE piece END) AS part
    FROM (SELECT doc_id, passage_idx, spoken, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
      FROM (SELECT doc_id, passage_idx, has_dialogue AND passage_idx >= first_pending AS spoken, CASE WHEN has_dialogue AND passage_idx >= first_pending THEN string_split(text, '—') ELSE [text] END AS pieces
        FROM (SELECT p.*, coalesce(first_pending, 1000000000) AS first_pending FROM passages p JOIN pending USING (doc_id))))) WHERE part <> ''""")
def annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = annotate.exploded_lines(annotate.annotate_chapters(_checked(spark, sf_dir), annotate.RuleProvider()))
    return _doc(lines, "passage_idx", "line_idx", "speaker", "is_narrator", "speaker_gender", "speaker_is_child", "text", "instruct")


@query("SELECT CAST(c.doc_id AS VARCHAR) AS book_id, CAST(c.chapter_number AS INTEGER) AS chapter_number, CASE WHEN length(sample) % 3 = 0 THEN 'cached' WHEN length(sample) % 2 = 1 THEN 'Read calmly.' ELSE 'Read briskly.' END AS instruct FROM (SELECT c.doc_id, c.chapter_number, heading || chr(10) || title || coalesce(chr(10) || opening, '') AS sample FROM chapters c LEFT JOIN (SELECT doc_id, chapter_number, string_agg(substr(text, 1, 800), chr(10) ORDER BY body_idx) AS opening FROM body WHERE body_idx < 5 GROUP BY ALL) b USING (doc_id, chapter_number)) c")
def chapter_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = structure.tone_samples(*_structure(spark, sf_dir)).select(F.col("book_id").cast("string").alias("book_id"), "chapter_number", "sample")
    cached = samples.where(F.length("sample") % 3 == 0).select("book_id", "chapter_number", F.lit("cached").alias("instruct"))
    return annotate.tones(samples, cached, annotate.RuleProvider()).drop("error")


@query("SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(24000 AS INTEGER) AS sample_rate, CAST(24 * greatest(1, length(text)) AS BIGINT) AS n_samples, CAST(96 * greatest(1, length(text)) AS INTEGER) AS n_bytes FROM chunks")
def chunk_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _chunks(spark, sf_dir).select("doc_id", "chunk_idx", "text", "voice", "instruct", "is_narrator")
    sound = synth.waveforms(jobs, synth.ToneVoice(), ("doc_id", "chunk_idx"))
    return sound.select("doc_id", "chunk_idx", "sample_rate", "n_samples", F.length("samples").alias("n_bytes"))


@query("SELECT c.doc_id, count(*) AS n_chunks, count(DISTINCT CASE WHEN ascii(content_hash) % 3 <> 0 THEN audio_path END) AS n_jobs FROM pathed c GROUP BY c.doc_id")
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    jobs = resume.pending_jobs(chunks, chunks.where(F.ascii("content_hash") % 3 == 0).select("audio_path"))
    return _doc(resume.job_totals(chunks, jobs), "n_chunks", "n_jobs")


@query("""SELECT d.doc_id, d.chapter_number, heading, title, CASE WHEN d.chapter_number > coalesce(n, 0) THEN 'chapter ' || d.chapter_number || ' not found; ' || coalesce(n, 0) || ' chapter boundaries detected' END AS problem
  FROM (SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS chapter_number FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM chapters GROUP BY doc_id) k ON k.doc_id = d.doc_id LEFT JOIN chapters c ON c.doc_id = d.doc_id AND c.chapter_number = d.chapter_number""")
def chosen_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), (1 + F.col("doc_id") % 3).cast("int").alias("chapter_number"))
    return structure.choose_chapters(_structure(spark, sf_dir)[0], wanted).withColumnRenamed("book_id", "doc_id")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN 'N' ELSE 'Ryan' END AS narrator, 'Ryan' AS adult_male, CASE WHEN conv_id % 4 = 1 THEN 'V' || turn ELSE 'Serena' END AS adult_female, CASE WHEN conv_id % 4 <> 3 THEN 'Vivian' END AS child FROM conversations""")
def voice_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("conv_id") % 4
    text = F.when(kind == 0, "{}").when(kind == 1, F.concat(F.lit('{"adult_female": "V'), F.col("turn").cast("string"), F.lit('", "other": "x"}'))).when(kind == 2, "null").otherwise('{"child": null, "narrator": "N"}')
    voices = config.voices_of("config")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("config")).select("conv_id", "turn", *(voices[k].alias(k) for k in cast.DEFAULT_VOICES))


@query("""SELECT conv_id, turn, 'S' || turn AS speaker, 'Aiden' AS voice FROM conversations WHERE conv_id % 3 > 0 UNION ALL SELECT conv_id, turn, 'Narrator', 'Dylan' FROM conversations WHERE conv_id % 3 = 1""")
def cast_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("conv_id") % 3
    text = F.when(kind == 0, "null").otherwise(F.concat(F.lit('{"S'), F.col("turn").cast("string"), F.lit('": "Aiden"'), F.when(kind == 1, ', "Narrator": "Dylan"').otherwise(""), F.lit("}")))
    return config.pinned_of(_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("cast")), "cast", "conv_id", "turn")


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'no lines' WHEN 1 THEN 'no lines' WHEN 2 THEN 'a field is missing' WHEN 3 THEN 'unknown gender' END AS problem FROM conversations""")
def answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("conv_id") + F.col("turn")) % 6
    line = F.struct(F.lit("S").alias("speaker"), F.lit(False).alias("is_narrator"), F.when(kind == 3, "other").otherwise("male").alias("speaker_gender"), F.lit(False).alias("speaker_is_child"), "text", F.lit(None).cast("string").alias("instruct"))
    # nulls written out: an instruct that is null is there, one that is left out isn't
    answer = F.when(kind == 0, '{"lines": []}').when(kind == 1, '{"other": 1}').when(kind == 2, F.to_json(F.struct(F.array(line).alias("lines")))).otherwise(F.to_json(F.struct(F.array(line, line).alias("lines")), {"ignoreNullFields": "false"}))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", annotate.answer_problem(answer).alias("problem"))


def _work(spark: SparkSession) -> str:
    """A folder of its own in the one that the session shares, or on this machine if it shares none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return config.canonical(spark, f"{shared or 'file://' + tempfile.mkdtemp(prefix='fabula-')}/fabula-{uuid.uuid4().hex}")


@query("""SELECT doc_id, CAST(passage_idx AS INTEGER) AS passage_idx, CASE WHEN again THEN sha256(text) ELSE old_hash END AS text_hash
  FROM (SELECT *, doc_id % 3 = 0 AND max(CASE WHEN passage_idx % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 1 AS again FROM cached JOIN passages USING (doc_id, passage_idx)) WHERE NOT again OR passage_idx % 2 = 0""")
def cache_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits; a third of the chapters are in both, with half of their passages in the second."""
    root, first = _work(spark), _cached(spark, sf_dir)
    cache.commit(first, root, "annotations")
    again = first.where((F.col("chapter_number") % 3 == 0) & (F.col("passage_idx") % 2 == 0)).drop("text_hash")
    fresh = _passages(spark, sf_dir).select("chapter_number", "passage_idx", X.passage_hash("text").alias("text_hash"))
    return _doc(cache.commit(again.join(fresh, ["chapter_number", "passage_idx"]), root, "annotations"), "passage_idx", "text_hash")


@query("""SELECT conv_id, count(*) AS n_chunks, count(DISTINCT CASE WHEN odd THEN path END) AS n_jobs, CAST(sum(24 * greatest(1, length(segment))) + 16800 * (count(*) - 1) AS BIGINT) AS n_samples
  FROM (SELECT *, role || segment AS path, ascii(sha256(segment || chr(0) || CASE WHEN role = 'assistant' THEN 'Aiden' ELSE 'Ryan' END || chr(0) || chr(0) || CASE WHEN role = 'system' THEN '1' ELSE '0' END)) % 3 <> 0 AS odd
    FROM (SELECT conv_id, turn, role, CASE WHEN rs = '' OR """ + _END + """ THEN rs ELSE rs || '.' END AS segment FROM (SELECT *, regexp_replace(text, '""" + _S + """+$', '') AS rs FROM conversations))) GROUP BY conv_id""")
def chapter_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chapters of audio: a third of the chunks' files are there before, a listing tells which, the others are made, and all are put together."""
    work, voice = _work(spark), synth.ToneVoice()
    lines = _table(spark, sf_dir, "conversations").select(
        F.lit("talk").alias("book_id"), F.col("conv_id").cast("int").alias("chapter_number"), F.col("turn").cast("int").alias("line_idx"), "text", F.col("role").alias("speaker"), (F.col("role") == "system").alias("is_narrator"),
        F.when(F.col("role") == "assistant", "female").otherwise("male").alias("speaker_gender"), F.lit(False).alias("speaker_is_child"), F.lit(None).cast("string").alias("instruct"),
    )
    pinned = spark.createDataFrame([("assistant", "Aiden")], "speaker string, voice string")
    chunks = chunk.merge_chunks(cast.resolve_lines(lines, pinned, tone=None), f"{work}/audio")
    begun = chunks.where(F.ascii("content_hash") % 3 == 0)
    synth.synthesize(resume.pending_jobs(begun, audio.existing(spark, f"{work}/audio")), voice).write.format("noop").mode("overwrite").save()
    jobs = resume.pending_jobs(chunks, audio.existing(spark, f"{work}/audio")).persist()
    synth.synthesize(jobs, voice).write.format("noop").mode("overwrite").save()
    named = chunks.select("book_id", "chapter_number", F.format_string("%d.wav", "chapter_number").alias("filename"), "chunk_idx", "audio_path")
    written = assemble.assemble_chapters(named, f"{work}/output")
    totals = resume.job_totals(chunks, jobs)
    return totals.join(written, ["book_id", "chapter_number"]).select(F.col("chapter_number").cast("long").alias("conv_id"), "n_chunks", "n_jobs", "n_samples")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
