"""A training corpus from raw documents in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; docs are what the
stage before it returned, written as Parquet and read again.  All but the last
return the columns of documents.  Where a result's rows go through Python when it is
read, the session is left with small batches for its workers until `scratch.clear`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import jaccard_join, line_dedup, mixing, packing, quality_classifier, scratch
from fabula.llm.queries import tokenizer_path
from fabula.llm.scratch import settle

#: Documents whose quality score is lower are rejected.
LEAST_QUALITY = 0.3
#: Rows to drop whose numbers are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    scratch.hold_batches(spark)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model, column="__score", carry=tuple(docs.columns))
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines; a document that loses all of its words goes."""
    scratch.hold_batches(spark)
    done = line_dedup.dedup_lines(docs, counts=("__deleted", "__before", "__left"))
    left = done.where((F.col("__left") > 0) | (F.col("__deleted") == 0))
    return _columns(left, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest id, null last, then by a hash of its text.

    Texts stay where they are: rows are numbered, and the numbers of those that go are what joins.
    """
    # settled, for the numbers must be the same wherever they are read
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = jaccard_join.near_duplicates(rows.select("__row", "text"), key="__row")
    order = rows.select("__row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row").alias("place"))
    placed = found.join(order, "__row").select("__row", "component_id", "place")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = settle(placed.join(first, "component_id").where(F.col("place") > F.col("first")).select("__row"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target wants it; repeats are rows of their own."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents' tokens into pieces in windows of 4096."""
    scratch.hold_batches(spark)
    return packing.pack(docs, tokenizer_path())


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars, if it is there, counts the text as it now is."""
    fresh = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else df
    return fresh.select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes and retrieval aren't SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every stage but the last is written to the shared folder.

    What a stage read and made on its way is removed once its rows are written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        before = scratch.tables()
        docs = settle(stage(spark, docs, sf_dir), name)
        scratch.clear(before, keep=docs)
        scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
