"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import fold

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers of this machine are; every executor has them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "words_before", "words_left", "lines_deleted", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, score

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_jaccard_join, op3_pii, op4_language_id, op5_toxicity, op6_vector_dedup, op7_line_dedup, op8_mixing, op9_quality_classifier, op10_packing)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op1_quality_rules": oracles.OP1, "op2_jaccard_join": oracles.OP2, "op6_vector_dedup": oracles.OP6, "op8_mixing": oracles.OP8}
