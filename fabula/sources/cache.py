"""Annotation and tone caches: append-only versions in Parquet folders.

A commit writes the whole state of some chapters as a new version; a chapter's state is
that of the latest version that has it.  Spark marks a version that was written to
its end, so a reader sees a commit or nothing of it, and commits of other chapters
stay as they are.  Many versions are made one now and then.  One run at a time
commits to a folder.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ANNOTATION_CACHE, TONE_CACHE
from .config import exists, remove

SCHEMAS = {"annotations": ANNOTATION_CACHE, "tones": TONE_CACHE}
CHAPTER = ["book_id", "chapter_number"]
#: Versions that are kept before they are made one.
MOST_VERSIONS = 50


def versions(spark: SparkSession, folder: str) -> list[str]:
    if not exists(spark, folder):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = [f.getPath().getName() for f in found]
    return sorted(n for n in names if n.startswith("v") and exists(spark, f"{folder}/{n}/_SUCCESS"))


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Every chapter's latest state; empty if there is none."""
    schema: T.StructType = SCHEMAS[table]
    names = versions(spark, f"{root}/{table}")
    if not names:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())])).parquet(*(f"{root}/{table}/{n}" for n in names))
    if len(names) > 1:
        latest = stored.groupBy(*CHAPTER).agg(F.max("version").alias("version"))
        stored = stored.join(latest, [*CHAPTER, "version"], "left_semi")
    return stored.select(*schema.names)


def _write(df: DataFrame, root: str, table: str) -> None:
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.select(*SCHEMAS[table].names, F.lit(version).alias("version")).write.parquet(f"{root}/{table}/{version}")


def commit(df: DataFrame, root: str, table: str) -> DataFrame:
    """Adds the state of df's chapters, all of their rows, and returns the whole table as read afterwards."""
    spark = df.sparkSession
    _write(df, root, table)
    old = versions(spark, f"{root}/{table}")
    if len(old) > MOST_VERSIONS:
        _write(read(spark, root, table), root, table)
        for name in old:
            remove(spark, f"{root}/{table}/{name}")
    return read(spark, root, table)
