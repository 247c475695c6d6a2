"""Folds and bounded samples of labelled rows, shared by the classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def bounded_labels(labels: DataFrame, label: str, rows: int, n_folds: int = 5, held_out: int = 0, key: str = "doc_id") -> DataFrame:
    """At most `rows` labelled keys outside the held-out fold: __key, __label.

    A key with several labels counts once, with the largest.  Keys are taken in
    order of a hash, so the sample doesn't depend on partitions and reruns agree.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(fold(key, n_folds) != held_out).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("double").alias("__label"))
    return one.orderBy(F.xxhash64("__key"), "__key").limit(rows)


#: Groups that a bounded sample of rows is taken from, each on its own.
BUCKETS = 8


def bounded_rows(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most about 2 x `rows` rows of df, which differ in `by`, in BUCKETS groups by a hash of these.

    A sample by keys has so many rows only if keys repeat: however often one
    does, the sample stays bounded, and rows that agree count once.
    """
    once = df.dropDuplicates(list(by))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.xxhash64(*by, F.lit(14)), *by))
    numbered = once.withColumn("__bucket", F.pmod(F.xxhash64(*by, F.lit(13)), F.lit(BUCKETS))).withColumn("__n", place)
    return numbered.where(F.col("__n") <= math.ceil(2 * rows / BUCKETS)).drop("__bucket", "__n")
