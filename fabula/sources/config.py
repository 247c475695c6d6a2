"""Voices, overrides and settings."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cast import DEFAULT_VOICES

API_KEY, MODEL = "OPENAI_API_KEY", "OPENAI_MODEL"
DEFAULT_MODEL = "gpt-5.6-luna"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a file or folder there, in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with all that is in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def canonical(spark: SparkSession, path: str) -> str:
    """One form for each place: an absolute path on the machine's (or a mounted) file system, else a whole URI."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:(//)?(?=/)", "", place.makeQualified(store.getUri(), store.getWorkingDirectory()).toString())


def voices_of(text: Column | str) -> Column:
    """The four roles' voices in a configuration's text: each from the text if it names it (even as null), else the default; other keys are left out."""
    named = F.coalesce(F.from_json(F.col(text) if isinstance(text, str) else text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    standard = F.create_map(*(F.lit(x) for kv in DEFAULT_VOICES.items() for x in kv))
    return F.transform_values(standard, lambda role, voice: F.when(F.map_contains_key(named, role), named[role]).otherwise(voice))


def voice_config(spark: SparkSession, path: str) -> dict[str, str | None]:
    """The voices of a configuration file, the defaults without one."""
    text = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([("{}",)], "value string")
    return text.select(voices_of("value").alias("v")).first()["v"]


def pinned_of(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, speaker and voice of every pinned speaker that a text (JSON) names."""
    return texts.select(*keys, F.explode(F.from_json(text, "map<string,string>")).alias("speaker", "voice"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """speaker and voice of every pinned speaker of a file; none without one."""
    if not exists(spark, path):
        return spark.createDataFrame([], "speaker string, voice string")
    return pinned_of(spark.read.text(path, wholetext=True), "value")


def model_name() -> str:
    return os.environ.get(MODEL, DEFAULT_MODEL)


def api_key() -> str:
    """The provider's key; it is read where a provider is made and never becomes part of a plan."""
    key = os.environ.get(API_KEY)
    if not key:
        raise RuntimeError(f"{API_KEY} is not set")
    return key
