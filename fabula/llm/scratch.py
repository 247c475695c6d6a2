"""Reliable intermediate tables.

A settled table is written as Parquet to the folder that the cluster shares
(``spark.checkpoint.dir``) and read again: lineage ends there, any executor
can read it, and a lost executor costs only its running tasks.

Results are lazy, so tables that they read stay until the result has been written.
Then ``clear`` removes them; what is left when the program ends is removed too.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"

_settled: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder.  Only on one machine, and only where the session names none (tests), it is a local one."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fabula-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: What goes to a Python worker at a time while a table is settled, or read after `hold_batches`: whole texts and
#: packed arrays are large rows, and a batch is held several times, in the executor's direct memory and in the worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Holds BATCHES in the session, and gives it its own settings back."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_held: list[tuple[SparkSession, str]] = []


def hold_batches(spark: SparkSession) -> None:
    """Holds BATCHES until `clear`, for a result whose Python functions run only when it is written.

    Spark reads these settings then, from the session.  What the session has set itself stays.
    """
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
            _held.append((spark, k))


def settle(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write df to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/fabula-{name}-{uuid.uuid4().hex}"
    _settled[path] = spark
    with _small_batches(spark):
        df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(df: DataFrame | None) -> None:
    """Remove a settled table (or that which df selects from) that nothing reads any more."""
    name = _name(df)
    for path in [p for p in _settled if p.rpartition("/")[2] == name]:
        _delete(_settled.pop(path), path)


def _name(df: DataFrame | None) -> str | None:
    """The folder of the settled table that df is, or reads."""
    if df is None:
        return None
    path = getattr(df, "_settled", None) or next((f.rpartition("/")[0] for f in df.inputFiles()[:1]), "")
    return path.rpartition("/")[2] or None


def tables() -> frozenset[str]:
    """The settled tables that are there now; give it to `clear` later."""
    return frozenset(_settled)


def clear(before: frozenset[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Remove all tables settled since `before` but that of `keep`, and what `hold_batches` set; results that read them must have been written."""
    while _held:
        session, setting = _held.pop()
        session.conf.unset(setting)
    kept = _name(keep)
    for path in [p for p in _settled if p not in before and p.rpartition("/")[2] != kept]:
        _delete(_settled.pop(path), path)


@atexit.register
def _at_end() -> None:
    for path, spark in list(_settled.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended, and with it the way to its files
            return


def gathered(df: DataFrame, keys: list[str], then: list[str] | None = None) -> DataFrame:
    """df with the rows of a key in one partition and next to each other, in order of `then`.

    Partitioned by a hash column of its own: an exchange by the keys themselves could be
    left out after a join on them, and adaptive execution may then read that join's
    partitions piecemeal, for it doesn't know that a Python function needs them whole.
    """
    return df.repartition(F.xxhash64(*keys, F.lit(11))).sortWithinPartitions(*keys, *(then or []))
