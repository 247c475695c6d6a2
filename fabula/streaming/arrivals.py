"""Books as they arrive: each micro-batch of new files goes through the batch plan.

The plan is incremental by itself, so a batch that is repeated after a failure
finds its work in the caches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import book_slug
from ..sources.epub import book_elements

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Calls handle(elements, batch) for the elements of each micro-batch of new EPUB files below folder."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.epub").load(folder)
    books = files.select(book_slug("path").alias("book_id"), F.col("content"))
    writer = books.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: handle(book_elements(df), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
