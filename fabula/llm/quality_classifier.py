"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document (docstats.STATISTICS), standardised, go through random
Fourier features that approximate a Gaussian kernel.  Ridge regression is fitted
from normal equations, which each partition sums on its own; the raw score is
then calibrated to a probability by isotonic regression over a histogram of
scores of rows that the ridge fit hasn't seen.

The fit uses at most FIT_ROWS labelled ids (chosen by hash, outside the held-out
fold), and at most twice as many rows of them where ids repeat; rows that agree in
id and text are one.  One in five of these is left out of the ridge fit and
calibrates, at least one of each label; of a label with a single row, that row does
both.  Scoring reads whole texts of all rows.  Null and empty texts get
the score of all-zero statistics.  Without labels every score is the prior 0.5,
or the label where there is but one.  Nothing but the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import docstats
from .folds import bounded_labels, bounded_rows
from .textbatch import chunks

FIT_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-3
BINS = 512
SEED = 9
CLIP = 6.0


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray  # statistics x features
    shift: np.ndarray
    weights: np.ndarray  # of the features, then the intercept
    steps: np.ndarray  # raw scores and the probabilities there
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        f = np.cos(z @ self.turns + self.shift) * np.sqrt(2.0 / len(self.shift))
        return np.column_stack([f, np.ones(len(f))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: for x ascending, the non-decreasing values nearest to y under weights w."""
    blocks: list[list[float]] = []  # value, weight, first, last
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b2, b1 = blocks.pop(), blocks.pop()
            total = b1[1] + b2[1]
            blocks.append([(b1[0] * b1[1] + b2[0] * b2[1]) / total, total, b1[2], b2[3]])
    steps = np.array([v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    levels = np.array([b[0] for b in blocks for _ in range(2 if b[3] > b[2] else 1)])
    return steps, levels


def _labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str, key: str) -> DataFrame:
    """stats (array), label and place (a hash) of at most `rows` labelled documents; keys are few, so they go to each task."""
    chosen = bounded_labels(labels, label, rows, key=key)
    met = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key").withColumn("__place", F.xxhash64("__key", "text", F.lit(SEED)))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(list(docstats.statistics(b)), pa.list_(pa.float64())), part.column("__label"), part.column("__place")], names=["stats", "label", "place"])

    return bounded_rows(met.mapInArrow(stats, "stats array<double>, label double, place long"), rows, "place")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, text: str = "text", key: str = "doc_id", features: int = FEATURES) -> Model:
    from .scratch import drop, settle

    known = settle(_labelled_statistics(docs, labels, label, rows, text, key), "labelled")
    d = len(docstats.STATISTICS)
    moments = known.select(*(f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))), F.avg("label").alias("prior"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    rng = np.random.default_rng(SEED)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(d)])
    scale[scale < 1e-9] = 1.0
    blank = Model(mean, scale, rng.normal(0, np.sqrt(1.0 / d), (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, 0.5))
    if not moments["n"] or moments["low"] == moments["high"]:
        prior = 0.5 if not moments["n"] else float(moments["prior"])
        drop(known)
        return Model(blank.mean, blank.scale, blank.turns, blank.shift, blank.weights, blank.steps, np.full(1, prior))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                f = blank.features(np.array(batch.column("stats").to_pylist()))
                gram += f.T @ f
                right += f.T @ batch.column("label").to_numpy()
        yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "rhs": [right.tobytes()]})

    # at most `rows` short rows, so a few partitions and as many sums
    # the first row of each label calibrates too; where a label has no other, it does both
    first = [(r["place"], r["n"]) for r in known.groupBy("label").agg(F.min("place").alias("place"), F.count("*").alias("n")).collect()]
    spare = (F.pmod("place", F.lit(5)) == 0) | F.col("place").isin([x for x, _ in first])
    fitted = known.where(~spare | F.col("place").isin([x for x, n in first if n == 1]))
    seen = known.where(spare)
    parts = fitted.coalesce(8).mapInArrow(sums, "gram binary, rhs binary").collect()
    gram = sum(np.frombuffer(p["gram"]) for p in parts).reshape(features + 1, features + 1)
    right = sum(np.frombuffer(p["rhs"]) for p in parts)
    n = max(gram[-1, -1], 1.0)
    penalty = np.full(features + 1, RIDGE * n)
    penalty[-1] = 1e-9 * n
    weights = np.linalg.solve(gram + np.diag(penalty), right)
    ridge = Model(blank.mean, blank.scale, blank.turns, blank.shift, weights, blank.steps, blank.levels)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.clip(np.floor((ridge.raw(np.array(batch.column("stats").to_pylist())) + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label")], names=["bin", "label"])

    bins = seen.mapInArrow(histogram, "bin long, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    x = np.array([(b["bin"] + 0.5) / BINS * 3 - 1 for b in bins])
    steps, levels = isotonic(x, np.array([b["y"] for b in bins]), np.array([float(b["w"]) for b in bins]))
    drop(known)
    return Model(ridge.mean, ridge.scale, ridge.turns, ridge.shift, weights, steps, levels)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns of every row of docs and its score, 0 to 1.

    Repeated rows are scored each; columns other than the text and `carry` aren't
    read, and `carry` may have any names but that of the score.
    """
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*(part.column(f"__{i}") for i in range(len(carry))), pa.array(model.score(docstats.statistics(b)))], names=[*carry, column])

    return docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(carry)), F.col(text).alias("__text")).mapInArrow(run, schema)
