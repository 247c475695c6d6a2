"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled ones (U) train a linear classifier
in numpy under the non-negative risk estimator: with class prior q and loss l,
    q * mean_P l(+f) + max(0, mean_U l(-f) - q * mean_P l(-f)),
where a step that would make the second part negative goes back instead.  Labels
other than toxic ones serve only for the prior: the share of toxic documents
among labelled ones of the training fold.

Features say which words a document has, and which beginnings of words (4 to 6
bytes), lower-cased by ASCII and hashed to BUCKETS places; the classifier uses
at most SELECTED places whose frequency in P and U differs most.

The fit uses at most P_ROWS and U_ROWS ids (by hash, outside the held-out
fold), and at most twice as many rows of them where ids repeat; rows that agree
in id and text are one.  Whole texts are scored.  Null and empty texts get the score of no
feature.  Without toxic examples every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import bounded_labels, bounded_rows, fold
from .scratch import drop, settle
from .textbatch import TextBatch, chunks, mix

P_ROWS = 4000
U_ROWS = 8000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SELECTED = 2048
#: Standard errors between P and U that a place must differ by; but so many places are used at least.
LEAST_Z, FEWEST = 4.0, 32
STEPS = 400
RATE = 0.05
DECAY = 2e-5


def features(b: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each feature of each text, every pair once, in order of text."""
    starts, ends = b._word_spans
    owner = b.word_text.astype(np.uint64)
    found = [(owner, b.hash_spans(starts, ends, lower=True))]
    for size in (4, 5, 6):
        long = ends - starts > size
        found.append((owner[long], mix(b.hash_spans(starts[long], starts[long] + size, lower=True) + np.uint64(size))))
    pairs = np.concatenate([(o << np.uint64(BUCKET_BITS)) | (h >> np.uint64(64 - BUCKET_BITS)) for o, h in found])
    pairs = np.unique(pairs)
    return (pairs >> np.uint64(BUCKET_BITS)).astype(np.int64), (pairs & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    places: np.ndarray  # weight of each hashed place, 0 if it isn't selected
    bias: float

    def score(self, b: TextBatch) -> np.ndarray:
        owner, place = features(b)
        return _sigmoid(np.bincount(owner, self.places[place], b.n) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def nnpu(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier; (rows, columns) are the features that are there, `positive` marks P's rows.

    The loss is logistic; steps are Adam's.
    """
    n = len(positive)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior)) / 2
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        f = np.bincount(rows, w[columns], n) + w[-1]
        p = _sigmoid(f)
        as_negative, falls, rises = np.logaddexp(0, f), p - 1, p  # loss as a negative; derivatives by f as a positive and as a negative
        g = np.zeros(n)
        if as_negative[~positive].mean() >= prior * as_negative[positive].mean():
            g[positive] = prior / n_p * (falls - rises)[positive]
            g[~positive] = rises[~positive] / n_u
        else:  # back
            g[positive] = prior / n_p * rises[positive]
            g[~positive] = -rises[~positive] / n_u
        grad = np.append(np.bincount(columns, g[rows], width), g.sum()) + DECAY * np.append(w[:-1], 0)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    f = np.bincount(rows, w[columns], n) + w[-1]
    return w[:-1], float(w[-1]) - best_cut(f[positive], f[~positive], prior)


def best_cut(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """Where to part scores so that the estimated share of errors is least: the middle of the widest such gap.

    Of what lies above, q * share of P is right and the rest of U is wrong; what of P lies below is wrong.
    """
    cuts = np.unique(np.concatenate([p, u]))
    if len(cuts) < 2:
        return 0.0
    middles = (cuts[1:] + cuts[:-1]) / 2
    missed = np.searchsorted(np.sort(p), middles) / len(p)
    above = 1 - np.searchsorted(np.sort(u), middles) / len(u)
    errors = prior * missed + np.maximum(above - prior * (1 - missed), 0)
    good = errors <= errors.min() + 1e-12
    widest = np.argmax(np.where(good, cuts[1:] - cuts[:-1], -1))
    return float(middles[widest])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", p_rows: int = P_ROWS, u_rows: int = U_ROWS) -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(fold(key, 5) != 0)
    share = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    if not share:
        return Model(np.zeros(BUCKETS), -30.0)
    prior = float(np.clip(share, 0.01, 0.9))
    toxic = bounded_labels(known.where(F.col(label) > 0), label, p_rows, key=key).select("__key", F.lit(True).alias("p"))
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    total = own.count()
    # unlabelled text: a share by hash, of which the first u_rows are used
    hashed = F.pmod(F.xxhash64("__key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    unlabelled = own.select("__key").where(F.col("__key").isNotNull() & (fold("__key", 5) != 0)).where(hashed < min(1.0, 1.5 * u_rows / max(total, 1))).distinct()
    unlabelled = unlabelled.orderBy(F.xxhash64("__key", F.lit(5)), "__key").limit(u_rows).select("__key", F.lit(False).alias("p"))
    # at most p_rows + u_rows keys go to each task
    chosen = F.broadcast(toxic.unionByName(unlabelled))
    met = own.join(chosen, "__key").withColumn("__mark", F.xxhash64("text"))
    sides = [bounded_rows(met.where(F.col("p") == side), rows, "__key", "__mark").select("text", "p") for side, rows in ((True, p_rows), (False, u_rows))]
    sample = settle(sides[0].unionByName(sides[1]).repartition(8, F.xxhash64("text", "p")), "pu-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for part, b in chunks(batch):
                p = part.column("p").to_numpy(zero_copy_only=False).astype(np.int64)
                owner, place = features(b)
                for side in (0, 1):
                    sums[side] += np.bincount(place[p[owner] == side], minlength=BUCKETS).astype(np.int32)
                n += np.bincount(p, minlength=2)
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()], "n": [n.tobytes()]})

    parts = sample.coalesce(8).mapInArrow(count, "sums binary, n binary").collect()
    u, p = sum(np.frombuffer(x["sums"], np.int32).reshape(2, BUCKETS).astype(np.float64) for x in parts)
    n_u, n_p = sum(np.frombuffer(x["n"], np.int64) for x in parts)
    if not n_p or not n_u:
        drop(sample)
        return Model(np.zeros(BUCKETS), -30.0)
    pooled = (u + p + 1) / (n_u + n_p + 2)
    z = np.abs(p / n_p - u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    z[u + p < 3] = 0
    selected = np.lexsort((np.arange(BUCKETS), -z))[:SELECTED]
    # in small samples, words that differ by chance would only teach it the sample
    selected = selected[: max(int((z >= LEAST_Z).sum()), FEWEST)]
    column = np.full(BUCKETS, -1, np.int32)
    column[selected] = np.arange(len(selected))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch):
                owner, place = features(b)
                own_columns = column[place]
                there = own_columns >= 0
                bounds = np.searchsorted(owner[there], np.arange(b.n + 1))
                picked = own_columns[there].astype(np.int16)
                yield pa.RecordBatch.from_arrays([part.column("p"), pa.array([picked[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["p", "columns"])

    rows = sample.mapInArrow(pick, "p boolean, columns binary").collect()
    rows.sort(key=lambda r: (r["p"], bytes(r["columns"])))
    drop(sample)
    got = [np.frombuffer(r["columns"], np.int16) for r in rows]
    weights, bias = nnpu(np.repeat(np.arange(len(got)), [len(x) for x in got]), np.concatenate(got).astype(np.int64), np.array([r["p"] for r in rows]), len(selected), prior)
    places = np.zeros(BUCKETS)
    places[selected] = weights
    return Model(places, bias)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score of every row, from its text alone.

    Repeated rows are scored each; columns other than key and text aren't read, so
    they may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch, "__text"):
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(model.score(b))], names=[key, "score"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, schema)
