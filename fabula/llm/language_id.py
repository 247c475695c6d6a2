"""Language identification with string kernels.

A text is the set of its 1-, 2- and 3-grams of lower-case letters (everything
else is one boundary sign), hashed to BUCKETS bits: presence, not counts.  The
blended-spectrum kernel of two texts is the number of common bits over the root
of the product of their numbers of bits.  Nyström's method takes LANDMARKS
training texts for a basis, or more where that makes fewer than EACH a language;
one-versus-rest kernel ridge regression is fitted there, from normal equations that
partitions sum on their own, and its weights fold into one matrix.  A batch of texts
is scored by two matrix products: with the landmarks' bits, then with that matrix.

Every language of the training fold is learnt, from at most FIT_ROWS different
documents of it (chosen by hash; rows that agree in key and text are one).  Whole
texts are read.  A text that is null or has no letter is `und` with score 0; so is
every text if nothing could be learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold
from .scratch import drop, settle
from .textbatch import TextBatch, chunks

BUCKETS = 8192
LANDMARKS, EACH = 128, 8
FIT_ROWS = 1000
#: Texts whose bits are looked at together: 8 KB each, and 32 KB as numbers.
ROWS = 512
#: Partitions that sum normal equations.
SUMS = 8
RIDGE = 1e-2
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def presence(b: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text (n x BUCKETS, boolean), and whether it has a letter."""
    points = np.frombuffer(b.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()[points]
    size = b.n_chars
    owner = np.repeat(np.arange(b.n, dtype=np.int64), size)
    bits = np.zeros((b.n, BUCKETS), bool)
    flat = bits.reshape(-1)
    has = np.zeros(b.n, bool)
    solid = letters > 0
    has[owner[solid]] = True
    base = owner * BUCKETS
    mixed = letters * np.uint32(2654435761)

    def mark(code: np.ndarray, at: np.ndarray) -> None:
        code = code ^ (code >> np.uint32(15))
        code = code * np.uint32(0x85EBCA6B)
        flat[at + (code >> np.uint32(19)).astype(np.int64)] = True

    mark(mixed[solid], base[solid])
    for order in (2, 3):
        if len(letters) < order:
            break
        heads = slice(0, len(letters) - order + 1)
        code = mixed[heads]
        some = solid[heads]
        for k in range(1, order):
            tail = slice(k, len(letters) - order + 1 + k)
            code = code * np.uint32(0x9E3779B1) + mixed[tail] + np.uint32(order)
            some = some & solid[tail] if order == 2 else some | solid[tail]
        # bigrams of two letters; trigrams with a letter, so that beginnings and ends of words count
        some = some & (owner[heads] == owner[order - 1 :])
        mark(code[some], base[heads][some])
    return bits, has


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # bits of each, packed
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def predict(self, bits: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each text's language, and its score; basis is that of the landmarks."""
        values = kernel(bits, basis) @ self.weights + self.bias
        z = np.exp(4 * (values - values.max(1, keepdims=True)))
        best = values.argmax(1)
        return best, (z / z.sum(1, keepdims=True))[np.arange(len(best)), best]


def basis_of(packed: np.ndarray) -> np.ndarray:
    """Landmarks' bits over the root of their number."""
    x = np.unpackbits(packed, axis=1)[:, :BUCKETS].astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1), 1))[:, None]


def kernel(bits: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Common bits over the root of the product of the numbers of bits, for each text and landmark."""
    x = bits.astype(np.float32)
    return ((x @ basis.T) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]).astype(np.float64)


def root_of(basis: np.ndarray) -> np.ndarray:
    """The inverse root, up to a turn, of the landmarks' kernel."""
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    return vectors / np.sqrt(np.maximum(values, 1e-6))


def sums(features: np.ndarray, which: np.ndarray, weight: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted products of the features (and 1) with each other, and their sums by language."""
    full = np.column_stack([features, np.ones(len(features))])
    own = np.zeros((languages, full.shape[1]))
    np.add.at(own, which, full * weight[:, None])
    return (full * weight[:, None]).T @ full, own


def solve(gram: np.ndarray, own: np.ndarray, ridge: float) -> np.ndarray:
    """One-versus-rest weights, the intercept last: targets are 1 for the own language and -1 for others."""
    penalty = np.full(len(gram), ridge)
    penalty[-1] = 0
    return np.linalg.solve(gram + np.diag(penalty), 2 * own.T - gram[:, -1:])


def fit_arrays(bits: np.ndarray, which: np.ndarray, languages: tuple[str, ...], chosen: np.ndarray, ridge: float = RIDGE) -> Model:
    """As `fit` has it, in one place.  bits: rows x BUCKETS; which: place of each row's language; chosen: rows that are landmarks."""
    packed = np.packbits(bits[chosen], axis=1)
    basis = basis_of(packed)
    root = root_of(basis)
    # every language weighs the same
    weight = (1.0 / (np.maximum(np.bincount(which, minlength=len(languages)), 1) * len(languages)))[which]
    w = solve(*sums(kernel(bits, basis) @ root, which, weight, len(languages)), ridge / len(chosen))
    return Model(languages, packed, root @ w[:-1], w[-1])


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame | None:
    """lang, place and bits (packed) of at most `rows` documents of each language, from the training fold; settled."""
    train = docs.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), F.col(text).alias("__text")).where(F.col("__lang").isNotNull() & F.col("__key").isNotNull() & (fold("__key", 4) != 2))
    # one row for each language, of which there are few
    counts = {r["__lang"]: r["count"] for r in train.groupBy("__lang").count().collect()}
    if not counts:
        return None
    # a share of each language by hash, a little more than `rows`, of which the first `rows` are used
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * rows / n))))
    place = F.pmod(F.xxhash64("__key", "__text"), F.lit(1 << 50)) / float(1 << 50)
    picked = train.withColumn("__place", place).where(F.col("__place") < share[F.col("__lang")])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch, "__text", rows=ROWS):
                have, has = presence(b)
                full = np.flatnonzero(has)
                packed = np.packbits(have[full], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("__lang").take(pa.array(full)), part.column("__place").take(pa.array(full)), pa.array([p.tobytes() for p in packed], pa.binary())], names=["lang", "place", "bits"])

    once = picked.mapInArrow(bits, "lang string, place double, bits binary").groupBy("lang", "place").agg(F.min("bits").alias("bits"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    few = once.withColumn("n", first).where(F.col("n") <= rows)
    return settle(few.repartition(SUMS, "place").sortWithinPartitions("lang", "place"), "languages")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> Model | None:
    """Learns from rows with a language whose crc32(key) modulo 4 isn't 2."""
    taken = sample(docs, text, lang, key, rows)
    if taken is None:
        return None
    counts = {r["lang"]: r["count"] for r in taken.groupBy("lang").count().collect()}
    names = tuple(sorted(counts))
    if not names:
        drop(taken)
        return None
    # the first of each language, in turn: 1 KB each
    each = max(EACH, -(-LANDMARKS // len(names)))
    heads = sorted(taken.where(F.col("n") <= each).collect(), key=lambda r: (r["n"], r["lang"]))[: max(LANDMARKS, EACH * len(names))]
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in heads), np.uint8).reshape(len(heads), -1)
    root = root_of(basis_of(packed))
    number = {k: i for i, k in enumerate(names)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = basis_of(packed)
        gram, own = 0.0, 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                have = np.unpackbits(np.frombuffer(b"".join(x.as_py() for x in part.column("bits")), np.uint8).reshape(part.num_rows, -1), axis=1)[:, :BUCKETS]
                which = np.array([number[x] for x in part.column("lang").to_pylist()])
                weight = np.array([1.0 / (counts[x] * len(names)) for x in part.column("lang").to_pylist()])
                g, o = sums(kernel(have, basis) @ root, which, weight, len(names))
                gram, own = gram + g, own + o
        if isinstance(gram, np.ndarray):
            yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "own": [own.tobytes()]})

    parts = taken.select("lang", "bits").mapInArrow(add, "gram binary, own binary").collect()
    drop(taken)
    size = len(packed) + 1
    gram = sum(np.frombuffer(p["gram"]) for p in parts).reshape(size, size)
    own = sum(np.frombuffer(p["own"]) for p in parts).reshape(len(names), size)
    w = solve(gram, own, RIDGE / len(packed))
    return Model(names, packed, root @ w[:-1], w[-1])


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of every row, from its text alone.

    Repeated rows are scored each; columns other than key and text aren't read, so
    they may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = basis_of(model.landmarks) if model else None
        for batch in batches:
            for part, b in chunks(batch, "__text", rows=ROWS):
                names = np.full(b.n, UNKNOWN, object)
                score = np.zeros(b.n)
                if model:
                    bits, has = presence(b)
                    best, value = model.predict(bits, basis)
                    names[has] = np.array(model.languages, object)[best[has]]
                    score[has] = value[has]
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(names, pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, schema)
