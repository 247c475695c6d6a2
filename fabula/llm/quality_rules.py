"""Quality rules as a short-circuit cascade.

Each rule accepts or rejects a document.  The cascade first measures every rule
on a sample (`calibrate`): its cost in seconds a document, on top of the base
statistics, and the share that it rejects.  Rules then run in order of rejections
per second, on the documents that all before it accepted; rejected ones leave a
batch when they make up a quarter of it, for a smaller batch has to be copied.  The
verdict is the conjunction of the rules, so it doesn't depend on the order, on the
sample or on timing.

Defined results: a null or empty text has no words; rules that divide count an
empty denominator as one.  Any columns beside the text pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import docstats as S
from .textbatch import TextBatch, chunks, take


@dataclass(frozen=True)
class Rule:
    name: str
    accepts: Callable[[TextBatch], np.ndarray]


def mean_word_length(b: TextBatch) -> np.ndarray:
    """2 to 15 characters a word."""
    return (b.word_chars >= 2 * b.n_words) & (b.word_chars <= 15 * b.n_words)


def symbol_share(b: TextBatch) -> np.ndarray:
    """At most 15 symbols for 100 characters of words."""
    return 100 * S.n_symbols(b) <= 15 * b.word_chars


def capital_share(b: TextBatch) -> np.ndarray:
    """Capitals A-Z are at most half of the letters."""
    return 100 * b.count_bytes(S.UPPER) <= 50 * b.count_bytes(S.LETTER)


def letter_share(b: TextBatch) -> np.ndarray:
    """At least half of the characters of words are letters."""
    return 100 * b.count_bytes(S.LETTER) >= 50 * b.word_chars


def repeated_lines(b: TextBatch) -> np.ndarray:
    """At most 60 of 100 lines repeat an earlier line."""
    lines, copies = S.line_counts(b)
    return 100 * copies <= 60 * lines


def stuttering(b: TextBatch) -> np.ndarray:
    """At most 30 of 100 words are equal to the word before."""
    return 100 * S.n_stuttered(b, b.word_hashes()) <= 30 * b.n_words


def top_word_share(b: TextBatch) -> np.ndarray:
    """No word makes up more than 30 of 100 words."""
    _, most = S.word_repetition(b, b.word_hashes())
    return 100 * most <= 30 * b.n_words


RULES = tuple(Rule(f.__name__, f) for f in (mean_word_length, symbol_share, capital_share, letter_share, repeated_lines, stuttering, top_word_share))

#: Calibration looks at this many runs of documents of about 64 KB, about, from partitions all over the table.
SAMPLE_RUNS = 48

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float  # a document
    rejects: float  # share of the sample

    @property
    def worth(self) -> float:
        return self.rejects / max(self.seconds, 1e-12)


def calibrate(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_runs: int = SAMPLE_RUNS) -> list[Measured]:
    """Cost and selectivity of each rule, the most rejecting for its cost first.

    Partitions spread evenly over the table give their first runs of documents, so
    that about `sample_runs` are measured; the others end at once, and no
    partition is read further.  One small row for each run and rule comes back.
    """
    texts = df.select(F.col(text).alias("__text"))
    parts = max(texts.rdd.getNumPartitions(), 1)
    stride, runs = max(1, parts // sample_runs), max(1, sample_runs // parts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % stride:
            return
        left = runs
        for batch in batches:
            for _, b in chunks(batch, "__text", 64 << 10):
                rows = {"rule": [], "ns": [], "rejected": [], "docs": []}
                for k, rule in enumerate(rules):
                    fresh = TextBatch(b.data, b.bounds)
                    base_statistics(fresh)  # what these have found is there for the rules
                    began = time.perf_counter_ns()
                    verdict = rule.accepts(fresh)
                    rows["ns"].append(time.perf_counter_ns() - began)
                    rows["rule"].append(k)
                    rows["rejected"].append(int((~verdict).sum()))
                    rows["docs"].append(b.n)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, pa.int64()) for c in rows]))
                left -= 1
                if not left:
                    return

    found = texts.mapInArrow(measure, "rule long, ns long, rejected long, docs long").collect()
    out = []
    for k, rule in enumerate(rules):
        own = [r for r in found if r["rule"] == k]
        docs = max(sum(r["docs"] for r in own), 1)
        out.append(Measured(rule.name, sum(r["ns"] for r in own) / 1e9 / docs, sum(r["rejected"] for r in own) / docs))
    return sorted(out, key=lambda m: (-m.worth, m.name))


def in_order(rules: Sequence[Rule], measured: Sequence[Measured]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[m.name] for m in measured]


def verdicts(b: TextBatch, rules: Sequence[Rule], alive: np.ndarray | None = None) -> np.ndarray:
    """Which texts every rule accepts; a rule sees only what is left by those before it."""
    kept = np.ones(b.n, bool) if alive is None else alive.copy()
    rest = b
    rows = np.arange(b.n)
    for rule in rules:
        if len(rows) and not kept[rows].all():
            stay = np.flatnonzero(kept[rows])
            if len(stay) * 4 < len(rows) * 3:  # a smaller batch pays only when much has gone
                rest, rows = take(rest, stay), rows[stay]
        if not len(rows):
            break
        kept[rows] &= rule.accepts(rest)
    return kept


def base_statistics(b: TextBatch) -> dict[str, np.ndarray]:
    hashes = b.word_hashes()
    out = {
        "n_words": b.n_words,
        "word_chars": b.word_chars,
        "n_symbols": S.n_symbols(b),
        "n_dup_lines": S.line_counts(b)[1],
        "n_repeat_words": S.n_repeat_words(b, hashes),
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def quality_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id", sample_runs: int = SAMPLE_RUNS) -> DataFrame:
    """key, base statistics, base_failed and kept for every row of df.

    kept is false where the base rules fail, else the cascade's verdict.  A
    null text has zero counts, fails and isn't kept.  Repeated rows and ties
    are judged row by row; other columns of df aren't read.
    """
    order = in_order(rules, calibrate(df, rules, text, sample_runs))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    source = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch, "__text"):
                base = base_statistics(b)
                kept = verdicts(b, order, ~base["base_failed"])
                columns = [part.column("__key"), *(pa.array(base[c].astype(np.int64)) for c in longs), pa.array(base["base_failed"]), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *longs, "base_failed", "kept"])

    return source.mapInArrow(judge, schema)
