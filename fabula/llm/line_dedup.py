"""Deletion of repeated runs of lines, by a suffix array over line-ID sequences.

A document is the sequence of its lines that have a word, each known by 128 bits of a
hash of its characters.  A run of consecutive lines with MIN_WORDS words or more that
occurs earlier as well (in an earlier document, in order of id, or further up in
its own) is a later copy, and its lines are deleted.  The first copy of a run stays
whole as far as this run is concerned: where a later copy overlaps it, only the lines
after it go.

1. Lines that occur once end sequences.  What is left are segments of repeated
   lines; those with too few words are done.
2. Prefix doubling sorts the suffixes of the segments.  A rank is the number of smaller
   suffixes, that is, a place in the suffix array; each round splits suffixes of equal
   rank by the rank that stands 1, 2, 4, ... lines further on.  A round needs only the
   different pairs of ranks with their numbers, put in order by ranges over all
   partitions, so suffixes of one rank, however many, are nobody's task alone.
3. Suffixes with m lines in common are an interval of the suffix array whose longest
   common prefix is m or more.  It is told by two ranks of depth 2**k <= m that cover
   the m lines.  From every line, the shortest run with MIN_WORDS words needs m lines,
   never more than MIN_WORDS, and another one ends there.  Intervals of these lengths
   are found, and together they cover exactly the lines of all maximal repeated runs:
   each line of such a run is in a shortest run inside it.  So sorting to that depth is
   enough, whatever the length of the maximal runs.
4. In each interval all runs but the first one are later copies.

Lines are split at U+000A.  Lines without words are no part of a sequence; they
go with the line before them.  Null and empty texts stay as they are.  Rows that agree in key
and text are one document and get the same result; a null key comes before all others.  A
document's lines are looked at together, as its text is; nothing else is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, gathered, settle
from .textbatch import TextBatch, chunks

MIN_WORDS = 50


#: Documents with deletions whose runs are sent to every task; more are joined by shuffle.
BROADCAST_DOCS = 200_000


def document_ids(key: str, text: str) -> tuple[Column, Column]:
    """128 bits that tell a document."""
    return F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.lit(7), F.col(text), F.col(key))


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in names]


def _lines(docs: DataFrame) -> DataFrame:
    """doc and doc2, key, at (number among the document's lines with a word), line and line2 (hashes) and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch, "__text"):
                starts, ends, owner, words = b.lines
                full = words > 0
                starts, ends, owner, words = starts[full], ends[full], owner[full], words[full]
                at = np.arange(len(owner)) - np.searchsorted(owner, owner)
                row = pa.array(owner)
                hashes = (b.hash_spans(starts, ends), b.other_hash_spans(starts, ends))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in ("__doc", "__doc2", "__key")), pa.array(at.astype(np.int64)), *(pa.array(h.view(np.int64)) for h in hashes), pa.array(words.astype(np.int64))], names=["doc", "doc2", "key", "at", "line", "line2", "words"])

    schema = T.StructType([*_longs("doc", "doc2"), T.StructField("key", docs.schema["__key"].dataType), *_longs("at", "line", "line2", "words")])
    return docs.mapInArrow(run, schema)


def _numbered(counted: DataFrame, group: str, within: list[str], name: str) -> DataFrame:
    """counted (group, within, count) with `below`: how much the rows of smaller `within` of the same group count.

    Rows are put in order by ranges, so a group may go over many partitions; each adds up its
    own, and what went before is a few numbers of each partition.
    """
    names = [group, *within]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, start = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            count, own = batch.column("count").to_numpy(), batch.column(group).to_numpy()
            after = total + np.cumsum(count)
            before = after - count
            new = np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])
            # where the group of each row begins in this partition
            heads = np.where(new, before, -1)
            heads[0] = before[0] if new[0] else start
            start_of = np.maximum.accumulate(heads)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("count"), batch.column("part"), pa.array(before.astype(np.int64)), pa.array(start_of.astype(np.int64))], names=[*names, "count", "part", "before", "head"])
            total, last, start = int(after[-1]), own[-1], int(start_of[-1])

    placed = counted.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("part", F.spark_partition_id().cast("long"))
    added = settle(placed.mapInArrow(add, ", ".join(f"{c} long" for c in (*names, "count", "part", "before", "head"))), name)
    # a few numbers for each partition
    parts = sorted(added.groupBy("part").agg(F.sum("count").alias("n"), F.min(group).alias("low"), F.max(group).alias("high"), F.max("head").alias("head")).collect())
    offset, base, low = {}, {}, {}
    upto, last, begins = 0, None, 0
    for part, n, first, final, head in parts:
        offset[part], low[part] = upto, first
        base[part] = begins if first == last else upto
        begins = base[part] if first == final else upto + head
        last, upto = final, upto + n
    if not parts:
        return added.select(*names, "count", F.col("before").alias("below"))
    of = lambda values: F.create_map(*(F.lit(int(x)) for kv in values.items() for x in kv))[F.col("part")]
    begin = F.when(F.col(group) == of(low), of(base)).otherwise(of(offset) + F.col("head"))
    return added.select(*names, "count", (F.col("before") + of(offset) - begin).alias("below"))


def _first_ranks(lines: DataFrame) -> DataFrame:
    """line, line2 and rank (number of smaller suffixes) of every line that occurs twice or more."""
    counts = lines.groupBy("line", "line2").count().where("count > 1").withColumn("all", F.lit(0).cast("long"))
    return _numbered(counts, "all", ["line", "line2"], "line-ranks").select("line", "line2", F.col("below").alias("rank"))


#: Lines that are looked at together, and those that go on with their last document.
TOGETHER = 20_000

Work = Callable[[pa.Table], Iterator[pa.RecordBatch]]


def _whole(df: DataFrame, keys: list[str], begin: Callable[[], Work], schema: str | T.StructType) -> DataFrame:
    """Runs a task's work (made by `begin`) over tables with all rows of some keys (a document's, or a segment's), those of each in order of `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        held, size = [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                if size < TOGETHER:
                    z = min(batch.num_rows, a + TOGETHER)
                else:
                    # what is left of the last key
                    same = np.logical_and.reduce([batch.column(k).to_numpy()[a:] == held[-1].column(k)[-1].as_py() for k in keys])
                    z = batch.num_rows if same.all() else a + int(np.argmin(same))
                    if z < batch.num_rows:
                        held.append(batch.slice(a, z - a))
                        yield from work(pa.Table.from_batches(held))
                        held, size, a = [], 0, z
                        continue
                held.append(batch.slice(a, z - a))
                size, a = size + z - a, z
        if size:
            yield from work(pa.Table.from_batches(held))

    return gathered(df, keys, ["at"]).mapInArrow(run, schema)


def _segment_bounds(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where segments begin, and the number of rows."""
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1), [True]])
    return np.flatnonzero(new)


def shortest_runs(words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run with `least` words that starts, and that ends, at each line; 0 if its segment has none."""
    upto = np.concatenate([[0], np.cumsum(words)])
    sizes = np.diff(bounds)
    first, last = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    place = np.arange(len(words))
    end = np.searchsorted(upto, upto[:-1] + least)  # upto[end] is enough
    forward = np.where(end <= last, end - place, 0)
    start = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    back = np.where((start >= first) & (upto[1:] - upto[first] >= least), place + 1 - start, 0)
    return forward, back


def _segments(lines: DataFrame, ranks: DataFrame, least: int) -> DataFrame:
    """Lines in segments (numbered) with enough words: rank, and the lengths of the shortest runs from and to each."""
    key = lines.schema["key"].dataType

    def begin() -> Work:
        # numbers of a task's own: its partition, then one after the other
        number = count(TaskContext.get().partitionId() << 40)

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, doc2, at = (table.column(c).to_numpy() for c in ("doc", "doc2", "at"))
            # a document once, however often its row occurs
            once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (doc2[1:] != doc2[:-1]) | (at[1:] != at[:-1])])
            table = table.filter(pa.array(once))
            doc, at, words = (table.column(c).to_numpy() for c in ("doc", "at", "words"))
            bounds = _segment_bounds(np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (np.diff(table.column("doc2").to_numpy()) != 0)])), at)
            forward, back = shortest_runs(words, bounds, least)
            total = np.add.reduceat(words, bounds[:-1])
            sizes = np.diff(bounds)
            stays = np.repeat(total >= least, sizes)
            deepest = np.repeat(np.maximum.reduceat(np.maximum(forward, back), bounds[:-1]), sizes)
            segment = np.repeat(np.array([next(number) for _ in sizes], np.int64), sizes)
            out = pa.table([pa.array(segment), *(table.column(c) for c in ("doc", "doc2", "key", "at", "rank")), pa.array(forward), pa.array(back), pa.array(deepest)], names=["segment", "doc", "doc2", "key", "at", "rank", "forward", "back", "deepest"])
            yield from out.filter(pa.array(stays)).combine_chunks().to_batches()

        return work

    schema = T.StructType([*_longs("segment", "doc", "doc2"), T.StructField("key", key), *_longs("at", "rank", "forward", "back", "deepest")])
    return _whole(lines.join(ranks, ["line", "line2"]), ["doc", "doc2"], begin, schema)


def _deeper(level: DataFrame, step: int) -> DataFrame:
    """segment, at and the rank to twice the depth."""
    ahead = F.coalesce(F.lead("rank", step).over(Window.partitionBy("segment").orderBy("at")), F.lit(-1).cast("long"))
    # settled, so that the join below sees a plain input and can split a pair with very many rows
    pairs = settle(level.select("segment", "at", "rank", ahead.alias("then")), "pairs")
    # one row for each different pair
    names = _numbered(pairs.groupBy("rank", "then").count(), "rank", ["then"], "names")
    deeper = settle(pairs.join(names.select("rank", "then", (F.col("rank") + F.col("below")).alias("deeper")), ["rank", "then"]).select("segment", "at", F.col("deeper").alias("rank")), "ranks")
    drop(pairs)
    drop(names)
    return deeper


def _runs(segments: DataFrame, ranks: DataFrame, step: int) -> DataFrame:
    """The shortest runs of step to 2 step - 1 lines: m, two ranks that tell them apart, and their place."""
    key = segments.schema["key"].dataType

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at, rank, forward, back = (table.column(c).to_numpy() for c in ("at", "rank", "forward", "back"))
        place = np.arange(len(at))
        f = (forward >= step) & (forward < 2 * step)
        b = (back >= step) & (back < 2 * step)
        start = np.concatenate([place[f], place[b] - back[b] + 1])
        size = np.concatenate([forward[f], back[b]])
        both = np.unique(start * 4096 + size)
        start, size = both // 4096, both % 4096
        row = pa.array(start)
        yield from pa.table([pa.array(size), pa.array(rank[start]), pa.array(rank[start + size - step]), *(table.column(c).take(row) for c in ("doc", "doc2", "key")), pa.array(at[start])], names=["m", "head", "tail", "doc", "doc2", "key", "at"]).combine_chunks().to_batches()

    schema = T.StructType([*_longs("m", "head", "tail", "doc", "doc2"), T.StructField("key", key), *_longs("at")])
    placed = segments.where(F.col("deepest") >= step)
    if step > 1:
        placed = placed.drop("rank").join(ranks, ["segment", "at"])
    return _whole(placed, ["segment"], lambda: work, schema)


def later_copies(lines: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc, doc2, at and m: m lines from the at-th line on that go, for they are in a run that occurs earlier as well.

    lines: doc, doc2, key, at, line, line2, words.  least must be below 4096.
    """
    first_ranks = _first_ranks(lines)
    segments = settle(_segments(lines, first_ranks, least), "segments")
    drop(first_ranks)
    found, step, level = [], 1, segments
    old = [segments]
    while True:
        if segments.where(F.col("deepest") >= step).isEmpty():
            break
        runs = settle(_runs(segments, level, step), "runs")
        # settled, so that the join sees two plain inputs and can split a run with very many copies
        first = settle(runs.groupBy("m", "head", "tail").agg(F.min(F.struct("key", "doc", "doc2", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
        own = (F.col("doc") == F.col("first.doc")) & (F.col("doc2") == F.col("first.doc2"))
        # the first copy's lines stay where a later one overlaps it
        begin = F.when(own, F.greatest("at", F.col("first.at") + F.col("m"))).otherwise(F.col("at"))
        again = runs.join(first, ["m", "head", "tail"]).where(~own | (F.col("at") != F.col("first.at")))
        found.append(settle(again.select("doc", "doc2", begin.alias("at"), (F.col("at") + F.col("m") - begin).alias("m")).distinct(), "later"))
        drop(runs)
        drop(first)
        deep = segments.where(F.col("deepest") >= 2 * step)
        if deep.isEmpty():
            break
        deep = deep.select("segment", "at", "rank") if step == 1 else deep.select("segment", "at").join(level, ["segment", "at"])
        level = _deeper(deep, step)
        old.append(level)
        step *= 2
    for table in old:
        drop(table)
    out = found[0] if found else lines.sparkSession.createDataFrame([], "doc long, doc2 long, at long, m long")
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (at, m) of each document that overlap or meet as one, two numbers of 32 bits each."""
    for batch in batches:
        packed = []
        for runs in batch.column("runs").to_pylist():
            out: list[list[int]] = []
            for at, m in sorted((r["at"], r["m"]) for r in runs):
                if out and at <= out[-1][0] + out[-1][1]:
                    out[-1][1] = max(out[-1][1], at + m - out[-1][0])
                else:
                    out.append([at, m])
            packed.append(np.array(out, "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc2"), pa.array(packed, pa.binary())], names=["__doc", "__doc2", "__runs"])


def without(texts: TextBatch, runs: list[list[tuple[int, int]]]) -> tuple[list[str], np.ndarray]:
    """Each text without the lines of its runs (first line with a word, number of them), and the number of lines that went."""
    starts, ends, owner, words = texts.lines
    bounds = np.searchsorted(owner, np.arange(texts.n + 1))
    out, gone = [], np.zeros(texts.n, np.int64)
    data = texts.data.tobytes()
    for k in range(texts.n):
        lo, hi = texts.bounds[k], texts.bounds[k + 1]
        if not runs[k]:
            out.append(data[lo:hi].decode())
            continue
        s, e, full = starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], words[bounds[k] : bounds[k + 1]] > 0
        number = np.cumsum(full)  # of lines with a word up to here
        change = np.zeros(number[-1] + 2, np.int64)
        for at, m in runs[k]:
            change[at] += 1
            change[at + m] -= 1
        deleted = np.cumsum(change) > 0
        cut = (number > 0) & deleted[np.maximum(number - 1, 0)]
        out.append("\n".join(data[i:j].decode() for i, j in zip(s[~cut], e[~cut], strict=True)))
        gone[k] = int(cut[full].sum())
    return out, gone


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_WORDS, counts: tuple[str, str, str] = ("lines_deleted", "words_before", "words_left")) -> DataFrame:
    """df with later copies deleted from `text`, and three more columns, named by `counts`."""
    doc, doc2 = document_ids(key, text)
    docs = df.select(doc.alias("__doc"), doc2.alias("__doc2"), F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    lines = settle(_lines(docs), "lines")
    later = later_copies(lines, least)
    drop(lines)
    # as many runs as the document has lines, at most twice; put together where they meet
    lists = later.groupBy("doc", "doc2").agg(F.collect_list(F.struct("at", "m")).alias("runs"))
    runs = settle(lists.mapInArrow(_merged, "__doc long, __doc2 long, __runs binary"), "runs")
    few = runs.agg(F.count("*").alias("docs"), F.sum(F.length("__runs")).alias("bytes")).first()
    if few["docs"] + (few["bytes"] or 0) / 64 <= BROADCAST_DOCS:
        runs = F.broadcast(runs)
    columns = [f"__{i}" for i in range(len(df.columns))]
    marked = df.withColumns({"__doc": doc, "__doc2": doc2}).join(runs, ["__doc", "__doc2"], "left")
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in chunks(batch, columns[place]):
                cut, gone = without(b, [np.frombuffer(x, "<i4").reshape(-1, 2).tolist() if x else [] for x in part.column("__runs").to_pylist()])
                null = part.column(columns[place]).is_null().to_numpy(zero_copy_only=False)
                fresh = TextBatch.of(cut)
                new = pa.array(cut, pa.string(), mask=null)
                yield pa.RecordBatch.from_arrays([*(new if i == place else part.column(c) for i, c in enumerate(columns)), pa.array(gone), pa.array(b.n_words), pa.array(fresh.n_words)], names=[*columns, "__gone", "__before", "__left"])

    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(columns, df.schema, strict=True)), *(T.StructField(c, T.LongType()) for c in ("__gone", "__before", "__left"))])
    done = marked.select(*(F.col(c).alias(n) for c, n in zip(df.columns, columns, strict=True)), "__runs").mapInArrow(run, schema)
    return done.select(*(F.col(n).alias(c) for c, n in zip(df.columns, columns, strict=True)), *(F.col(n).alias(c) for c, n in zip(counts, ("__gone", "__before", "__left"), strict=True)))
