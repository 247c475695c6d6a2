"""N-gram Jaccard join by rare-first prefix filtering.

A document's set holds its distinct shingles of N words.  Equal sets are one
class, known by a fingerprint; the join works on classes.

1. Document frequencies.  Shingles go to groups by range of their hash, packed
   as arrays (8 bytes a shingle, and 12 for each document with one in the group).
   Where there are many groups they are dealt in steps, to FAN ranges at a time, so
   that arrays stay long.  A group counts in how many classes each of
   its shingles is, forgets those that are in one class only, and sends the
   others on to their classes with that frequency.  Shingles in a large share of
   all documents (`hot`) are found beforehand by adding up what each run of
   documents has most of; they don't go to groups and rank last.
2. Prefixes.  All shingles are ordered from rare to frequent.  Two sets that are
   similar enough have a shingle in common among the first n - ceil(t n) + 1 of
   each.  Shingles of one class only come first and match nothing, so a document
   that has enough of them is done: few documents are left.
3. Candidates.  Documents that have a prefix shingle in common are candidates if
   lengths allow it, if enough shingles follow at their places (positional
   filter) and if the counts of the remaining shingles in cells of the hash
   leave enough in common (suffix filter).  A shingle with more than TOGETHER postings
   is split by size band and salt; blocks of one band or of adjacent ones meet, each two
   in a task of their own, so that no task holds more than two blocks of a shingle.
4. Verification.  Each candidate pair is counted exactly, once.  What is wanted
   is components, so pairs that are already known to be connected needn't be
   looked at.  The first rounds verify a chain of candidates through each rare
   prefix shingle's documents, then some partners of what is still apart, which
   connects large groups of copies without making all of their pairs; the last
   round takes every remaining candidate pair between different components.

Shingles are told apart by 48 bits of a 64-bit hash, sets by 128 bits: 64 name a set,
and sets whose names clash are named by the other 64.  Words are runs of anything but space and U+0009-U+000D; A-Z count as a-z.
A text with fewer than N words has one shingle, all of its words; a null or empty
one has none and is linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import drop, gathered, settle
from .textbatch import TextBatch, chunks, mix, release

N = 5
PERCENT = 80

#: Shingles that a group of step 1 has, about; ranges that shingles are dealt to at a time; and the most tasks that groups share.
GROUP_SHINGLES, FAN, MOST_TASKS = 1_000_000, 512, 50_000
#: Shingles and documents that a task gathers before it sends them to their groups.
FLUSH_SHINGLES, FLUSH_DOCS = 1_000_000, 60_000
#: A run of documents has about so many bytes.
RUN_BYTES = 1 << 20
#: A shingle is hot in it if at least this many and one in HOT_SHARE have it ...
HOT_IN_RUN, HOT_SHARE = 8, 50
#: ... and hot if runs where it is make at least this many documents, and one in HOT_TOTAL.
#: So there are at most HOT_TOTAL times as many as a document has on average.
HOT_DOCS, HOT_TOTAL = 2000, 200
HOT_RANK = 0xFFFFFFFF
MOST_CLASHES = 10_000
CELLS = 256

#: Postings of a shingle in a block, about.
TOGETHER = 1000
#: Pairs that are looked at together.
PAIRS = 200_000
#: Partners that a document tries at a shingle in a round, and the most rounds before all pairs are tried.
TOSSES, CHAINS = 2, 3

_U = np.uint64
_LOW = _U(0xFFFF)


def shingle_keys(b: TextBatch, n: int = N) -> np.ndarray:
    """Sorted keys (48 bits of hash, 16 of the text's place) of the distinct shingles of up to 65536 texts."""
    hashes = b.word_hashes(lower=True)
    found = []
    for size in range(1, n + 1):
        starts, windows = b.windows(hashes, size)
        if size < n:  # only texts that have just so many words
            whole = b.n_words[b.word_text[starts]] == size
            starts, windows = starts[whole], windows[whole]
        found.append((windows & ~_LOW) | b.word_text[starts].astype(np.uint64))
    keys = np.concatenate(found)
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


@dataclass
class Sets:
    """Distinct shingles of a batch of texts."""

    keys: np.ndarray  # sorted
    size: np.ndarray  # of each text's set
    mark: np.ndarray  # its fingerprint
    other: np.ndarray  # a second one

    @classmethod
    def of(cls, b: TextBatch, n: int = N, clashing: np.ndarray | None = None) -> Sets:
        """clashing: fingerprints that different sets have; the second one takes their place."""
        keys = shingle_keys(b, n)
        owner = (keys & _LOW).astype(np.uint16)
        size = np.bincount(owner, minlength=b.n)
        mark, other = np.zeros(b.n, np.uint64), np.zeros(b.n, np.uint64)
        if len(keys):
            order = np.argsort(owner, kind="stable")
            full = np.flatnonzero(size)
            first = np.concatenate([[0], np.cumsum(size)])[full]
            values = mix((keys & ~_LOW) + _U(1))[order]
            mark[full] = mix(np.add.reduceat(values, first) + size[full].astype(np.uint64))
            other[full] = mix(np.add.reduceat(mix(values ^ _U(0x9E3779B97F4A7C15)), first) ^ size[full].astype(np.uint64))
        if clashing is not None and len(clashing):
            mark = np.where(np.isin(mark, clashing), other, mark)
        return cls(keys, size, mark, other)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and end."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.append(starts[1:], len(values))


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The fewest common shingles with which sets of sizes a and b are linked."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


# ---- step 0: classes and hot shingles -----------------------------------------


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: a row's key, set size and fingerprints; kind 1: a shingle (mark) that is hot in runs of so many (size) documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        hot: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part, b in chunks(batch, "__text", RUN_BYTES):
                sets = Sets.of(b, n)
                kind = part.column("__key").type
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.n, np.int32)), part.column("__key"), pa.array(sets.size.astype(np.int64)), pa.array(sets.mark.view(np.int64)), pa.array(sets.other.view(np.int64))], names=["kind", "key", "size", "mark", "other"])
                # each class once
                _, firsts = np.unique(sets.mark, return_index=True)
                once = np.zeros(b.n, bool)
                once[firsts] = True
                shingles = sets.keys[once[sets.keys & _LOW]] & ~_LOW
                heads, ends = runs(shingles)
                count = ends - heads
                many = count >= max(HOT_IN_RUN, b.n // HOT_SHARE)
                if many.any():
                    hot.append((shingles[heads[many]], count[many]))
                if sum(len(x) for x, _ in hot) > 500_000:
                    hot = [_added(hot)]
        if hot:
            shingles, count = _added(hot)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(count), np.int32)), pa.nulls(len(count), kind), pa.array(count.astype(np.int64)), pa.array(shingles.view(np.int64)), pa.array(np.zeros(len(count), np.int64))], names=["kind", "key", "size", "mark", "other"])

    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", docs.schema["__key"].dataType), T.StructField("size", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("other", T.LongType())])
    return docs.mapInArrow(run, schema)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)


# ---- step 1: document frequencies -----------------------------------------------


def _six(hashes: np.ndarray) -> bytes:
    """48-bit values (in the upper bits) as 6 bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unsix(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = data.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _group(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Groups by range of the hash's upper 32 bits."""
    return ((hashes >> _U(32)) * _U(groups)) >> _U(32)


_SENT = "grp long, hot boolean, marks binary, sizes binary, shingles binary, docs binary"
_COUNTED = "grp long, marks binary, sizes binary, counts binary, shingles binary, ranks binary"
_SENT_SCHEMA = pa.schema([("grp", pa.int64()), ("hot", pa.bool_()), *((c, pa.binary()) for c in ("marks", "sizes", "shingles", "docs"))])
#: Bytes of packed rows that go to Spark together.
BATCH_BYTES = 1 << 20


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r.values() if isinstance(x, bytes))
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(place: np.ndarray, h: np.ndarray, doc: np.ndarray, mark: np.ndarray, size: np.ndarray, is_hot: bool) -> Iterator[dict]:
    """A packed row for each place: the marks and sizes of its documents, its shingles, and whose they are."""
    if not len(place):
        return
    low = int(place.min())
    place = (place - _U(low)).astype(np.uint16 if int(place.max()) - low < 1 << 16 else np.uint64)
    order = np.argsort(place, kind="stable")
    place, h, doc = place[order], h[order], doc[order]
    del order
    for a, z in zip(*runs(place), strict=True):
        if len(mark) <= z - a:
            flag = np.zeros(len(mark), bool)
            flag[doc[a:z]] = True
            there, number = np.flatnonzero(flag), (np.cumsum(flag) - 1)[doc[a:z]]
        else:
            there, number = np.unique(doc[a:z], return_inverse=True)
        for lo in range(0, len(there), 1 << 16):  # numbers have 16 bits
            mine = (number >= lo) & (number < lo + (1 << 16)) if len(there) > 1 << 16 else slice(None)
            own = there[lo : lo + (1 << 16)]
            yield {"grp": low + int(place[a]), "hot": is_hot, "marks": mark[own].tobytes(), "sizes": size[own].astype("<u4").tobytes(), "shingles": _six(h[a:z][mine]), "docs": (number[mine] - lo).astype("<u2").tobytes()}


def _send(docs: DataFrame, n: int, groups: int, step: int, hot: np.ndarray, clashing: np.ndarray) -> DataFrame:
    """Shingles of each class of a run of documents, packed by range of `step` groups; hot ones by group of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = n_docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_docs
            if held:
                mark, size = np.concatenate(marks), np.concatenate(sizes)
                h, doc = np.concatenate(shingles), np.concatenate(owners)
                _, firsts = np.unique(mark, return_index=True)
                once = np.zeros(len(mark), bool)
                once[firsts] = True
                mine = once[doc]
                if not mine.all():
                    h, doc = h[mine], doc[mine]
                for x in (shingles, owners):
                    x.clear()
                warm = np.isin(h, hot) if len(hot) else np.zeros(0, bool)
                if warm.any():
                    own = doc[warm]
                    yield from _batched(_rows(mark[own] % _U(groups) // _U(step), h[warm], own, mark, size, True), _SENT_SCHEMA)
                    h, doc = h[~warm], doc[~warm]
                del mine, warm
                yield from _batched(_rows(_group(h, groups) // _U(step), h, doc, mark, size, False), _SENT_SCHEMA)
            for x in (shingles, owners, marks, sizes):
                x.clear()
            held = n_docs = 0
            release()

        for batch in batches:
            for _, b in chunks(batch, "__text"):
                if n_docs + b.n > FLUSH_DOCS:
                    yield from flush()
                sets = Sets.of(b, n, clashing)
                shingles.append(sets.keys & ~_LOW)
                owners.append((sets.keys & _LOW).astype(np.int32) + np.int32(n_docs))
                marks.append(sets.mark)
                sizes.append(sets.size)
                held += len(sets.keys)
                n_docs += b.n
                if held > FLUSH_SHINGLES:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, _SENT)


def _dealt(sent: DataFrame, ranges: int) -> DataFrame:
    """Packed rows with those of one range next to each other; tasks have equally many ranges."""
    tasks = min(ranges, MOST_TASKS)
    return sent.repartitionById(tasks, F.expr(f"cast(grp % {tasks} as int)")).sortWithinPartitions("grp")


def _finer(sent: DataFrame, groups: int, coarse: int, step: int) -> DataFrame:
    """Packed rows by range of `coarse` groups, dealt to ranges of `step` groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                table = pa.Table.from_batches(held)
                for is_hot in (False, True):
                    part = table.filter(table.column("hot") if is_hot else pc.invert(table.column("hot")))
                    if part.num_rows:
                        h, doc, mark, sizes = _opened(part)
                        place = mark[doc] % _U(groups) if is_hot else _group(h, groups)
                        yield from _batched(_rows(place // _U(step), h, doc, mark, sizes, is_hot), _SENT_SCHEMA)
            held.clear()
            size = 0
            release()

        for batch in batches:
            for i in range(batch.num_rows):
                grp = batch.column("grp")[i].as_py()
                if grp != last or size > FLUSH_SHINGLES:
                    yield from flush()
                held.append(batch.slice(i, 1))
                size += len(batch.column("docs")[i].as_buffer()) // 2
                last = grp
        yield from flush()

    return _dealt(sent, -(-groups // coarse)).mapInArrow(run, _SENT)


def _by_group(sent: DataFrame, groups: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs work over the packed rows of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            for a, z in zip(*runs(grp), strict=True):
                if held and grp[a] != last:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, z - a))
                last = grp[a]
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return _dealt(sent, groups).mapInArrow(run, schema)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as one array, and how many items each has."""
    parts = [np.frombuffer(x.as_buffer(), kind) for c in column.chunks for x in c]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def _opened(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of packed rows and the place of each one's class; marks and sizes of the different classes."""
    marks, n_marks = _joined(part.column("marks"), "<u8")
    sizes, _ = _joined(part.column("sizes"), "<u4")
    raw, _ = _joined(part.column("shingles"), np.uint8)
    h = _unsix(raw)
    del raw
    docs, n_docs = _joined(part.column("docs"), "<u2")
    mark, first, which = np.unique(marks, return_index=True, return_inverse=True)
    base = np.repeat(np.concatenate([[0], np.cumsum(n_marks)[:-1]]), n_docs)
    base += docs
    return h, which[base], mark, sizes[first]


def _count(groups: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for is_hot in (False, True):
            part = table.filter(table.column("hot") if is_hot else pc.invert(table.column("hot")))
            if not part.num_rows:
                continue
            h, doc, mark, size = _opened(part)
            doc = doc.astype(np.uint32)
            # hash, then class, in one sortable number: the group's hashes span a part of the range
            low = h.min()
            bits = max(int(len(mark) - 1).bit_length(), 1)
            span = (int(h.max() - low) >> 16).bit_length()
            if span + bits <= 64:
                key = h
                key -= low
                key >>= _U(16)
                key <<= _U(bits)
                key |= doc
                key.sort()
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                doc = (key & _U((1 << bits) - 1)).astype(np.int64)
                h = ((key >> _U(bits)) << _U(16)) + low
            else:
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
                h, doc = h[new], doc[new]
            if is_hot:
                rank = np.full(len(h), HOT_RANK, np.uint32)
            else:
                heads, ends = runs(h)
                df = ends - heads
                rank = np.repeat(df, df).astype(np.uint32)
                common = rank > 1
                h, doc, rank = h[common], doc[common], rank[common]
            out += list(_by_class(mark, size, h, doc, rank, groups))
        del table, part
        release()
        return pa.Table.from_pylist(out, schema=_COUNTED_SCHEMA)

    return run


_COUNTED_SCHEMA = pa.schema([("grp", pa.int64()), *((c, pa.binary()) for c in ("marks", "sizes", "counts", "shingles", "ranks"))])


def _by_class(mark: np.ndarray, size: np.ndarray, h: np.ndarray, doc: np.ndarray, rank: np.ndarray, groups: int) -> Iterator[dict]:
    """Packed rows by group of the class."""
    home = (mark % _U(groups)).astype(np.int64)
    order = np.lexsort((doc, home[doc]))
    h, doc, rank = h[order], doc[order], rank[order]
    place = home[doc]
    for a, z in zip(*runs(place), strict=True):
        own, count = np.unique(doc[a:z], return_counts=True)
        yield {"grp": int(place[a]), "marks": mark[own].tobytes(), "sizes": size[own].astype("<u4").tobytes(), "counts": count.astype("<u4").tobytes(), "shingles": _six(h[a:z]), "ranks": rank[a:z].astype("<u4").tobytes()}


# ---- step 2: classes that may have a partner --------------------------------------

_ALIVE = "mark long, size long, alone long, prefix binary, common binary, cells binary"


def _alive(percent: int):
    def run(table: pa.Table) -> pa.Table:
        marks, _ = _joined(table.column("marks"), "<u8")
        sizes, _ = _joined(table.column("sizes"), "<u4")
        counts, _ = _joined(table.column("counts"), "<u4")
        raw, _ = _joined(table.column("shingles"), np.uint8)
        h = _unsix(raw)
        rank, _ = _joined(table.column("ranks"), "<u4")
        mark, first, which = np.unique(marks, return_index=True, return_inverse=True)
        size = sizes[first].astype(np.int64)
        doc = np.repeat(which, counts)
        alone = size - np.bincount(doc, minlength=len(mark))
        prefix = prefix_size(size, percent)
        stays = alone < prefix
        mine = stays[doc]
        h, doc, rank = h[mine], doc[mine], rank[mine]
        order = np.lexsort((h, rank, doc))
        h, doc = h[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(mark) + 1))
        rows = []
        for k in np.flatnonzero(stays):
            own = h[bounds[k] : bounds[k + 1]]
            cells = np.minimum(np.bincount((own >> _U(16)).astype(np.int64) % CELLS, minlength=CELLS), 0xFFFF)
            rows.append({"mark": int(mark[k : k + 1].view(np.int64)[0]), "size": int(size[k]), "alone": int(alone[k]), "prefix": own[: prefix[k] - alone[k]].tobytes(), "common": _six(np.sort(own)), "cells": cells.astype("<u2").tobytes()})
        del table
        release()
        return pa.Table.from_pylist(rows, schema=_ALIVE_SCHEMA)

    return run


_ALIVE_SCHEMA = pa.schema([("mark", pa.int64()), ("size", pa.int64()), ("alone", pa.int64()), ("prefix", pa.binary()), ("common", pa.binary()), ("cells", pa.binary())])


# ---- step 3: candidates ------------------------------------------------------------

_POSTED = "shingle long, mark long, size long, at long, root long"


def _postings(alive: DataFrame, first: int | None = None) -> DataFrame:
    """A row for each prefix shingle (of the first `first` ones) of each class; alive has a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [np.frombuffer(x.as_buffer(), "<u8")[:first] for x in part.column("prefix")]
                n = np.array([len(x) for x in own])
                if not n.sum():
                    continue
                which = pa.array(np.repeat(np.arange(len(n)), n))
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                places = pa.array(np.repeat(part.column("alone").to_numpy(), n) + place)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), part.column("mark").take(which), part.column("size").take(which), places, part.column("root").take(which)], names=["shingle", "mark", "size", "at", "root"])

    return alive.mapInArrow(run, _POSTED)


def _allowed(i: np.ndarray, j: np.ndarray, size: np.ndarray, at: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and suffix filters for pairs of postings of one shingle."""
    a, b = size[i], size[j]
    need = least_overlap(a, b, percent)
    ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (1 + np.minimum(a - at[i], b - at[j]) - 1 >= need)
    if ok.any():
        left = np.flatnonzero(ok)
        for s in range(0, len(left), 20_000):
            k = left[s : s + 20_000]
            ok[k] = np.minimum(cells[i[k]], cells[j[k]]).sum(1, dtype=np.int64) >= need[k]
    return ok


def _chained(shingle: np.ndarray, mark: np.ndarray, size: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    toss = mix(mark.view(np.uint64) ^ mix(shingle.view(np.uint64)))
    order = np.lexsort((toss, size, shingle))
    i, j = order[:-1], order[1:]
    other = (shingle[i] == shingle[j]) & (root[i] != root[j])
    return i[other], j[other]


def _tossed(shingle: np.ndarray, mark: np.ndarray, root: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((mark, root, shingle))
    s, r = shingle[order], root[order]
    starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]))
    sizes = np.diff(np.append(starts, len(s)))
    # the largest component of each shingle
    by_size = np.lexsort((starts, -sizes, s[starts]))
    largest = np.zeros(len(starts), bool)
    largest[by_size[np.concatenate([[True], s[starts][by_size][1:] != s[starts][by_size][:-1]])]] = True
    asks = np.flatnonzero(~np.repeat(largest, sizes))
    first, last = runs(s)
    which = np.searchsorted(first, asks, side="right") - 1
    found_i, found_j = [], []
    for k in range(TOSSES):
        toss = mix(mark[order][asks].view(np.uint64) ^ mix(s[asks].view(np.uint64) + _U(seed * TOSSES + k)))
        other = first[which] + (toss % (last - first)[which].astype(np.uint64)).astype(np.int64)
        apart = r[other] != r[asks]
        found_i.append(order[asks[apart]])
        found_j.append(order[other[apart]])
    return np.concatenate(found_i), np.concatenate(found_j)


def _apart(alive: DataFrame, first: int | None, chain: int, percent: int) -> DataFrame:
    """Postings of the shingles that different components have, with the cells of their classes, by meeting (`meet`).

    A shingle with at most TOGETHER postings is one meeting.  Others are split into blocks by
    band of size and salt.  In chains, each block is a meeting, anew in each round.  For all pairs
    of different components, blocks of the shingle's largest component and blocks of its other
    postings meet, and the latter each other, if their sizes can be similar; `side` tells
    the two of a meeting apart.
    """
    light = _postings(alive.drop("common", "cells"), first)
    by_root = light.groupBy("shingle", "root").count()
    mixed = by_root.groupBy("shingle").agg(F.count("*").alias("roots"), F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("most")).where("roots > 1")
    blocks = lambda n: F.ceil(n / TOGETHER)
    mixed = mixed.select("shingle", F.col("most.root").alias("main"), (F.col("n") > TOGETHER).alias("split"), blocks(F.col("n")).alias("all"), blocks(F.col("most.count")).alias("mains"), blocks(F.col("n") - F.col("most.count")).alias("rests"))
    # sets that can be similar are of one band or of adjacent ones
    band = F.floor(F.log("size") / math.log(100 / percent)).cast("long") if percent < 100 else F.col("size")
    block = lambda salts: band * F.col(salts) + F.pmod(F.xxhash64("mark", "shingle", F.lit(chain)), F.col(salts))
    near = lambda salts: F.sequence((band - 1) * F.col(salts), (band + 2) * F.col(salts) - 1)
    meeting = lambda kind, x, y, side: F.struct(F.xxhash64("shingle", F.lit(kind), x, y).alias("meet"), side.cast("long").alias("side"))
    zero = F.lit(0).cast("long")
    whole = F.array(meeting(0, zero, zero, zero))
    if chain:
        places = F.when(F.col("split"), F.array(meeting(1, block("all"), zero, zero))).otherwise(whole)
    else:
        # few others are one block of all sizes
        one = F.col("rests") == 1
        rest, rests = F.when(one, zero).otherwise(block("rests")), F.when(one, F.array(zero)).otherwise(near("rests"))
        order = lambda x: F.when(rest == x, 0).when(rest < x, 1).otherwise(2)
        of_main = F.transform(rests, lambda x: meeting(2, block("mains"), x, F.lit(1)))
        of_rest = F.concat(F.transform(near("mains"), lambda x: meeting(2, x, rest, F.lit(2))), F.transform(rests, lambda x: meeting(3, F.least(rest, x), F.greatest(rest, x), order(x))))
        places = F.when(~F.col("split"), whole).when(F.col("root") == F.col("main"), of_main).otherwise(of_rest)
    placed = light.join(mixed, "shingle").select(F.explode(places).alias("p"), "mark", "size", "at", "root").select("p.meet", "p.side", "mark", "size", "at", "root")
    return placed.join(alive.select("mark", "cells"), "mark")


def _partners(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of postings of different components that may be similar, of each meeting: i, j."""
    meet, side, size, root = (table.column(c).to_numpy() for c in ("meet", "side", "size", "root"))
    order = np.lexsort((size, meet))
    for lo, hi in zip(*runs(meet[order]), strict=True):
        own = order[lo:hi]
        if hi - lo < 2 or (root[own] == root[own[0]]).all():
            continue
        ones, twos = own[side[own] < 2], own[side[own] != 1]
        # by size: partners are those that are neither too short nor too long; within a block, those after it
        near, far = np.searchsorted(size[twos], -(-size[ones] * percent // 100)), np.searchsorted(size[twos], size[ones] * 100 // percent, side="right")
        if side[own[0]] == 0:
            near = np.maximum(near, np.arange(len(ones)) + 1)
        count = np.maximum(far - near, 0)
        cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()) + PAIRS, PAIRS)) + 1 if len(count) else []
        a = 0
        for z in cuts:
            n = count[a:z]
            i = np.repeat(ones[a:z], n)
            j = twos[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(near[a:z], n)]
            apart = root[i] != root[j]
            if apart.any():
                yield i[apart], j[apart]
            a = z


def _candidates(postings: DataFrame, chain: int, percent: int) -> DataFrame:
    """Pairs (a < b) of classes of different components that have a prefix shingle in common and pass the filters.

    chain 1: a meeting's documents in order of size, each paired with the next;
    2 and more, the number of the round: documents outside of the meeting's
    largest component paired with TOSSES others, chosen anew in each round;
    0: every pair of different components.  Postings arrive sorted by meeting;
    one meeting's are looked at together, each in about 600 bytes.
    """

    def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        meet, mark, size, at, root = (table.column(c).to_numpy() for c in ("meet", "mark", "size", "at", "root"))
        cells = np.frombuffer(b"".join(x.as_py() for x in table.column("cells")), "<u2").reshape(-1, CELLS)
        found = iter([_chained(meet, mark, size, root) if chain == 1 else _tossed(meet, mark, root, chain)]) if chain else _partners(table, percent)
        for i, j in found:
            ok = _allowed(i, j, size, at, cells, percent)
            yield mark[i[ok]], mark[j[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for x, y in pairs(table):
                held.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
                size += len(x)
                if size > PAIRS:
                    yield from emit(np.concatenate(held))
                    held, size = [], 0
            if size:
                yield from emit(np.concatenate(held))

        def emit(found: np.ndarray) -> Iterator[pa.RecordBatch]:
            # a pair comes up at many shingles: what this task has seen lately isn't sent again
            nonlocal seen
            key = mix(found[:, 0].view(np.uint64) * _U(3) + mix(found[:, 1].view(np.uint64))).view(np.int64)
            key, first = np.unique(key, return_index=True)
            new = ~np.isin(key, seen, assume_unique=True)
            found = found[first[new]]
            seen = np.concatenate([seen, key[new]]) if len(seen) < 1_000_000 else key[new]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # rows are looked at once there are enough, up to the last meeting's beginning; a meeting has few
            meet = batch.column("meet").to_numpy()
            a = 0
            while a < len(meet):
                z = len(meet)
                if size < 20_000:
                    z = min(z, a + 20_000)
                    held.append(batch.slice(a, z - a))
                    size, a = size + z - a, z
                    continue
                last = held[-1].column("meet")[-1].as_py()
                z = a + int(np.searchsorted(meet[a:] != last, True))
                if z > a:
                    held.append(batch.slice(a, z - a))
                    size += z - a
                if z < len(meet):
                    yield from out(pa.Table.from_batches(held))
                    held, size = [], 0
                a = z
        if size:
            yield from out(pa.Table.from_batches(held))

    return gathered(postings.select("meet", "side", "mark", "size", "at", "root", "cells"), ["meet"]).mapInArrow(run, "a long, b long").distinct()


# ---- step 4: verification ------------------------------------------------------------


def _verified(pairs: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """a, b and whether they are linked."""
    sets = alive.select("mark", "size", "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            held, own = None, None
            for k, (a, s, t, x, y) in enumerate(zip(*(batch.column(c) for c in ("a", "size_a", "size_b", "common_a", "common_b")), strict=True)):
                if a != held:
                    held, own = a, _unsix(np.frombuffer(x.as_buffer(), np.uint8))
                other = _unsix(np.frombuffer(y.as_buffer(), np.uint8))
                place = np.searchsorted(own, other)
                place[place == len(own)] = 0
                both = int((own[place] == other).sum()) if len(own) else 0
                linked[k] = 100 * both >= percent * (s.as_py() + t.as_py() - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    left = sets.select(F.col("mark").alias("a"), F.col("size").alias("size_a"), F.col("common").alias("common_a"))
    right = sets.select(F.col("mark").alias("b"), F.col("size").alias("size_b"), F.col("common").alias("common_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, linked boolean")


def link_classes(alive: DataFrame, percent: int = PERCENT) -> DataFrame:
    """mark and root of every class that is linked with another."""
    looked = None  # all pairs verified so far
    tables: list[DataFrame] = []
    roots = None
    # chains through the two rarest prefix shingles first, then some partners at each shingle, as long as they link what was apart; then every pair
    chain, first = 1, 2
    while True:
        placed = alive.withColumn("root", F.col("mark")) if roots is None else alive.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
        pairs = _candidates(_apart(placed, first, chain, percent), chain, percent)
        if looked is not None:
            pairs = pairs.join(looked, ["a", "b"], "left_anti")
        more = settle(_verified(pairs, alive, percent), "verified")
        linked = more.where("linked").count()
        looked = more if looked is None else looked.unionAll(more)
        tables.append(more)
        if linked:
            roots = components(looked.where("linked").select("a", "b")).withColumnRenamed("node", "mark")
        if not chain:
            break
        chain = chain + 1 if first or (linked and chain < CHAINS) else 0
        first = None
    for table in tables:
        drop(table)
    return roots if roots is not None else alive.sparkSession.createDataFrame([], "mark long, root long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row of df.

    Rows with equal keys are rows of their own with one component_id if their sets agree.  A null key
    is never a component's smallest key unless it is alone.
    """
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = settle(_classes(docs, n), "classes")
    rows = found.where("kind = 0").select("key", "size", "mark", "other")
    clashes = rows.groupBy("mark").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low < high").select("mark")
    # different sets with one fingerprint of 64 bits: a handful among 10**10
    clashing = np.array([r["mark"] for r in clashes.limit(MOST_CLASHES + 1).collect()], np.int64)
    if len(clashing) > MOST_CLASHES:
        raise RuntimeError(f"more than {MOST_CLASHES} fingerprints clash")
    if len(clashing):
        rows = rows.withColumn("mark", F.when(F.col("mark").isin(clashing.tolist()), F.col("other")).otherwise(F.col("mark")))
    rows = rows.drop("other")
    total = rows.agg(F.sum("size").alias("shingles"), F.count("*").alias("docs")).first()
    groups = max(1, math.ceil((total["shingles"] or 0) / GROUP_SHINGLES))
    least = max(HOT_DOCS, total["docs"] // HOT_TOTAL)
    hot = found.where("kind = 1").groupBy("mark").agg(F.sum("size").alias("docs")).where(F.col("docs") >= least).select("mark").collect()
    hot = np.sort(np.array([r["mark"] for r in hot], np.int64).view(np.uint64))
    step = 1
    while groups > FAN * step:
        step *= FAN
    sent = _send(docs, n, groups, step, hot, clashing.view(np.uint64))
    while step > 1:
        sent, step = _finer(sent, groups, step, step // FAN), step // FAN
    counted = _by_group(sent, groups, _count(groups), _COUNTED)
    alive = settle(_by_group(counted, groups, _alive(percent), _ALIVE), "alive")
    roots = link_classes(alive, percent)
    drop(alive)
    placed = rows.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    full = placed.where("size > 0")
    # settled, so that the join sees two plain inputs and can split a component with very many rows
    lowest = settle(full.groupBy("root").agg(F.min("key").alias("component_id")), "lowest")
    joined = full.join(lowest, "root").select("key", "size", "component_id")
    empty = rows.where("size = 0").select("key", "size", F.col("key").alias("component_id"))
    return joined.unionAll(empty).select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")
