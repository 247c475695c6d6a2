"""Packing documents into token windows by lexical retrieval.

Documents are dealt by content into shards of about SHARD_TOKENS ids.  In its shard
every document has its place in a BM25 inverted index over token ids, whose document
frequencies, number of documents and mean length are the whole corpus's.  A seed
document opens a window; the index returns its nearest documents that haven't been
used, and those that fit are put in, best first.  What space is left is filled with
the beginning of the best remaining document, whose rest opens the next window.  So
every window of a shard is full but the last; that one is cut into windows whose
sizes are powers of two, which need no padding.

Shards by content: SIGNS min-hashes over a document's ids, in which an id counts by its
BM25 weight for rarity (idf), agree for two documents with odds of their weighted overlap.
Documents in order of these (then of a hash of contents and key) are cut into
shards, so copies and documents that share rare ids are in one shard, or in the next
if there are more of them than a shard holds.  The order is found from a table of a
few numbers a document; limits of partitions are its quantiles by ids, so
no partition and no shard grows with the data or with a repeated text.

A document's ids are those of its words and then END.  A null or empty text is END
alone.  Of a document with more than GIANT ids, whole windows are cut off first, in rows
of their own.  Repeated rows are documents of their own; all columns but key and text
are ignored.  Results don't depend on the order of rows or partitions: rows that agree
in key and text may change places, which can't be told.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, settle
from .textbatch import chunks, release
from .tokens import ragged, word_tokenizer

WINDOW = 4096
END = 2
#: Ids of a shard, about; a shard's documents are held by one task, with their index.
SHARD_TOKENS = 1 << 18
#: Ids that a partition has, about, and the most partitions and shards of one (they are parts of a number).
PART_TOKENS, MOST_PARTS, MOST_SHARDS = 1 << 21, 1 << 18, 1 << 13
MOST_TASKS = 50_000
#: Windows of a document in one row; a longer document has several.
GIANT_WINDOWS = 16
#: Min-hashes that order documents; 16 bits each.
SIGNS = 4
#: Text whose words are looked up together.
RUN_BYTES = 1 << 20
#: Documents whose ids are counted together.
AT_ONCE = 128
#: Row groups of the table of ids; writers hold one.
IDS_BYTES = 8 << 20
K1, B = 1.2, 0.75
#: An id that one in so many of a shard's documents has is one of many.
MANY = 8


@dataclass(frozen=True)
class Corpus:
    """What BM25 knows of all documents: how many there are, their mean length, and in how many of them each id is."""

    docs: int
    mean: float
    df: np.ndarray


class Bm25:
    """Inverted index of one shard's documents; without a corpus the shard is the corpus."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, corpus: Corpus | None = None):
        n = self.n = len(bounds) - 1
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        pairs, tf = np.unique(ids.astype(np.int64) * n + owner, return_counts=True)
        terms, docs = pairs // max(n, 1), pairs % max(n, 1)
        self.terms, first, df = np.unique(terms, return_index=True, return_counts=True)
        self.first = np.append(first, len(pairs))
        self.docs = docs
        every, mean, in_docs = (corpus.docs, corpus.mean, corpus.df[self.terms]) if corpus else (n, sizes.mean() if n else 0.0, df)
        self.idf = np.log1p((every - in_docs + 0.5) / (in_docs + 0.5))
        norm = K1 * (1 - B + B * sizes / max(mean, 1.0))
        self.weight = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm[docs])
        # ids that many documents have are rows of a table, the others lists; one that a single document has finds none
        place = np.full(len(self.terms), -1)
        many = df * MANY >= max(n, 1)
        place[many] = np.arange(many.sum())
        self.table = np.zeros((int(many.sum()), n))
        row = np.repeat(place, df)
        self.table[row[row >= 0], docs[row >= 0]] = self.weight[row >= 0]
        # terms of each document, by kind
        term = np.repeat(np.arange(len(self.terms)), df)
        self.rows, self.row_bounds = _by_document(row[row >= 0], docs[row >= 0], n)
        listed = (row < 0) & np.repeat(df > 1, df)
        self.own, self.own_bounds = _by_document(term[listed], docs[listed], n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share an id with the seed, the best first, ties by place."""
        score = self.table[self.rows[self.row_bounds[seed] : self.row_bounds[seed + 1]]].sum(0)
        query = self.own[self.own_bounds[seed] : self.own_bounds[seed + 1]]
        if len(query):
            heads, sizes = self.first[query], self.first[query + 1] - self.first[query]
            at = np.arange(sizes.sum()) + np.repeat(heads - np.cumsum(sizes) + sizes, sizes)
            score += np.bincount(self.docs[at], self.weight[at], self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def _by_document(values: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values in order of their document, and n + 1 bounds."""
    order = np.argsort(docs, kind="stable")
    return values[order], np.searchsorted(docs[order], np.arange(n + 1))


@dataclass(frozen=True)
class Piece:
    doc: int
    start: int
    length: int
    sequence: int
    offset: int


def pack_shard(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW, corpus: Corpus | None = None) -> list[Piece]:
    """Windows of one shard: every id in exactly one piece."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    index = Bm25(ids, bounds, corpus)
    unused = np.ones(n, bool)
    pieces: list[Piece] = []
    sequence, used = 0, 0  # the open window and its ids

    def put(doc: int, start: int, length: int) -> None:
        nonlocal sequence, used
        pieces.append(Piece(doc, start, length, sequence, used))
        used += length
        if used == window:
            sequence, used = sequence + 1, 0

    seed, start, lowest = -1, 0, 0
    while True:
        if seed < 0:
            while lowest < n and not unused[lowest]:
                lowest += 1
            if lowest == n:
                break
            seed, start = lowest, 0
            unused[seed] = False
        # the seed's ids, over as many windows as they take
        while start < sizes[seed]:
            length = int(min(window - used, sizes[seed] - start))
            put(seed, start, length)
            start += length
        last, seed = seed, -1
        if not used:
            continue
        near = index.neighbours(last, unused)
        for doc in near:
            if sizes[doc] <= window - used:
                unused[doc] = False
                put(int(doc), 0, int(sizes[doc]))
                if not used:
                    break
        if used:
            rest = near[unused[near]]
            if len(rest):
                seed, start = int(rest[0]), 0
                unused[seed] = False
    if used:
        pieces = [p for p in pieces if p.sequence < sequence] + _powers_of_two([p for p in pieces if p.sequence == sequence], sequence, used)
    return pieces


def _powers_of_two(tail: list[Piece], sequence: int, used: int) -> list[Piece]:
    """An unfilled window's pieces, cut anew into windows whose sizes are powers of two, largest first."""
    ends = np.cumsum([1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1])
    out = []
    for p in tail:
        start, at = p.start, p.offset
        while start < p.start + p.length:
            k = int(np.searchsorted(ends, at, side="right"))
            length = int(min(p.start + p.length - start, ends[k] - at))
            out.append(Piece(p.doc, start, length, sequence + k, at - (int(ends[k - 1]) if k else 0)))
            start, at = start + length, at + length
    return out


_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def id_kind(tokenizer: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if max(word_tokenizer(tokenizer).tokenizer.get_vocab_size(), END + 1) <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END, window: int = WINDOW) -> DataFrame:
    """doc_id, start, doc_tokens, whole and ids (END last) of every row of docs; of long ones, rows of whole windows go before."""
    giant = GIANT_WINDOWS * window
    kind = id_kind(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        for batch in batches:
            for part, b in chunks(batch, "__text", RUN_BYTES):
                ids, bounds = words.encode(b)
                bounds_out = bounds + np.arange(b.n + 1)
                out = np.full(len(ids) + b.n, end, kind)
                keep = np.ones(len(out), bool)
                keep[bounds_out[1:] - 1] = False
                out[keep] = ids
                sizes = np.diff(bounds_out)
                rows = np.maximum(-(-sizes // giant), 1)
                owner = np.repeat(np.arange(b.n), rows)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)) * giant
                cuts = np.append(bounds_out[owner] + start, bounds_out[-1])
                last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
                place = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column("__key").take(place), pa.array(start), pa.array(sizes[owner]), pa.array(~last), ragged(out, cuts)], names=["doc_id", "start", "doc_tokens", "whole", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, schema)


def _few(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a few documents, and their ids in a row."""
    raw = [x.as_buffer() for x in column]
    return np.array([r.size // np.dtype(kind).itemsize for r in raw], np.int64), np.frombuffer(b"".join(raw), kind)


def corpus_of(tokens: DataFrame, kind: str = "<u4") -> Corpus:
    """Statistics of all rows of `tokens` (without whole windows cut off); ids are a tokenizer's, so there are few different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, size = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                sizes, ids = _few(batch.column("ids").slice(at, AT_ONCE), kind)
                wide = np.uint32 if kind == "<u2" and AT_ONCE <= 1 << 16 else np.uint64
                bits = 16 if wide is np.uint32 else 32
                pairs = np.sort(np.repeat(np.arange(len(sizes), dtype=wide), sizes) << wide(bits) | ids.astype(wide))
                first = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, bool)
                found = np.bincount((pairs[first] & wide((1 << bits) - 1)).astype(np.int64))
                df = np.pad(df, (0, max(0, len(found) - len(df))))
                df[: len(found)] += found
                docs, size = docs + len(sizes), size + int(sizes.sum())
            release()
        terms = np.flatnonzero(df)
        # ids -1 and -2 stand for the number of documents and of all their ids
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(df[terms], [docs, size]))], names=["id", "n"])

    got = {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    docs, size = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(max(got, default=-1) + 1, np.int64)
    df[list(got)] = list(got.values())
    return Corpus(docs, size / max(docs, 1), df)


def orders(corpus: Corpus, signs: int = SIGNS) -> tuple[np.ndarray, np.ndarray]:
    """For each sign, all ids in order of random waiting times, which are the shorter the rarer an id is, and each id's place there.

    A document's min-hash is the first of its ids.
    """
    idf = np.log1p((corpus.docs - corpus.df + 0.5) / (corpus.df + 0.5))
    # an id of one document only can't be shared
    waits = np.where(corpus.df > 1, np.random.default_rng(10).exponential(size=(signs, len(corpus.df))) / np.maximum(idf, 1e-12), np.inf)
    ids = np.argsort(waits, axis=1, kind="stable")
    places = np.empty_like(ids)
    np.put_along_axis(places, ids, np.arange(ids.shape[1])[None, :], 1)
    return ids.astype(np.uint32), places.astype(np.uint32)


def _signed(column: pa.Array, order: tuple[np.ndarray, np.ndarray], kind: str) -> np.ndarray:
    """64 bits for each document: its min-hashes, the first one highest.  A document has one id at least."""
    sizes, ids = _few(column, kind)
    heads = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint64)
    for first, place in zip(*order, strict=True):
        least = first[np.minimum.reduceat(place[ids], heads)]
        out = (out << np.uint64(16)) | (least.astype(np.uint64) & np.uint64(0xFFFF))
    return (out ^ np.uint64(1 << 63)).view(np.int64)  # in order as signed numbers


def _limits(ordered: DataFrame, parts: int, total: int) -> np.ndarray:
    """First (sign, mix, row) of each part but the first: the quantiles by ids of all documents in that order."""
    step = -(-total // parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            after = upto + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sign", "mix", "row", "part")), pa.array((after - size).astype(np.int64)), pa.array(after.astype(np.int64))], names=["sign", "mix", "row", "part", "before", "after"])
            upto = int(after[-1]) if len(after) else upto

    added = settle(ordered.repartitionByRange("sign", "mix", "row").sortWithinPartitions("sign", "mix", "row").withColumn("part", F.spark_partition_id()).mapInArrow(add, "sign long, mix long, row long, part int, before long, after long"), "places")
    # one number for each partition
    totals = sorted((r["part"], r["n"]) for r in added.groupBy("part").agg(F.max("after").alias("n")).collect())
    offset = F.create_map(*(F.lit(x) for (part, _), n in zip(totals, np.cumsum([0, *(n for _, n in totals)]), strict=False) for x in (part, int(n))))
    # a part begins where the ids before it pass a multiple of `step`: at most `parts` rows
    first = added.select("sign", "mix", "row", (F.col("before") + offset[F.col("part")]).alias("b"), (F.col("after") + offset[F.col("part")]).alias("a")).where(F.floor((F.col("b") + step - 1) / step) * step < F.col("a"))
    found = sorted((r["sign"], r["mix"], r["row"]) for r in first.select("sign", "mix", "row").collect())
    drop(added)
    return np.array(found[1:], [("sign", "<i8"), ("mix", "<i8"), ("row", "<i8")])


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the shard times 2**32 plus the window's number in it; windows cut off
    from long documents beforehand have negative ones.
    """
    kind = id_kind(tokenizer)
    tokens = tokenize(docs, tokenizer, text, key, window=window).withColumn("row", F.monotonically_increasing_id())
    tokens = settle(tokens, "tokens", {"parquet.block.size": IDS_BYTES, "parquet.enable.dictionary": "false"})
    rest = tokens.where("not whole").select("row", "doc_id", "start", "doc_tokens", "ids")
    corpus = corpus_of(rest, kind)
    total = round(corpus.mean * corpus.docs)
    parts = max(1, min(MOST_PARTS, -(-total // part_tokens)))
    order = orders(corpus)
    # documents of one sign in an order that has nothing to do with their rows
    marked = rest.withColumn("mix", F.xxhash64("ids", "doc_id"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                few = batch.slice(at, AT_ONCE)
                size = [x.as_buffer().size // np.dtype(kind).itemsize for x in few.column("ids")]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(few.column("ids"), order, kind)), few.column("mix"), few.column("row"), pa.array(size, pa.int64())], names=["sign", "mix", "row", "size"])
            release()

    signs = settle(marked.select("ids", "mix", "row").mapInArrow(sign, "sign long, mix long, row long, size long"), "signs")
    limits = _limits(signs, parts, total) if parts > 1 else np.zeros(0, [("sign", "<i8"), ("mix", "<i8"), ("row", "<i8")])
    drop(signs)
    columns = rest.columns
    keyed = T.StructType([T.StructField("part", T.LongType()), T.StructField("sign", T.LongType()), T.StructField("mix", T.LongType()), *rest.schema.fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                few = batch.slice(at, AT_ONCE)
                own = np.zeros(few.num_rows, limits.dtype)
                own["sign"], own["mix"], own["row"] = _signed(few.column("ids"), order, kind), few.column("mix").to_numpy(), few.column("row").to_numpy()
                part = np.searchsorted(limits, own, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(own["sign"]), few.column("mix"), *(few.column(c) for c in columns)], names=keyed.names)
            release()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, shard, size = -1, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                few = batch.slice(at, AT_ONCE)
                sizes = np.array([x.as_buffer().size // np.dtype(kind).itemsize for x in few.column("ids")])
                own = few.column("part").to_numpy()
                lo = 0
                for i in range(few.num_rows):
                    if own[i] != part or size + sizes[i] > shard_tokens and size:
                        held.append(few.slice(lo, i - lo))
                        if size:
                            yield packed(pa.Table.from_batches(held), part * MOST_SHARDS + shard)
                        shard = shard + 1 if own[i] == part else 0
                        if shard >= MOST_SHARDS:
                            raise RuntimeError(f"a part has more than {MOST_SHARDS} shards")
                        held, size, lo, part = [], 0, i, int(own[i])
                    size += int(sizes[i])
                held.append(few.slice(lo))
        if size:
            yield packed(pa.Table.from_batches(held), part * MOST_SHARDS + shard)

    def packed(group: pa.Table, shard: int) -> pa.RecordBatch:
        keys = group.column("doc_id").to_numpy(zero_copy_only=False)
        raw = [memoryview(x.as_buffer()) for c in group.column("ids").chunks for x in c]
        taken = sorted(range(len(raw)), key=lambda i: (keys[i] is None or keys[i] != keys[i], keys[i] if keys[i] == keys[i] else 0, len(raw[i]), zlib.crc32(raw[i])))
        arrays = [np.frombuffer(raw[i], kind) for i in taken]
        bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)])
        ids = np.concatenate(arrays).astype("<u4")
        found = pack_shard(ids, bounds, window, corpus)
        doc, start, length, sequence, offset = (np.array([getattr(p, f) for p in found], np.int64) for f in ("doc", "start", "length", "sequence", "offset"))
        crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(bounds[doc] + start, length, strict=True)]
        place = pa.array(np.array(taken, np.int64)[doc])
        before = group.column("start").to_numpy()[taken]
        out = pa.RecordBatch.from_arrays([
            pa.concat_arrays(group.column("doc_id").chunks).take(place), pa.array(before[doc] + start), pa.array(length), pa.array(crc, pa.int64()), pa.concat_arrays(group.column("doc_tokens").chunks).take(place),
            pa.array((shard << 32) + sequence), pa.array(offset),
        ], names=_PIECES.names)
        release()
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), kind).astype("<u4")
                at = np.arange(0, len(ids), window)
                row = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(row), pa.array(batch.column("start")[i].as_py() + at), pa.array(np.full(len(at), window)), pa.array([zlib.crc32(ids[a : a + window]) for a in at], pa.int64()), batch.column("doc_tokens").take(row),
                    pa.array(-1 - (batch.column("row")[i].as_py() * GIANT_WINDOWS + np.arange(len(at)))), pa.array(np.zeros(len(at), np.int64)),
                ], names=_PIECES.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *_PIECES.fields[1:]])
    dealt = marked.select(*columns, "mix").mapInArrow(place, keyed).repartition(min(parts, MOST_TASKS), F.xxhash64("part", F.lit(3)))
    shards = dealt.sortWithinPartitions("part", "sign", "mix", "row").mapInArrow(windows, schema)
    return shards.unionAll(tokens.where("whole").select("row", "doc_id", "start", "doc_tokens", "ids").mapInArrow(cut, schema))
