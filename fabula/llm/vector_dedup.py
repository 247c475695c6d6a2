"""Near-duplicate vectors by NN-descent.

Vectors with equal labels are compared by cosine in double precision.

1. Equal vectors of one label are one node, told apart by 128 bits of a hash.
2. Every node gets a list of its LIST nearest neighbours, as far as they are near:
   at most twice the threshold's angle away.  What is farther is of no use, for
   by the triangle inequality two linked nodes are that near to each other's links.
   First lists come from cells: the signs of random projections split each label
   into cells of about CELL nodes, in so many tables that a pair at the threshold is in
   one cell with odds of FOUND; nodes of one cell are compared with each other.
   A crowded cell is split by further signs, and dealt at random where these don't help.
3. NN-descent: neighbours of a node, in either direction, are likely to be
   neighbours of each other.  All neighbours of each node are compared, and
   what is nearer than the last of a list goes into it, until rounds find hardly
   any new links.  Only entries that are new since the last round lead to comparisons.
4. A list that is full of links is saturated and is enlarged until it ends in a
   non-link, that is to all links of its node.  These aren't written out (m copies have
   m * m links).  Saturated nodes form blocks of BLOCK nodes with a centre and a
   radius; blocks too far from each other to hold a link are passed over, blocks
   all of whose nodes must be linked are counted as such, and only the others are
   compared, so that the count is exact.  A link between an unsaturated node and
   any other is in the unsaturated node's list.
5. Entries and enlarged lists with the threshold cosine or more are the links.
6. Audit: nodes from those with and those without links are compared with all nodes
   by brute force.  If the share of links found, averaged by node, is less than RECALL,
   lists are refined further from new cells; if that doesn't help, lists of
   all nodes are enlarged to all of their links, as in step 4.

Vectors that are null, empty or zero, that hold null or non-finite components, or
that have no label, link with nothing; nor do vectors of different lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .components import roots as joined
from .scratch import drop, gathered, settle

THRESHOLD = 0.98
LIST = 16
CELL = 256
#: Odds that a pair at the threshold shares a first cell; signs of one node in a table.
FOUND, SIGNS = 0.99, 31
#: Most nodes compared at once, in a cell or around a node.
TOGETHER = 512
BLOCK = 1024
ROUNDS = 8
#: Rounds end when the links found in one are fewer than this share.
LITTLE = 0.001
AUDITED = 200
RECALL = 0.95
REFINED = 3
BROADCAST_ROWS = 10_000
#: Angles are computed with an error below this.
SLACK = 1e-6


def unit_rows(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors of equal length as rows of length 1, in double precision."""
    raw = np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(len(column), -1).astype(np.float64)
    top = np.abs(raw).max(1, keepdims=True)
    scaled = raw / top  # so that no square overflows
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def near_cosine(threshold: float) -> float:
    """The cosine of twice the threshold's angle."""
    return math.cos(min(2 * math.acos(threshold) + SLACK, math.pi))


def tables_for(bits: int, threshold: float = THRESHOLD) -> int:
    """Tables of `bits` signs in which a pair at the threshold agrees in one with odds of FOUND."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if agree >= FOUND else math.ceil(math.log(1 - FOUND) / math.log(1 - agree))


def _by_key(df: DataFrame, keys: list[str], then: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs work over the rows of each key together; rows of a key are few by construction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.concatenate([[False], np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if batch.num_rows > 1 else np.array([False])
            first = tuple(c[0] for c in columns)
            if held and first != last:
                yield from work(pa.Table.from_batches(held))
                held = []
            cuts = [0, *np.flatnonzero(new), batch.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, z - a))
            last = tuple(c[-1] for c in columns)
        if held:
            yield from work(pa.Table.from_batches(held))

    return gathered(df, keys, then).mapInArrow(run, schema)


def _valid(vector: str, label: str) -> Column:
    v = F.col(vector)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & fine, F.lit(False))


def _marked(df: DataFrame, vector: str, label: str) -> DataFrame:
    """df's rows as `row`, with __grp (label and length) and the vector's two hashes, null where it links with nothing."""
    plain = F.transform(F.col(vector), lambda x: x + F.lit(0).cast(df.schema[vector].dataType.elementType))  # -0.0 is 0.0
    good = df.select(F.struct("*").alias("row"), F.when(_valid(vector, label), plain).alias("__v"), F.xxhash64(F.col(label), F.size(vector)).alias("__grp"))
    there = F.col("__v").isNotNull()
    return good.select("row", "__v", "__grp", F.when(there, F.xxhash64("__grp", "__v")).alias("__h1"), F.when(there, F.xxhash64(F.lit(7), "__v", "__grp")).alias("__h2"))


def _nodes(marked: DataFrame, kind: str) -> DataFrame:
    """node, grp, h1, h2, copies and v (bytes) of every different vector of a label."""

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy()
            ends = np.cumsum(sizes)
            packed = pa.array([flat[e - s : e].astype(kind).tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("h1"), batch.column("h2"), packed], names=["grp", "h1", "h2", "v"])

    rows = marked.where(F.col("__v").isNotNull()).select(F.col("__grp").alias("grp"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), F.col("__v").alias("v"))
    packed = rows.mapInArrow(to_bytes, "grp long, h1 long, h2 long, v binary")
    found = packed.groupBy("h1", "h2").agg(F.first("grp").alias("grp"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # the numbers are any, but settled
    return settle(found.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _cells(nodes: DataFrame, seed: int, kind: str, threshold: float) -> DataFrame:
    """node, v, cell and part: each node in its tables' cells."""
    most = tables_for(SIGNS, threshold)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, tables = np.array([len(x.as_buffer()) for x in batch.column("v")]), batch.column("tables").to_numpy()
            for d, t in {*zip(sizes.tolist(), tables.tolist(), strict=True)}:
                part = batch.filter(pa.array((sizes == d) & (tables == t)))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d // np.dtype(kind).itemsize, most, SIGNS))
                own = planes[d][:, :t].reshape(planes[d].shape[0], -1)
                signs = (unit_rows(part.column("v"), kind) @ own > 0).reshape(-1, t, SIGNS)
                code = (signs * (1 << np.arange(SIGNS))).sum(2)
                row = pa.array(np.repeat(np.arange(part.num_rows), t))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in ("node", "grp", "bits")), pa.array(np.tile(np.arange(t), part.num_rows).astype(np.int64)), pa.array(code.reshape(-1).astype(np.int64))], names=["node", "grp", "bits", "t", "code"])

    counts = nodes.groupBy("grp").count()
    # as many signs as make cells of CELL nodes, if they were even
    bits = counts.select("grp", F.least(F.lit(SIGNS), F.greatest(F.lit(0), F.floor(F.log2(F.col("count") / CELL)))).cast("int").alias("bits"))
    if bits.count() <= BROADCAST_ROWS:
        bits = F.broadcast(bits)
    tables = F.element_at(F.array(*(F.lit(tables_for(b, threshold)) for b in range(SIGNS + 1))), F.col("bits") + 1)
    # vectors stay behind until cells are known
    coded = settle(nodes.select("node", "grp", "v").join(bits, "grp").withColumn("tables", tables).mapInArrow(codes, "node long, grp long, bits int, t long, code long"), "codes")
    of = lambda signs: F.xxhash64("grp", "t", F.expr(f"code & (shiftleft(1L, {signs}) - 1)"))
    first = coded.withColumn("cell", of("bits"))
    crowded = first.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("cell", F.ceil(F.log2(F.col("n") / TOGETHER) + 1).cast("int").alias("more"))
    split = first.join(crowded, "cell", "left").withColumn("cell", F.when(F.col("more").isNull(), F.col("cell")).otherwise(of(f"cast(least(bits + more, {SIGNS}) as int)"))).select("node", "cell")
    full = split.groupBy("cell").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).where("parts > 1")
    dealt = split.join(full, "cell", "left").select("node", "cell", F.pmod(F.xxhash64("node", F.lit(seed)), F.coalesce("parts", F.lit(1))).alias("part"))
    return dealt.join(nodes.select("node", "v"), "node")


def _first_lists(nodes: DataFrame, seed: int, kind: str, threshold: float) -> DataFrame:
    near = near_cosine(threshold)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, table.num_rows, 2 * TOGETHER):
            part = table.slice(at, 2 * TOGETHER)
            n = part.num_rows
            if n < 2:
                continue
            node, unit = part.column("node").to_numpy(), unit_rows(part.column("v"), kind)
            cosine = unit @ unit.T
            np.fill_diagonal(cosine, -2.0)
            k = min(LIST, n - 1)
            best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            src, dst = np.repeat(np.arange(n), k), best.reshape(-1)
            close = cosine[src, dst] >= near
            if close.any():
                src, dst = src[close], dst[close]
                yield pa.RecordBatch.from_arrays([pa.array(node[src]), pa.array(node[dst]), pa.array(cosine[src, dst])], names=["src", "dst", "cosine"])

    return _by_key(_cells(nodes, seed, kind, threshold), ["cell", "part"], ["node"], work, "src long, dst long, cosine double")


def _shortened(entries: DataFrame) -> DataFrame:
    """The LIST nearest entries of each src; an entry that was there before isn't new."""
    once = entries.groupBy("src", "dst").agg(F.max("cosine").alias("cosine"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), "dst"))
    return once.withColumn("place", place).where(F.col("place") <= LIST)


def _last(lists: DataFrame) -> DataFrame:
    """node and the cosine of its list's last entry, -2 while it isn't full."""
    return lists.groupBy(F.col("src").alias("node")).agg(F.when(F.count("*") >= LIST, F.min("cosine")).otherwise(F.lit(-2.0)).alias("last"))


def _descend(lists: DataFrame, nodes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Entries that beat the last one of an unsaturated list, from comparing all neighbours of each node."""
    near = near_cosine(threshold)
    around = lists.select(F.col("src").alias("mid"), F.col("dst").alias("node"), "fresh").unionAll(lists.select(F.col("dst").alias("mid"), F.col("src").alias("node"), "fresh"))
    around = around.groupBy("mid", "node").agg(F.max("fresh").alias("fresh")).join(_last(lists), "node", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
    # around a node that is in very many lists, neighbours are dealt into parts; saturated lists only are no use here, they are enlarged
    degree = around.groupBy("mid").agg(F.ceil(F.count("*") / 128).alias("parts"), F.count("*").alias("n"), F.max("fresh").alias("any"), F.min("last").alias("least"))
    degree = degree.where((F.col("any") == 1) & (F.col("n") > 1) & (F.col("least") < threshold)).select("mid", "parts")
    dealt = around.join(degree, "mid").withColumn("part", F.pmod(F.xxhash64("node", "mid"), F.col("parts"))).drop("parts")

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        if n < 2:
            return
        fresh = table.column("fresh").to_numpy() > 0
        if not fresh.any():
            return
        node, last = table.column("node").to_numpy(), table.column("last").to_numpy()
        cosine = (unit := unit_rows(table.column("v"), kind)) @ unit.T
        wanted = (fresh[:, None] | fresh[None, :]) & (cosine > last[:, None]) & (cosine >= near) & (last[:, None] < threshold)
        np.fill_diagonal(wanted, False)
        src, dst = np.nonzero(wanted)
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(node[src]), pa.array(node[dst]), pa.array(cosine[src, dst])], names=["src", "dst", "cosine"])

    return _by_key(dealt.join(nodes.select("node", "v"), "node").select("mid", "part", "node", "fresh", "v", "last"), ["mid", "part"], ["node"], work, "src long, dst long, cosine double")


def neighbour_lists(nodes: DataFrame, kind: str = "<f8", threshold: float = THRESHOLD, seed: int = 6, start: DataFrame | None = None) -> DataFrame:
    """src, dst, cosine: NN-descent from cells (and from the lists `start`, if there are any)."""
    first = _first_lists(nodes, seed, kind, threshold).withColumn("fresh", F.lit(1))
    if start is not None:
        first = first.unionAll(start.select("src", "dst", "cosine", F.lit(0).alias("fresh")))
    lists = settle(_shortened(first), "lists")
    links = lists.where(F.col("cosine") >= threshold).count()
    for _ in range(ROUNDS if links else 0):
        better = _descend(lists, nodes, kind, threshold).withColumn("fresh", F.lit(1))
        old = lists.select("src", "dst", "cosine", F.lit(0).alias("fresh"))
        refined = settle(_shortened(old.unionAll(better)), "lists")
        drop(lists)
        lists = refined
        now = lists.where(F.col("cosine") >= threshold).agg(F.count("*").alias("all"), F.sum("fresh").alias("new")).first()
        if (now["new"] or 0) <= LITTLE * max(now["all"], 1):
            break
    return lists.select("src", "dst", "cosine")


# ---- enlarged lists ---------------------------------------------------------------


def _meetings(df: DataFrame, root: str, size: int) -> DataFrame:
    """df's rows, dealt into blocks of about `size` of each root, once for each meeting (low, high) of their block `own` with a block of the root."""
    blocks = df.groupBy(root).agg(F.ceil(F.count("*") / size).alias("__blocks"))
    own = df.join(blocks, root).withColumn("own", F.pmod(F.xxhash64("block"), F.col("__blocks")))
    # each block meets each: (own, other) and (other, own) are one meeting
    return own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "__blocks")


def _blocks(placed: DataFrame, kind: str) -> DataFrame:
    """block, grp, centre, radius (an angle), head (smallest node) and copies of every block of `placed`; each fits into one task."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = unit_rows(table.column("v"), kind)
        mean = unit.sum(0)
        size = np.sqrt(mean @ mean)
        centre = mean / size if size > 1e-9 else unit[0]
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
        yield pa.RecordBatch.from_pydict({"block": [table.column("block")[0].as_py()], "grp": [table.column("grp")[0].as_py()], "centre": [centre.astype("<f8").tobytes()], "radius": [radius], "head": [int(table.column("node").to_numpy().min())], "copies": [int(table.column("copies").to_numpy().sum())]})

    return _by_key(placed.select("block", "grp", "node", "copies", "v"), ["block"], ["node"], work, "block long, grp long, centre binary, radius double, head long, copies long")


def _block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """a <= b, sure, and b's and a's head and copies: pairs of blocks of a label that can hold a link; sure if all of their nodes must be linked."""
    angle = math.acos(threshold)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        own, block, radius, head, copies = (table.column(c).to_numpy() for c in ("own", "block", "radius", "head", "copies"))
        centre = unit_rows(table.column("centre"), "<f8")
        i, j = (np.arange(len(own)),) * 2 if low == high else (np.flatnonzero(own == low), np.flatnonzero(own == high))
        apart = np.arccos(np.clip(centre[i] @ centre[j].T, -1, 1))
        reach = radius[i][:, None] + radius[j][None, :]
        meet = apart - reach <= angle + SLACK
        sure = apart + reach <= angle - SLACK
        if low == high:
            np.fill_diagonal(meet, True)
            np.fill_diagonal(sure, 2 * radius <= angle - SLACK)
            meet = np.triu(meet)
        x, y = np.nonzero(meet)
        a, b, sure = i[x], j[y], sure[x, y]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(block[a]), pa.array(block[b]), pa.array(sure), pa.array(head[a]), pa.array(head[b]), pa.array(copies[a]), pa.array(copies[b])], names=["a", "b", "sure", "head_a", "head_b", "copies_a", "copies_b"])

    met = _meetings(blocks, "grp", BLOCK).select("grp", "low", "high", "own", "block", "centre", "radius", "head", "copies")
    return _by_key(met, ["grp", "low", "high"], ["own", "block"], work, "a long, b long, sure boolean, head_a long, head_b long, copies_a long, copies_b long")


def _enlarged(placed: DataFrame, threshold: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """All links between the nodes of `placed` (node, grp, root, copies, v) with equal grp.

    Returns node and links (rows, copies counted, in parts to be added up), and edges a, b that
    connect what the links connect.  Nodes of one root are near each other, probably: it
    makes blocks small, and nothing depends on it.
    """
    sized = placed.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("__n"))
    dealt = placed.join(sized, "root").withColumn("block", F.xxhash64("grp", "root", F.pmod(F.xxhash64("node"), F.col("__n"))))
    dealt = settle(dealt.select("block", "grp", "node", "copies", "v"), "dealt")
    pairs = settle(_block_pairs(_blocks(dealt, kind), threshold), "pairs")
    sure, other = pairs.where("sure"), pairs.where(~F.col("sure"))
    # all of a block's nodes are linked with all of another's, or of their own
    gained = sure.select(F.col("a").alias("block"), F.col("copies_b").alias("n"), F.col("head_b").alias("to")).unionAll(sure.where("a != b").select(F.col("b"), F.col("copies_a"), F.col("head_a")))
    by_block = gained.groupBy("block").agg(F.sum("n").alias("n"), F.min("to").alias("to"))
    inside = sure.where("a = b").select(F.col("a").alias("block"), F.lit(1).alias("self"))
    counted = dealt.select("block", "node", "copies").join(by_block, "block").join(inside, "block", "left").select("node", (F.col("n") - F.when(F.col("self") == 1, F.col("copies")).otherwise(F.lit(0))).alias("links"), "to")
    heads = sure.select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        unit = unit_rows(table.column("v"), kind)
        low, high = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        if low == high:
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            count = linked @ copies
            i, j = np.nonzero(linked)
        else:
            x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
            linked = unit[x] @ unit[y].T >= threshold
            count = np.zeros(len(node), np.int64)
            count[x], count[y] = linked @ copies[y], copies[x] @ linked
            i, j = np.nonzero(linked)
            i, j = x[i], y[j]
        if len(i):
            names, least = joined(node[i], node[j])
            place = np.argsort(node, kind="stable")[np.searchsorted(np.sort(node), names)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(count[place].astype(np.int64)), pa.array(least)], names=["node", "links", "to"])

    sides = other.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    compared = settle(_by_key(dealt.join(sides, "block").select("a", "b", "block", "node", "copies", "v"), ["a", "b"], ["block", "node"], work, "node long, links long, to long"), "met")
    every = settle(compared.unionAll(counted.select("node", "links", "to")), "counted")
    edges = every.select(F.col("node").alias("a"), F.col("to").alias("b")).unionAll(heads).where("a != b")
    edges = settle(edges, "enlarged")
    for table in (dealt, pairs, compared):
        drop(table)
    return every.select("node", "links"), edges


def _linked(nodes: DataFrame, lists: DataFrame, threshold: float, kind: str, everything: bool = False) -> DataFrame:
    """node, root and links (rows, copies counted) of every node with a link: from lists, the saturated ones (or all) enlarged."""
    entries = lists.where(F.col("cosine") >= threshold).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    full = settle(_last(lists).where(F.col("last") >= threshold).select("node"), "saturated")
    if everything:
        counts, edges = _enlarged(nodes.select("node", "grp", F.col("grp").alias("root"), "copies", "v"), threshold, kind)
    elif full.isEmpty():
        counts, edges = (lists.sparkSession.createDataFrame([], x) for x in ("node long, links long", "a long, b long"))
    else:
        known = settle(components(entries), "known")
        counts, edges = _enlarged(nodes.select("node", "grp", "copies", "v").join(full.join(known, "node"), "node"), threshold, kind)
    if not everything:
        # links with an unsaturated end, from either end's list, each once
        both = entries.unionAll(entries.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        fa, fb = full.select(F.col("node").alias("a"), F.lit(1).alias("__fa")), full.select(F.col("node").alias("b"), F.lit(1).alias("__fb"))
        open_links = both.join(fa, "a", "left").join(fb, "b", "left").where("__fa is null or __fb is null").select("a", "b")
        listed = open_links.join(nodes.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("links"))
        counts = counts.unionAll(listed)
        edges = edges.unionAll(entries)
    roots = components(edges)
    return settle(counts.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0").join(roots, "node"), "links")


def audit(nodes: DataFrame, counted: DataFrame, threshold: float = THRESHOLD, queries: int = AUDITED, kind: str = "<f8") -> float:
    """Share of links that was found, averaged by node; all nodes are looked at.

    `queries` nodes are picked by hash, half of them from nodes with links.  Of these the
    share of their links counts; of the others, how many should have had one, carried over to all of them.
    """
    picked = nodes.join(counted.select("node", "links"), "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    half = [r for want in (F.col("links") > 0, F.col("links") == 0) for r in picked.where(want).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(queries // 2).collect()]
    if not half:
        return 1.0
    asked = {}
    for r in half:
        asked.setdefault((r["grp"], len(r["v"])), []).append((r["node"], bytes(r["v"])))
    units = {k: (np.array([n for n, _ in q]), unit_rows(pa.array([v for _, v in q], pa.binary()), kind)) for k, q in asked.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            for (g, _), (names, unit) in units.items():
                part = batch.filter(pa.array(grp == g))
                if part.num_rows:
                    node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
                    linked = (unit @ unit_rows(part.column("v"), kind).T >= threshold) & (names[:, None] != node[None, :])
                    for name, n in zip(names.tolist(), (linked @ copies).tolist(), strict=True):
                        total[name] = total.get(name, 0) + n
        yield pa.RecordBatch.from_pydict({"node": list(total), "n": list(total.values())}, schema=pa.schema([("node", pa.int64()), ("n", pa.int64())]))

    # one small row for each node asked and task
    true = {r["node"]: r["n"] for r in nodes.select("node", "grp", "copies", "v").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    linked = [r["links"] / max(true[r["node"]], 1) for r in half if r["links"]]
    lost = [float(true[r["node"]] > 0) for r in half if not r["links"]]
    have = counted.count()
    without = nodes.count() - have
    should = have + (without * np.mean(lost) if lost else 0)
    return float(np.mean(linked) * have / should) if linked else float(should == 0)


def near_duplicate_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, report: list[float] | None = None) -> DataFrame:
    """key, n_links, component_id and kept of every row of df, in columns of these names.

    n_links counts other rows linked directly; component_id is the smallest key
    reachable by links, itself included; kept says that it is the row's own.
    Rows that repeat a key are rows of their own, each with its own vector's links.
    Null keys come after all others: a component of nulls alone has a null id, and is kept.
    Other columns aren't read.  `report` gets the recall that each audit measured.
    """
    kind = "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    marked = _marked(df.select(key, vector, label), vector, label)
    nodes = _nodes(marked, kind)
    lists = None
    for again in range(REFINED):
        found = neighbour_lists(nodes, kind, threshold, 6 + again, lists)
        lists = found
        counted = _linked(nodes, lists, threshold, kind)
        recall = audit(nodes, counted, threshold, kind=kind)
        if report is not None:
            report.append(recall)
        if recall >= RECALL:
            break
    else:
        counted = _linked(nodes, lists, threshold, kind, everything=True)
    placed = nodes.select("node", "h1", "h2", "copies").join(counted, "node", "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("__links"), F.coalesce("root", "node").alias("__root"))
    rows = marked.select(F.col(f"row.`{key}`").alias("__key"), "__h1", "__h2")
    # settled, so that joins see plain inputs and can split a component or a vector with very many rows
    known = settle(rows.join(placed, (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2")), "left").select("__key", "__links", "__root"), "rows")
    lowest = known.where("__root is not null").groupBy(F.col("__root").alias("__r")).agg(F.min("__key").alias("__lowest"))
    out = known.join(lowest, F.col("__root") == F.col("__r"), "left")
    component = F.when(F.col("__root").isNull(), F.col("__key")).otherwise(F.col("__lowest"))
    return out.select(F.col("__key").alias(key), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("__key")).alias("kept"))
