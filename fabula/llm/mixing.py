"""Mixing sources to target weights by hash thresholds.

Every source gets a target number of words; its documents are taken whole, each
once, twice or not at all.  Below a threshold on a hash of the document's id a
document is taken once more.  The threshold comes from histograms: words summed
by source and hash bucket show the bucket in which the budget runs out, and only
that bucket's documents are summed again by the next bits of the hash, until one
document is left.  Nothing is sorted.  All of it is DataFrame operations.

Defined results: a null text has no words; a null source is a source of its own,
last in order; rows with the same id share a hash and are taken together.
Without words every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, settle

WORD = r"[^\x20\x09-\x0D]++"  # possessive: there is nothing to go back for
WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # of all words
MOST = 2  # copies of a document

#: The hash has 60 bits, read 12 at a time.
LEVELS, BITS = 5, 12
#: Sources up to which their thresholds are sent to every task.
BROADCAST_SOURCES = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(key: str) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def document_sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, source, size (words) and hash (60 bits of the id's MD5) of each row."""
    return docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        id_hash(key).alias("hash"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size and target.

    Sources in order of code points, null last, weigh `weights` over and over.
    Each gets its share of budget x all words, at most `most` x its own words;
    what is above is shared again by weight.  That is: the sources with the
    least size for their weight stop, and the others share the rest.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one short row for each source from here on
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    words = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    shared = weighed.select(
        "source",
        "source_size",
        "weight",
        (F.lit(float(budget)) * words - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("heads"),
        F.row_number().over(order).alias("place"),
    ).withColumn("level", F.col("left") / F.col("heads"))
    # the first source in order that stays under its limit, and the level that it and all after it get
    free = F.col("level") * F.col("weight") <= most * F.col("source_size")
    first = F.min(F.when(free, F.struct("place", "level"))).over(Window.partitionBy(F.lit(0)))
    return shared.withColumn("__first", first).select(
        "source",
        "source_size",
        F.when(F.col("place") >= F.col("__first.place"), F.col("__first.level") * F.col("weight")).otherwise(F.col("source_size") * F.lit(float(most))).alias("target"),
    )


def cuts(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """grp and below: the documents of grp with a smaller hash have nearest to `need` words.

    docs: grp, size, hash; needs: grp, need (at most the group's words).
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = settle(needs.select("grp", F.col("need").cast("double").alias("need"), F.lit(0).cast("long").alias("below")), "mix-state")
    inside = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("hash", shift)
        sums = docs.groupBy(F.col("grp").alias("g"), bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        # up to 4096 buckets of each group
        upto = F.sum("words").over(Window.partitionBy("g").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).join(state.select("grp", "need"), same("g", "grp"))
        edge = sums.where((F.col("need") > F.col("upto") - F.col("words")) & (F.col("need") <= F.col("upto")))
        edge = settle(edge.select("g", "bucket", "words", "docs", (F.col("need") - (F.col("upto") - F.col("words"))).alias("more")), "mix-edge")
        # a group without an edge needs nothing more: its need is 0, or its boundary document was found
        single = (F.col("docs") == 1) if level < LEVELS - 1 else (F.col("docs") >= 1)
        end = (F.col("bucket") + F.when(F.col("more") * 2 > F.col("words"), 1).otherwise(0)) * F.lit(1 << shift)
        changed = settle(
            state.join(edge, same("grp", "g"), "left").select(
                "grp",
                F.when(F.col("bucket").isNull() | single, F.lit(0.0)).otherwise(F.col("more")).alias("need"),
                F.when(F.col("bucket").isNull(), F.col("below")).when(single, end).otherwise(F.col("bucket") * F.lit(1 << shift)).alias("below"),
            ),
            "mix-state",
        )
        narrower = None
        if level < LEVELS - 1:
            open_edges = edge.where("docs > 1").select("g", "bucket")
            narrower = settle(docs.join(open_edges, same("grp", "g") & (bucket == F.col("bucket"))).select("grp", "size", "hash"), "mix-inside")
        for old in (state, edge, inside):
            drop(old)
        state = changed
        if narrower is None or narrower.isEmpty():
            drop(narrower)
            break
        docs = inside = narrower
    return state.select("grp", "below")


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (copies of every document), mean, and below_large and below_small.

    Documents with more than the source's mean size are cut first, for their share
    of what is needed; the others then make up for what those missed, so that the
    sum comes within half of a small document.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    counts = sizes.groupBy(F.col("source").alias("s")).agg(F.avg("size").alias("mean"))
    rest = targets.join(counts, same("source", "s")).drop("s").withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = settle(rest.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-needs")
    means = state.select(F.col("source").alias("s"), "mean")
    tiers = sizes.join(means, same("source", "s")).select(F.col("source").alias("grp"), "size", "hash", (F.col("size") > F.col("mean")).alias("large"))
    tiers = settle(tiers.where("size > 0"), "mix-tiers")
    large = tiers.where("large").select("grp", "size", "hash")
    words = large.groupBy(F.col("grp").alias("g")).agg(F.sum("size").alias("large_words"))
    needs = settle(state.join(words, same("source", "g"), "left").select(F.col("source").alias("grp"), "need", "source_size", F.coalesce("large_words", F.lit(0)).alias("large_words")), "mix-large")
    below_large = cuts(large, needs.select("grp", F.when(F.col("source_size") > 0, F.col("need") * (F.col("large_words") / F.col("source_size"))).otherwise(F.lit(0.0)).alias("need"))).withColumnRenamed("grp", "l").withColumnRenamed("below", "below_large")
    taken = large.join(below_large, same("grp", "l")).where(F.col("hash") < F.col("below_large")).groupBy(F.col("grp").alias("g")).agg(F.sum("size").alias("taken"))
    left = needs.join(taken, same("grp", "g"), "left").select("grp", F.least(F.greatest(F.col("need") - F.coalesce("taken", F.lit(0)), F.lit(0.0)), (F.col("source_size") - F.col("large_words")).cast("double")).alias("need"))
    below_small = cuts(tiers.where("not large").select("grp", "size", "hash"), left).withColumnRenamed("grp", "m").withColumnRenamed("below", "below_small")
    placed = state.join(below_large, same("source", "l")).join(below_small, same("source", "m"))
    return placed.select("source", "source_size", "target", "whole", "mean", "below_large", "below_small")


def _copies(size: Column) -> Column:
    below = F.when(size > F.col("mean"), F.col("below_large")).otherwise(F.col("below_small"))
    return F.col("whole") + F.when(F.col("hash") < below, 1).otherwise(0)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, size, source_size, target and taken of every row."""
    sizes = settle(document_sizes(docs, text, key, source), "mix-sizes")
    limits = thresholds(sizes, source_targets(sizes)).withColumnRenamed("source", "s")
    if limits.count() <= BROADCAST_SOURCES:
        limits = F.broadcast(limits)
    copies = _copies(F.col("size"))
    return sizes.join(limits, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes it; other columns stay as they are.

    Words are counted a second time here: that takes less than writing all texts with
    their counts and reading these would.  The decision is made from the row's own id and source, so no join on ids is
    needed, and repeated rows are all treated alike.  Documents without words are left out.
    """
    sizes = settle(document_sizes(docs, text, key, source), "mix-sizes")
    limits = thresholds(sizes, source_targets(sizes)).withColumnRenamed("source", "s").drop("source_size", "target")
    if limits.count() <= BROADCAST_SOURCES:
        limits = F.broadcast(limits)
    # the row in one column, so that its names can be any
    marked = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), id_hash(key).alias("hash"), word_count(text).alias("size"))
    taken = marked.join(limits, F.col("source").eqNullSafe(F.col("s")), "left").where("size > 0").withColumn("copies", _copies(F.col("size"))).where("copies > 0")
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
