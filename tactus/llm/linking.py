"""Connected groups of items that share keys, without all pairs of a bucket.

``resolve`` takes buckets of items and three functions: a cheap judgement of
pairs, an exact confirmation of links, and an exact comparison of blocks.

1. Every member of a bucket meets the bucket's hub, the member that meets most
   others in all its buckets; the best judged pair of each member is confirmed,
   and links make components. One row a member: linear in the buckets.
2. In a bucket that still holds several components, all members outside its
   largest component are compared with all members of the bucket, block by
   block: a block is a salt of the id, so that it holds about ``limit`` units of
   size whatever the bucket holds, and a pair of blocks is one group of rows.
   The comparison returns links between components, not pairs, so its result
   is bounded by the components that it joins.

So every pair of a bucket ends either inside one component or compared
exactly. Tables that a later step reads twice are stored in the shared folder
and deleted when they are used up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import Scratch

#: Units of size (shingles, letters) of a block.
BLOCK = 1 << 17


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, c) for each id that links (a, b) name: the smallest id that it reaches, a stored table.

    A step carries labels over two links and then to the label's own label;
    links must be a stored table, since every step reads it.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = links.select("a", "b").union(links.select("b", "a"))
    edges = edges.union(edges.select("a", F.col("a").alias("b")))
    labels, before = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c")), None
    while True:
        once = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("b")).agg(F.min("c").alias("c"))
        twice = edges.join(once, "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        stored = scratch.keep(twice, "labels")
        if before is not None:
            scratch.drop(before)
        before = stored
        wider = edges.join(stored.select(F.col("id").alias("b"), "c"), "b").join(stored.select(F.col("id").alias("a"), F.col("c").alias("own")), "a").where("c < own")
        if wider.isEmpty():
            return stored
        labels = stored.join(stored.select(F.col("id").alias("c"), F.col("c").alias("e")), "c").select("id", F.least("c", "e").alias("c"))


def labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(labels.select(F.col("id").alias(column), F.col("c").alias("_c")), column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def shared(keys: DataFrame) -> DataFrame:
    """(k, id, size, n) for the keys k that n > 1 items have: one exchange."""
    return keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("n > 1")


def blocks(source: DataFrame, limit: int) -> DataFrame:
    """(k, i, j, minor, id, size, c, major) of the buckets (k, id, size, c) with several components.

    Rows with minor are those outside the bucket's largest component, dealt to
    blocks i and repeated for each j; the others are all members, dealt to
    blocks j and repeated for each i. major is the largest component.
    """
    parts = source.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    tops = parts.groupBy("k").agg(F.max(F.struct("m", "c", "s")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("s").alias("all"))
    number = lambda units: (F.floor(units / limit) + 1).cast("int")
    tops = tops.where("parts > 1").select("k", F.col("top.c").alias("major"), number(F.col("all") - F.col("top.s")).alias("na"), number(F.col("all")).alias("nb"))
    rows = source.join(tops, "k")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minors = rows.where("c <> major").select("k", dealt("na").alias("i"), each("nb").alias("j"), F.lit(True).alias("minor"), "id", "size", "c", "major")
    members = rows.select("k", each("na").alias("i"), dealt("nb").alias("j"), F.lit(False).alias("minor"), "id", "size", "c", "major")
    return minors.union(members)


def resolve(
    buckets: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame], DataFrame],
    percent: int,
    scratch: Scratch,
    limit: int = BLOCK,
) -> DataFrame:
    """(id, c) for each linked item: c is the smallest id of its component.

    buckets: a stored result of shared(); items whose sizes differ by more than
    percent allows can't be linked. judge: pairs (a, b, m), m the buckets where
    they met, to those allowed, with a distance z. confirm: pairs (a, b) to
    those linked. compare: rows of blocks() to links (a, b) that join all
    components which a linked pair of a minor and a member of one group has.
    """
    fits = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")
    meets = buckets.groupBy("id").agg(F.sum("n").alias("d"))
    hubs = buckets.join(meets, "id").groupBy("k").agg(F.max(F.struct("d", (-F.col("id")).alias("m"), "size")).alias("h"))
    hubs = hubs.select("k", (-F.col("h.m")).alias("b"), F.col("h.size").alias("sb"))
    stars = buckets.select("k", F.col("id").alias("a"), F.col("size").alias("sa")).join(hubs, "k").where(F.col("a") != F.col("b")).where(fits)
    stars = stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    best = judge(stars).groupBy("a").agg(F.min(F.struct("z", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links = scratch.keep(confirm(best), "links")
    labels = components(links, scratch)

    source = scratch.keep(labelled(buckets.select("k", "id", "size"), labels, "id", "c"), "members")
    more = scratch.keep(compare(blocks(source, limit)), "more")
    if more.isEmpty():
        scratch.drop(links, source, more)
        return labels
    joined = labelled(labelled(more, labels, "a", "ca"), labels, "b", "cb")
    joined = scratch.keep(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "joined")
    over = components(joined, scratch)
    known = labels.select("id").union(more.select(F.col("a").alias("id"))).union(more.select(F.col("b").alias("id"))).distinct()
    final = scratch.keep(labelled(labelled(known, labels, "id", "c"), over, "c", "e").select("id", F.col("e").alias("c")), "labels")
    scratch.drop(links, source, more, joined, labels, over)
    return final
