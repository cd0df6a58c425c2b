"""Contiguous shards of near-equal bytes from global prefix sums.

Documents are put in the order (digest of the text, digest of the id, id), so
equal texts stand together. The order has natural partitions: the first
``PREFIX`` hexadecimal digits of the text's digest. Each partition's bytes and
rows are totalled, the totals of the (at most 16 ** PREFIX) partitions are
summed up in one small window, and a running sum inside a partition gives
every document its place in the whole. The byte range is then cut at equal
targets.

A text that a third of the documents share would fill one partition; so the
rows are counted in units (text, first ``PREFIX`` digits of the id's digest),
which divide a group of equal texts evenly, and only units, not rows, meet in
a partition's window. Equal texts have equal sizes, so a row's place follows
from its number in its unit. Groups of up to 1 / ``WHOLE`` of a shard are never
divided; larger ones are cut like any other range.

Built-in expressions only. Defined cases: a null text has no bytes and size 16
(as an empty one), null texts form one group of their own; a null id is an id
like others; repeated rows get slots of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.llm.common import cut

SHARDS = 40
#: Bytes that a row takes besides its text.
OVERHEAD = 16
PREFIX = 3
WHOLE = 200


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def shard(docs: DataFrame, shards: int = SHARDS, prefix: int = PREFIX) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the global byte offset of each document."""
    rows = docs.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("")).alias("g"),
        F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, prefix), F.lit("")).alias("u"),
    )
    unit = W.partitionBy("g", "u")
    rows = cut(rows.withColumns({"n": F.row_number().over(unit.orderBy("doc_id")), "unit_rows": F.count(F.lit(1)).over(unit)}))

    units = rows.where("n = 1").select("g", "u", F.substring("g", 1, prefix).alias("p"), "unit_rows", (F.col("unit_rows") * F.col("size")).alias("unit_bytes"))
    part = W.partitionBy("p").orderBy("g", "u").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy("p", "g")
    zero = F.lit(0).cast("bigint")
    placed = units.select(
        "*",
        F.coalesce(F.sum("unit_bytes").over(part), zero).alias("b"),
        F.coalesce(F.sum("unit_rows").over(part), zero).alias("r"),
        F.sum("unit_bytes").over(group).alias("group_bytes"),
    ).withColumn("group_b", F.min("b").over(group))
    totals = units.groupBy("p").agg(F.sum("unit_bytes").alias("pb"), F.sum("unit_rows").alias("pr"))
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # at most 16 ** prefix + 1 rows
    starts = totals.select(
        "p",
        F.coalesce(F.sum("pb").over(before), zero).alias("p_bytes"),
        F.coalesce(F.sum("pr").over(before), zero).alias("p_rows"),
        F.sum("pb").over(everything).alias("all_bytes"),
    )
    placed = placed.join(F.broadcast(starts), "p").select(
        "g",
        "u",
        (F.col("p_bytes") + F.col("b")).alias("unit_start"),
        (F.col("p_rows") + F.col("r")).alias("unit_row"),
        (F.col("p_bytes") + F.col("group_b")).alias("group_start"),
        (F.col("group_bytes") * (WHOLE * shards) <= F.col("all_bytes")).alias("whole"),
        "all_bytes",
    )
    start = F.col("unit_start") + (F.col("n") - 1) * F.col("size")
    at = F.when(F.col("whole"), F.col("group_start")).otherwise(start)
    found = rows.join(placed, ["g", "u"]).withColumn("cut_at", at).select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"int(least({shards - 1}, cut_at * {shards} div all_bytes))").alias("shard"),
        start.alias("offset"),
        (F.col("unit_row") + F.col("n") - 1).alias("row"),
    )
    firsts = found.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return found.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), "offset")


def contract(docs: DataFrame) -> DataFrame:
    found = shard(docs)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
