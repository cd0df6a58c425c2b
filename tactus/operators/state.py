"""State of an application around the timelines: lists, ranks, toggles, progress, the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The share of the whole that each step ends at.
STEPS = [("download", 0, 20), ("separate", 20, 45), ("transcribe", 45, 85), ("align", 85, 100)]


def progress(step: Column, percent: Column) -> Column:
    """Whole per cent done, from a step and the per cent of it."""
    out = F.lit(None).cast("bigint")
    for name, low, high in reversed(STEPS):
        out = F.when(step == name, low + F.floor((high - low) * percent / 100)).otherwise(out)
    return out.cast("bigint")


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by order: a top-n report."""
    return df.orderBy(*order).limit(n)


def best_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def merged_timeline(lines: DataFrame, inserted: DataFrame) -> DataFrame:
    """Both tables' lines of a song in time order (of equal starts, by old number), numbered anew."""
    both = lines.unionByName(inserted)
    order = W.partitionBy("song_id").orderBy("start_ms", "line_index", "end_ms")
    return both.withColumn("line_index", (F.row_number().over(order) - 1).cast("int"))


def maximal_sets(sets: DataFrame) -> DataFrame:
    """Rows (id, items) whose set isn't a proper part of another row's set.

    Equal sets are one before they meet, and only sets that share their least
    common item meet: a set that holds all of another holds its least item, too.
    """
    kinds = sets.select(F.array_sort(F.array_distinct("items")).alias("s")).distinct()
    small = kinds.where(F.size("s") > 0).withColumn("k", F.col("s")[0])
    large = kinds.select(F.col("s").alias("t"), F.explode("s").alias("k"))
    inside = small.join(large, "k").where((F.size("t") > F.size("s")) & (F.size(F.array_except("s", "t")) == 0)).select("s").distinct()
    # an empty set is a proper part of any other
    empty = kinds.where(F.size("s") == 0).where(kinds.where(F.size("s") > 0).exists())
    gone = inside.union(empty)
    return sets.withColumn("s", F.array_sort(F.array_distinct("items"))).join(gone, "s", "left_anti").drop("s")


def toggled(clicks: DataFrame, *keys: str) -> DataFrame:
    """The keys that were clicked an odd number of times: each click adds or removes."""
    return clicks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")


def ordered_distinct(items: Column) -> Column:
    """The items without empty ones and repeats, in order of first occurrence."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """parents with children: their rows in order, an empty list without any."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))


def counted(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children."""
    found = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(found, key, "left").na.fill(0, [name])


def evicted(entries: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Cache entries (key, created_at, accessed_at) that nobody has used for more than days; those without any time stay."""
    used = F.coalesce("accessed_at", "created_at")
    return entries.where(used < now - F.make_dt_interval(F.lit(days)))


def parsed(raw: Column, schema: str) -> Column:
    """JSON of a model's answer: the text itself, else its fenced block, else from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    tries = [F.from_json(F.trim(t), f"{schema}, _bad string", strict) for t in (raw, fenced, braces)]
    sound = [F.when((F.length(F.trim(t)) > 0) & x["_bad"].isNull(), x.dropFields("_bad")) for t, x in zip((raw, fenced, braces), tries, strict=True)]
    return F.coalesce(*sound)
