"""Joins on time: as-of, overlap, containment, duration shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(playheads: DataFrame, lines: DataFrame, until_end: bool = True) -> DataFrame:
    """playheads (song_id, t_ms, ...) with the active line: the last that starts by t_ms (and hasn't ended).

    Lines and playheads are merged in time order, so nothing is joined by range.
    """
    names = [c for c in playheads.columns if c != "song_id"]
    marks = lines.select("song_id", F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"), F.struct("start_ms", "line_index", "end_ms").alias("_line"), F.lit(None).alias("_p"))
    heads = playheads.select("song_id", F.col("t_ms").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).alias("_line"), F.struct(*names).alias("_p"))
    order = W.partitionBy("song_id").orderBy("_t", "_kind", F.col("_line.line_index")).rowsBetween(W.unboundedPreceding, 0)
    last = F.last("_line", ignorenulls=True).over(order)
    found = marks.unionByName(heads).withColumn("_found", last).where("_kind = 1").select("song_id", "_p.*", "_found")
    line = F.col("_found.line_index")
    if until_end:
        line = F.when(F.col("t_ms") <= F.col("_found.end_ms"), line)
    return found.withColumn("active_line", F.coalesce(line, F.lit(-1))).drop("_found")


def best_overlap(own: DataFrame, others: DataFrame) -> DataFrame:
    """Each own interval (song_id, i, start_ms, end_ms) with the other that covers most of it (first on ties; j 0 without any)."""
    a = own.select("song_id", "i", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    b = others.select("song_id", "j", F.col("start_ms").alias("os"), F.col("end_ms").alias("oe"))
    both = a.join(b, "song_id").withColumn("ms", F.greatest(F.least("e", "oe") - F.greatest("s", "os"), F.lit(0)))
    best = both.groupBy("song_id", "i").agg(F.max(F.struct("ms", (-F.col("j")).alias("j"))).alias("m"))
    return best.select("song_id", "i", (-F.col("m.j")).alias("j"), F.col("m.ms").alias("overlap_ms"))


def contained(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words (start_ms) with the segments of their song that hold their start."""
    s = segments.select("song_id", "seg_index", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"))
    return words.join(s, "song_id").where((F.col("start_ms") >= F.col("seg_start")) & (F.col("start_ms") <= F.col("seg_end"))).drop("seg_start", "seg_end")


def duration_map(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Line i of n goes to the segment that holds (i + 0.5) / n of all durations (each at least 100 ms)."""
    order = W.partitionBy("song_id").orderBy("seg_index")
    spans = segments.withColumn("dur", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(100)))
    total = F.sum("dur").over(W.partitionBy("song_id"))
    spans = spans.select("song_id", "seg_index", F.sum("dur").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), "dur", total.alias("total"))
    placed = lines.select("song_id", "line_index", F.count(F.lit(1)).over(W.partitionBy("song_id")).alias("n"))
    # (i + 0.5) / n < upto / total, in integers
    inside = ((2 * F.col("line_index") + 1) * F.col("total") >= 2 * F.col("n") * (F.col("upto") - F.col("dur"))) & ((2 * F.col("line_index") + 1) * F.col("total") < 2 * F.col("n") * F.col("upto"))
    return placed.join(spans, "song_id").where(inside).select("song_id", "line_index", "seg_index")
