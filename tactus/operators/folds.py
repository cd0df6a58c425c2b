"""Timeline repairs that carry state from line to line, as JVM folds.

A song's lines are collected in order and folded by ``aggregate``; songs are at
most some hundred lines, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST_MS, PUSH_MS = 1200, 500


_OUT = "array<struct<line_index:int,start_ms:bigint,end_ms:bigint>>"


def _row(x: Column, start: Column, end: Column) -> Column:
    return F.array(F.struct(x["line_index"].cast("int").alias("line_index"), start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms")))


def repair_monotone(lines: DataFrame) -> DataFrame:
    """A line that starts over 100 ms before an earlier end is moved 50 ms behind it."""
    state = F.struct(F.lit(-1000).cast("bigint").alias("reached"), F.array().cast(_OUT).alias("out"))

    def step(s: Column, x: Column) -> Column:
        back = x["start_ms"] < s["reached"] - 100
        start = F.when(back, s["reached"] + 50).otherwise(x["start_ms"])
        end = F.when(back & (x["end_ms"] < start), start + 500).otherwise(x["end_ms"])
        return F.struct(F.greatest(s["reached"], end).cast("bigint").alias("reached"), F.concat(s["out"], _row(x, start, end)).alias("out"))

    # in the order of lines, not of times
    songs = lines.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "start_ms", "end_ms"))).alias("x"))
    done = songs.select("song_id", F.explode(F.aggregate("x", state, step, lambda s: s["out"])).alias("y"))
    return done.select("song_id", "y.line_index", "y.start_ms", "y.end_ms")


def finalize(lines: DataFrame, least: Column | None = None) -> DataFrame:
    """Lines in order of start, each of its least length, without overlaps.

    A small overlap moves the next start; a larger one cuts the line at the next
    start, but not below the shortest length, and moves the next start if need be.
    The fold holds back one line until the start of the next is known.
    """
    least = F.lit(SHORTEST_MS) if least is None else F.greatest(F.lit(SHORTEST_MS), least)
    held = "struct<line_index:int,start_ms:bigint,end_ms:bigint>"
    state = F.struct(F.lit(None).cast(held).alias("held"), F.array().cast(_OUT).alias("out"))

    def one(line_index: Column, start: Column, end: Column) -> Column:
        return F.struct(line_index.cast("int").alias("line_index"), start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"))

    def step(s: Column, x: Column) -> Column:
        h = s["held"]
        over = F.coalesce(h["end_ms"] - x["start_ms"], F.lit(0))
        cut = F.greatest(x["start_ms"], h["start_ms"] + SHORTEST_MS)
        h_end = F.when(over > PUSH_MS, cut).otherwise(h["end_ms"])
        start = F.when(over > PUSH_MS, F.greatest(cut, x["start_ms"])).when(over > 0, h["end_ms"]).otherwise(x["start_ms"])
        end = F.greatest(x["end_ms"], start + x["least_ms"])
        out = F.when(h.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(one(h["line_index"], h["start_ms"], h_end))))
        return F.struct(one(x["line_index"], start, end).alias("held"), out.alias("out"))

    item = F.struct("start_ms", "line_index", "end_ms", least.cast("bigint").alias("least_ms"))
    songs = lines.groupBy("song_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    folded = F.aggregate("x", state, step, lambda s: F.concat(s["out"], F.array(s["held"])))
    return songs.select("song_id", F.explode(folded).alias("y")).select("song_id", "y.line_index", "y.start_ms", "y.end_ms")
