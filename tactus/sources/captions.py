"""Caption files as timed lines, by expressions over whole-text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.text import is_noise, normalize_line, vtt_seconds
from tactus.operators.sequence import collapse_adjacent

JSON3 = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"


def _kept(cues: DataFrame) -> DataFrame:
    cues = cues.withColumn("text", normalize_line(F.col("text"))).where(~is_noise(F.col("text")))
    return collapse_adjacent(cues).select("song_id", "run", "text", "start_ms", "end_ms")


def _ms(time: Column) -> Column:
    return F.round(vtt_seconds(time) * 1000).cast("bigint")


def webvtt(files: DataFrame) -> DataFrame:
    """Timed lines of WebVTT texts (song_id, text); a block's first line with an arrow is its cue."""
    block = F.regexp_replace(F.col("block"), r"^\s+|\s+$", "")
    blocks = files.select("song_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n\n+")).alias("line_index", "block")).withColumn("block", block)
    blocks = blocks.where((F.col("block") != "") & ~F.col("block").startswith("WEBVTT") & ~F.col("block").startswith("NOTE"))
    rows = F.split("block", "\n")
    cue = F.element_at(F.filter(rows, lambda r: r.contains(" --> ")), 1)
    cues = blocks.withColumn("cue", F.when(F.exists(rows, lambda r: r.contains(" --> ")), cue)).where("cue is not null")
    words = F.filter(rows, lambda r: ~r.contains(" --> ") & ~F.trim(r).rlike("^[0-9]+$"))
    bare = F.filter(F.transform(words, lambda r: F.trim(F.regexp_replace(r, "<[^>]+>", ""))), lambda r: r != "")
    time = r"([0-9]+:[0-9]{2}:[0-9]{2}[.,][0-9]{3})"
    start, end = (F.regexp_extract("cue", rf"{time}\s+-->\s+{time}", k) for k in (1, 2))
    return _kept(cues.where(F.col("cue").rlike(rf"{time}\s+-->\s+{time}")).select("song_id", "line_index", F.array_join(bare, " ").alias("text"), _ms(start).alias("start_ms"), _ms(end).alias("end_ms")))


def json3(files: DataFrame) -> DataFrame:
    """Timed lines of JSON3 texts (song_id, text)."""
    events = files.select("song_id", F.posexplode(F.from_json("text", JSON3)["events"]).alias("line_index", "e")).where(F.size("e.segs") > 0)
    text = F.trim(F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), "\n", " "))
    start, length = F.coalesce("e.tStartMs", F.lit(0)), F.coalesce("e.dDurationMs", F.lit(0))
    return _kept(events.select("song_id", "line_index", text.alias("text"), start.alias("start_ms"), (start + length).alias("end_ms")))


def coverage(lines: DataFrame) -> DataFrame:
    """Share of lines with a start."""
    return lines.groupBy("song_id").agg(F.avg(F.col("start_ms").isNotNull().cast("int")).alias("coverage"))
