"""Stored results of a song: aligned and canonical lines and transcripts, one JSON document a song.

A store is a folder of JSON lines, partitioned by kind, that all executors
write and read; a document is replaced by writing its kind's folder anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "song_id bigint, lineCount bigint, source string, savedAt timestamp, lines array<struct<index:int,text:string,startMs:bigint,endMs:bigint>>"
TRANSCRIPT = "song_id bigint, backend string, segmentCount bigint, savedAt timestamp, segments array<struct<start:double,end:double,text:string>>"


def line_documents(lines: DataFrame, source: str, now: Column) -> DataFrame:
    """One document a song from its lines (song_id, line_index, text, start_ms, end_ms)."""
    line = F.struct(F.col("line_index").cast("int").alias("index"), "text", F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"))
    songs = lines.groupBy("song_id").agg(F.count(F.lit(1)).alias("lineCount"), F.array_sort(F.collect_list(line)).alias("lines"))
    return songs.select("song_id", "lineCount", F.lit(source).alias("source"), now.alias("savedAt"), "lines")


def transcript_documents(segments: DataFrame, backend: str, now: Column) -> DataFrame:
    """One document a song from its segments (song_id, start, end, text)."""
    songs = segments.groupBy("song_id").agg(F.count(F.lit(1)).alias("segmentCount"), F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("segments"))
    return songs.select("song_id", F.lit(backend).alias("backend"), "segmentCount", now.alias("savedAt"), "segments")


def write(documents: DataFrame, store: str, kind: str) -> None:
    documents.write.mode("overwrite").json(f"{store}/kind={kind}")


def read(spark: SparkSession, store: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{store}/kind={kind}")


def lines_of(documents: DataFrame) -> DataFrame:
    """song_id, line_index, text, start_ms, end_ms of line documents."""
    each = documents.select("song_id", F.explode("lines").alias("x"))
    return each.select("song_id", F.col("x.index").alias("line_index"), "x.text", F.col("x.startMs").alias("start_ms"), F.col("x.endMs").alias("end_ms"))


def legacy(documents: DataFrame) -> DataFrame:
    """song_id, index, startTime, endTime, text: the flat form of older readers, in seconds."""
    flat = lines_of(documents)
    return flat.select("song_id", F.col("line_index").alias("index"), (F.col("start_ms") / 1000).alias("startTime"), (F.col("end_ms") / 1000).alias("endTime"), "text")
