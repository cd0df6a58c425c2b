"""Timed-text views of the driver's tables, for Spark and as DuckDB SQL.

A document is a song, its lines are the lines of the song; times are integer
milliseconds made from line lengths and numbers, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(documents: DataFrame) -> DataFrame:
    """song_id, line_index, text."""
    return documents.select(F.col("doc_id").alias("song_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_index", "text"))


def doc_timeline(documents: DataFrame) -> DataFrame:
    """song_id, line_index, text, start_ms, end_ms."""
    gap = F.element_at(F.array(*[F.lit(g) for g in (0, 300, 900, 1600, 4200, 50, -200)]), F.col("line_index") % 7 + 1)
    lines = doc_lines(documents).withColumns({"dur": (F.lit(400) + 60 * F.length("text")).cast("bigint"), "gap": gap.cast("bigint")})
    by = W.partitionBy("song_id").orderBy("line_index").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("dur") + F.col("gap")).over(by)
    return lines.select("song_id", "line_index", "text", (end - F.col("dur")).alias("start_ms"), end.alias("end_ms"))


def doc_words(documents: DataFrame) -> DataFrame:
    """song_id, line_index, word_index, word, start_ms, end_ms, score of each word of the timeline."""
    words = doc_timeline(documents).withColumn("w", F.split("text", " ", -1)).withColumn("n", F.size("w"))
    each = words.select("song_id", "line_index", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("dur"), "n", F.posexplode("w").alias("word_index", "word"))
    return each.select(
        "song_id",
        "line_index",
        "word_index",
        "word",
        F.expr("start_ms + word_index * dur div n").alias("start_ms"),
        F.expr("start_ms + (word_index + 1) * dur div n").alias("end_ms"),
        (F.length("word") * 37 % 100 / 100.0).cast("double").alias("score"),
    )


LINES_SQL = """doc_lines AS (
  SELECT doc_id AS song_id, unnest(string_split(text, chr(10))) AS text,
    (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_index FROM documents)"""

TIMELINE_SQL = (
    LINES_SQL
    + """, timed AS (
  SELECT *, 400 + 60 * length(text) AS dur, [0, 300, 900, 1600, 4200, 50, -200][line_index % 7 + 1] AS gap FROM doc_lines),
doc_timeline AS (
  SELECT song_id, line_index, text, (e - dur)::BIGINT AS start_ms, e::BIGINT AS end_ms FROM (
    SELECT *, sum(dur + gap) OVER (PARTITION BY song_id ORDER BY line_index) AS e FROM timed))"""
)

WORDS_SQL = (
    TIMELINE_SQL
    + """, split_words AS (
  SELECT song_id, line_index, start_ms, end_ms - start_ms AS dur, len(string_split(text, ' ')) AS n,
    unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_index FROM doc_timeline),
doc_words AS (
  SELECT song_id, line_index, word_index::INT AS word_index, word, start_ms + word_index * dur // n AS start_ms,
    start_ms + (word_index + 1) * dur // n AS end_ms, (length(word) * 37 % 100 / 100.0)::DOUBLE AS score FROM split_words)"""
)
