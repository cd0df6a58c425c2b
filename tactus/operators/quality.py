"""Scores of timelines and alignments; one aggregation by song each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.operators.sequence import before, song, with_gaps

# How far an alignment method is trusted.
METHOD_FACTOR = {
    "whisperx_official": 1.00, "whisperx_forced": 1.00, "whisperx": 1.00, "faster-whisper": 0.95, "openai-whisper": 0.85,
    "transcriber": 0.90, "aeneas": 0.70, "gentle": 0.55, "even": 0.20,
}


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def grade_of(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 55, "C").when(score >= 35, "D").otherwise("F")


def timeline_grade(lines: DataFrame) -> DataFrame:
    """song_id, lines, score and grade from short lines, overlaps and pauses inside phrases."""
    df = with_gaps(lines).withColumn("dur", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    cont = F.when(F.col("gap_class") == "CONT", F.col("gap_ms"))
    found = df.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("lines"),
        _n(F.col("dur") < 1500).alias("short"),
        _n(F.col("gap_ms") < -10).alias("overlaps"),
        _n(cont > 500).alias("wide"),
        F.coalesce(F.sum(cont), F.lit(0)).alias("ms"),
        F.count(cont).alias("n"),
    )
    # ten points for each second of the mean pause above 0.3 s
    excess = F.when(F.col("n") > 0, F.greatest((F.col("ms") / F.col("n") - 300) / 100, F.lit(0.0))).otherwise(F.lit(0.0))
    raw = F.round(100 - 8 * F.col("short") - 20 * F.col("overlaps") - 3 * F.col("wide") - excess, 6)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw))).cast("int")
    return found.select("song_id", "lines", score.alias("score")).withColumn("grade", grade_of(F.col("score")))


def timeline_quality(lines: DataFrame) -> DataFrame:
    """song_id with counts of long and short lines and the readability score."""
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    counts = lines.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("lines"), _n(dur > 8000).alias("over_8s"), _n((dur > 5000) & (dur <= 8000)).alias("over_5s"), _n(dur < 1200).alias("under_1s")
    )
    score = F.greatest(F.lit(0), 100 - 15 * F.col("over_8s") - 3 * F.col("over_5s") - 5 * F.col("under_1s"))
    return counts.withColumn("readability", score.cast("int"))


def playback_score(lines: DataFrame) -> DataFrame:
    """song_id, playback: less for unexplained pauses, short and long lines."""
    df = with_gaps(lines).withColumn("dur", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    c = df.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n"), _n((F.col("gap_ms") > 750) & (F.col("gap_ms") < 20000)).alias("gaps"), _n(F.col("dur") < 1500).alias("short"), _n(F.col("dur") > 8000).alias("long")
    )
    loss = F.least(F.lit(0.6), F.col("gaps") / F.col("n") * 0.9) + F.least(F.lit(0.2), F.col("short") / F.col("n") * 0.4) + F.least(F.lit(0.15), F.col("long") / F.col("n") * 0.3)
    return c.select("song_id", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.round(F.round(F.greatest(F.lit(0.0), 1 - loss), 9), 4)).alias("playback"))


def timestamp_issues(lines: DataFrame, giant_ms: int = 30000) -> DataFrame:
    """song_id with counts of lines that go back, have no or negative length, or follow a giant pause."""
    df = lines.withColumn("reached", F.max("end_ms").over(before()))
    return df.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("lines"),
        _n(F.col("start_ms") < F.col("reached") - 100).alias("backwards"),
        _n(F.col("end_ms") < F.col("start_ms")).alias("negative"),
        _n((F.col("start_ms") == 0) & (F.col("end_ms") == 0)).alias("zero"),
        _n(F.col("start_ms") - F.col("reached") > giant_ms).alias("giant"),
    )


def confidence_report(words: DataFrame, lines: DataFrame, method: str = "whisperx") -> DataFrame:
    """song_id with word coverage, mean score, low words, odd pauses, flagged lines and the overall confidence."""
    per_line = words.groupBy("song_id", "line_index").agg(
        F.count(F.lit(1)).alias("n"), _n(F.col("score") > 0).alias("timed"), _n(F.col("score") < 0.4).alias("low"), F.sum(F.round(F.col("score") * 100).cast("bigint")).alias("cents")
    )
    gaps = lines.select("song_id", "line_index", F.greatest(F.col("start_ms") - F.coalesce(F.lag("end_ms").over(song()), F.lit(0)), F.lit(0)).alias("gap"))
    joined = gaps.join(per_line, ["song_id", "line_index"], "left").na.fill(0, ["n", "timed", "low", "cents"])
    positive = F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))))
    per_song = joined.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("n").alias("words"),
        F.sum("timed").alias("timed"),
        F.sum("low").alias("low_words"),
        F.sum("cents").alias("cents"),
        _n(F.col("cents") < 35 * F.greatest(F.col("n"), F.lit(1))).alias("flagged"),
        positive.alias("p"),
        F.collect_list("gap").alias("all"),
    )
    # the upper median
    median = F.when(F.size("p") > 0, F.element_at("p", F.floor(F.size("p") / 2).cast("int") + 1))
    odd = F.size(F.filter("all", lambda g: (g > 3 * F.col("median")) & (g > 2000)))
    df = per_song.withColumn("median", median)
    # a song without words has neither
    share = lambda c: F.when(F.col("words") > 0, F.col(c) / F.greatest(F.col("words"), F.lit(1))).otherwise(F.lit(0.0))
    coverage, mean = share("timed"), share("cents") / 100
    overall = METHOD_FACTOR.get(method, 0.6) * coverage * (0.4 + 0.6 * mean) * (1 - 0.5 * F.col("flagged") / F.col("lines"))
    return df.select("song_id", F.round(coverage, 3).alias("coverage"), F.round(mean, 3).alias("mean_score"), "low_words", "flagged", odd.cast("bigint").alias("odd_gaps"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall)), 3).alias("overall"))


def split_metrics(lines: DataFrame, words: DataFrame, short_ms: int = 400) -> DataFrame:
    """song_id with lines, least, most and mean duration, mean deviation, their ratio (infinite for a least of 0), short lines and lines without words."""
    counts = words.groupBy("song_id", "line_index").agg(F.count(F.lit(1)).alias("w"))
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0).cast("bigint"))
    each = lines.select("song_id", "line_index", dur.alias("d")).join(counts, ["song_id", "line_index"], "left")
    each = each.withColumn("m", F.avg("d").over(W.partitionBy("song_id")))
    found = each.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("d").alias("least"),
        F.max("d").alias("most"),
        F.round(F.avg("d"), 3).alias("mean"),
        F.round(F.avg(F.abs(F.col("d") - F.col("m"))), 3).alias("deviation"),
        _n(F.col("d") < short_ms).alias("short"),
        _n(F.coalesce("w", F.lit(0)) == 0).alias("wordless"),
        _n(F.coalesce("w", F.lit(0)) <= 1).alias("sparse"),
    )
    ratio = F.when(F.col("least") > 0, F.round(F.col("most") / F.greatest(F.col("least"), F.lit(1)), 1)).otherwise(F.lit(float("inf")))
    return found.withColumn("ratio", ratio)


def onset_regression(points: DataFrame) -> DataFrame:
    """song_id, n, slope: drift of lag_ms over t_ms for songs of four points or more."""
    found = points.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("lag_ms", "t_ms").alias("slope"))
    return found.where("n >= 4").withColumn("slope", F.round("slope", 6))
