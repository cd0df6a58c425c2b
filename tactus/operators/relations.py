"""Relational steps around a timeline: upserts, zips, gaps with speech, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.operators.sequence import song, with_gaps


def upsert(songs: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """songs with changes by key; a null in changes keeps the old value, unknown keys are added."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return songs.join(new, key, "full_outer").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def positional_zip(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of both timelines by number, for songs where both have as many."""
    counts = a.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("song_id").agg(F.count(F.lit(1)).alias("m")), "song_id").where("n = m").select("song_id")
    other = b.select("song_id", "line_index", F.col("start_ms").alias("other_ms"))
    return a.join(counts, "song_id", "left_semi").join(other, ["song_id", "line_index"]).select("song_id", "line_index", (F.col("start_ms") - F.col("other_ms")).alias("drift_ms"))


def drift_stats(zipped: DataFrame, large_ms: int = 10_000) -> DataFrame:
    drift = F.abs("drift_ms")
    return zipped.groupBy("song_id").agg(F.max(drift).alias("most"), F.round(F.avg(drift), 3).alias("mean"), F.count(F.when(drift > large_ms, F.lit(1))).alias("large"))


def unclaimed(words: DataFrame, claimed: DataFrame) -> DataFrame:
    """Words whose start no claimed word has."""
    return words.join(claimed.select("song_id", "start_ms").distinct(), ["song_id", "start_ms"], "left_anti")


def words_in_gaps(lines: DataFrame, words: DataFrame, least_ms: int = 2000, least_words: int = 1, edge_ms: int = 50) -> DataFrame:
    """song_id, line_index, words: pauses after lines with words that start inside them."""
    gaps = with_gaps(lines).where(F.col("gap_ms") >= least_ms).select("song_id", "line_index", F.col("end_ms").alias("low"), (F.col("end_ms") + F.col("gap_ms")).alias("high"))
    inside = words.select("song_id", F.col("start_ms").alias("at")).join(gaps, "song_id").where((F.col("at") > F.col("low") + edge_ms) & (F.col("at") < F.col("high") - edge_ms))
    return inside.groupBy("song_id", "line_index").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") >= least_words)


def timeline_summary(lines: DataFrame) -> DataFrame:
    """song_id with phrases, gap counts, the longest gap and the upper median of durations."""
    df = with_gaps(lines)
    durations = F.sort_array(F.collect_list(F.col("end_ms") - F.col("start_ms")))
    found = df.groupBy("song_id").agg(
        *[F.count(F.when(F.col("gap_class") == c, F.lit(1))).alias(c.lower()) for c in ("CONT", "SOFT", "STRONG")], F.max("gap_ms").alias("longest_gap"), durations.alias("d")
    )
    return found.select("song_id", (F.col("soft") + F.col("strong") + 1).alias("phrases"), "cont", "soft", "strong", "longest_gap", F.element_at("d", F.floor(F.size("d") / 2).cast("int") + 1).alias("median_ms"))


def boundary_audit(lines: DataFrame, short_ms: int = 500, gap_ms: int = 2000, tolerance_ms: int = 10) -> DataFrame:
    """song_id with lines of no length, too short, starting before the line before ends or long after it.

    first_drift is the first line that goes back (null without any), odd the lines with any mark.
    """
    dur, delta = F.col("end_ms") - F.col("start_ms"), F.col("start_ms") - F.lag("end_ms").over(song())
    marks = {"empty": dur <= 0, "short": (dur > 0) & (dur < short_ms), "back": F.coalesce(delta < -tolerance_ms, F.lit(False)), "gap": F.coalesce(delta > gap_ms, F.lit(False))}
    df = lines.withColumns(marks)
    counts = [F.count(F.when(F.col(c), F.lit(1))).alias(f"n_{c}") for c in marks]
    odd = F.count(F.when(F.col("empty") | F.col("short") | F.col("back") | F.col("gap"), F.lit(1)))
    return df.groupBy("song_id").agg(*counts, odd.alias("odd"), F.min(F.when(F.col("back"), F.col("line_index"))).alias("first_drift"))


def drift_curve(lines: DataFrame, segments: DataFrame, near_ms: int = 1000) -> DataFrame:
    """song_id, seg_index, offset of the first line, by order, that starts in or near a segment, and the running sum."""
    near = segments.select("song_id", "seg_index", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    inside = lines.join(near, "song_id").where((F.col("start_ms") >= F.col("s") - near_ms) & (F.col("start_ms") <= F.col("e") + near_ms))
    offset = inside.groupBy("song_id", "seg_index").agg(F.min_by(F.col("start_ms") - F.col("s"), "line_index").alias("offset_ms"))
    return offset.withColumn("total_ms", F.sum("offset_ms").over(W.partitionBy("song_id").orderBy("seg_index").rowsBetween(W.unboundedPreceding, 0)))


def recent(log: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return log.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")


def even_split(lines: DataFrame, parts: int) -> DataFrame:
    """Each line's span in equal parts."""
    each = lines.select("song_id", "line_index", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("dur"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return each.selectExpr("song_id", "line_index", "part", f"start_ms + part * dur div {parts} AS start_ms", f"start_ms + (part + 1) * dur div {parts} AS end_ms")


def changes_only(playheads: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows where the value differs from the row before."""
    previous = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return playheads.withColumn("_p", previous).where(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")
