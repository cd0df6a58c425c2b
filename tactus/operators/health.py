"""Checks of whole timelines: health score, sanity, split quality, the gate for failed recognition.

All are one aggregation a song, after windows that the song's own sort serves.
Times are integer milliseconds; every result has one row a song.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.operators.sequence import song


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _timed(lines: DataFrame) -> DataFrame:
    """lines with dur (not below 0) and the pause since the line before."""
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0).cast("bigint"))
    return lines.withColumns({"dur": dur, "pause": F.col("start_ms") - F.lag("end_ms").over(song())})


def karaoke_health(lines: DataFrame) -> DataFrame:
    """song_id, counts, acoustic_pct, score and grade of lines (with source, where their times come from)."""
    acoustic = F.col("source").isin("char_boundary", "word_boundary")
    c = _timed(lines).groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n"),
        _n(F.col("dur") < 250).alias("short"),
        _n(F.col("dur") > 15_000).alias("very_long"),
        _n((F.col("dur") > 8000) & (F.col("dur") <= 15_000)).alias("long"),
        _n(F.col("pause") > 5000).alias("big_gaps"),
        _n(F.col("pause") < -10).alias("crossing"),
        F.floor(100 * _n(acoustic) / F.count(F.lit(1))).alias("acoustic_pct"),
    )
    # what each kind of fault costs, and at most
    cost = sum((F.least(F.lit(most), F.col(k) * each) for k, each, most in (("short", 4, 20), ("very_long", 15, 30), ("long", 3, 10), ("big_gaps", 3, 10), ("crossing", 5, 20))), F.lit(0))
    cost = cost + F.when(F.col("acoustic_pct") < 60, F.floor((60 - F.col("acoustic_pct")) / 3)).otherwise(F.lit(0))
    c = c.withColumn("score", F.greatest(F.lit(0), 100 - cost).cast("bigint"))
    return c.withColumn("grade", F.when(F.col("score") >= 90, "EXCELLENT").when(F.col("score") >= 75, "GOOD").when(F.col("score") >= 55, "FAIR").otherwise("POOR"))


def sanity(lines: DataFrame) -> DataFrame:
    """song_id, counts of what makes a timeline unusable, and usable."""
    c = _timed(lines).groupBy("song_id").agg(
        F.min("dur").alias("least"),
        F.max("dur").alias("most"),
        _n(F.col("dur") < 400).alias("short"),
        _n(F.col("pause") < -10).alias("back"),
        _n(F.col("pause") > 3000).alias("big_gaps"),
    )
    uneven = (F.col("least") == 0) | (F.col("most") > 20 * F.col("least"))
    return c.withColumn("usable", (F.col("short") == 0) & ~uneven & (F.col("back") == 0) & (F.col("big_gaps") <= 2))


def segment_quality(metrics: DataFrame, method: Column) -> DataFrame:
    """metrics (of quality.split_metrics) with the quality of the split."""
    uneven = F.when(F.col("ratio") > 8, F.least(F.lit(0.4), (F.col("ratio") - 8) / 50)).otherwise(F.lit(0.0))
    cost = F.when(F.col("short") > 0, 0.3).otherwise(0.0) + uneven + F.when(method.isin("proportional", "char_weighted"), 0.15).otherwise(0.0)
    cost = cost + F.when(F.col("wordless") > F.col("lines") * 0.3, 0.2).otherwise(0.0)
    return metrics.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cost)), 3))


def pathological(metrics: DataFrame, most_ratio: float = 8.0) -> DataFrame:
    """metrics with why a split is unusable: short, ratio, sparse, or null."""
    reason = F.when(F.col("lines") <= 1, F.lit(None).cast("string")).when(F.col("least") < 400, "short")
    reason = reason.when((F.col("least") > 0) & (F.col("most") > most_ratio * F.col("least")), "ratio").when(2 * F.col("sparse") > F.col("lines"), "sparse")
    return metrics.withColumn("reason", reason)


def compare_splits(acoustic: DataFrame, proportional: DataFrame) -> DataFrame:
    """song_id with the ratios of both splits' metrics and the verdict."""
    both = acoustic.select("song_id", F.col("ratio").alias("acoustic_ratio")).join(proportional.select("song_id", F.col("ratio").alias("proportional_ratio")), "song_id")
    worse = F.col("acoustic_ratio") > F.greatest(2 * F.col("proportional_ratio"), F.lit(8.0))
    return both.withColumn("verdict", F.when(worse, "proportional_superior").otherwise("acoustic_ok"))


def even_timeline(lines: DataFrame) -> DataFrame:
    """lines with the song's whole span in equal parts."""
    whole = W.partitionBy("song_id")
    placed = lines.withColumns({"k": F.row_number().over(song()) - 1, "of": F.count(F.lit(1)).over(whole), "low": F.min("start_ms").over(whole), "high": F.max("end_ms").over(whole)})
    at = lambda k: F.expr(f"low + {k} * (high - low) div of")
    return placed.withColumns({"start_ms": at("k"), "end_ms": at("(k + 1)")}).drop("k", "of", "low", "high")


def timestamp_validity(issues: DataFrame) -> DataFrame:
    """issues (of quality.timestamp_issues) with a multiplier from 0 to 1."""
    penalty = (F.col("backwards") * 15 + F.col("negative") * 20 + F.col("zero") * 10 + F.col("giant") * 5) / (100 * F.greatest("lines", F.lit(1)))
    return issues.withColumn("validity", F.when(F.col("lines") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), penalty * 5)), 6)))


def recognition_gate(segments: DataFrame, official: DataFrame, confidence: DataFrame) -> DataFrame:
    """song_id with the measures of a recognition and the reasons to replace it by forced alignment.

    segments (song_id, start_ms), official lines (song_id, text), confidence of
    quality.confidence_report. Songs without official text aren't judged.
    """
    wanted = official.where(F.length(F.trim("text")) > 0).groupBy("song_id").agg(F.count(F.lit(1)).alias("lyric_lines"))
    same = segments.groupBy("song_id", F.floor((F.col("start_ms") + 50) / 100).alias("t")).agg(F.count(F.lit(1)).alias("m"))
    found = same.groupBy("song_id").agg(F.sum("m").alias("segments"), _n(F.col("m") > 1).alias("twice"))
    df = wanted.join(found, "song_id", "left").join(confidence.select("song_id", "coverage", "overall", "flagged"), "song_id", "left")
    df = df.na.fill(0, ["segments", "twice", "coverage", "overall", "flagged"])
    each = F.greatest(F.col("segments"), F.lit(1))
    df = df.withColumns({"density": F.round(F.col("segments") / F.col("lyric_lines"), 3), "flagged_ratio": F.round(F.col("flagged") / each, 3), "twice_ratio": F.round(F.col("twice") / each, 3)})
    rules = {
        "density": 100 * F.col("segments") < 35 * F.col("lyric_lines"), "coverage": F.col("coverage") < 0.25, "overall": F.col("overall") < 0.35,
        "flagged": 100 * F.col("flagged") > 40 * each, "twice": 100 * F.col("twice") > 30 * each,
    }
    reasons = F.concat_ws(",", *[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return df.select("song_id", "segments", "lyric_lines", "density", "coverage", "overall", "flagged_ratio", "twice_ratio", reasons.alias("reasons"), (reasons != "").alias("triggered"))


def debug_summary(lines: DataFrame, sources: list[str]) -> DataFrame:
    """song_id with the share of each source, mean and worst drift and its line, and the mean lag, of lines (with source, drift_ms, lag_ms)."""
    size = F.abs("drift_ms")
    shares = [F.round(100 * _n(F.col("source") == s) / F.count(F.lit(1)), 1).alias(f"pct_{s}") for s in sources]
    # of equal drifts, the first line's
    worst = F.max(F.struct(size.alias("drift"), (-F.col("line_index")).alias("line")))
    found = lines.groupBy("song_id").agg(F.count(F.lit(1)).alias("lines"), *shares, F.round(F.avg(size), 3).alias("mean_drift"), worst.alias("w"), F.round(F.avg("lag_ms"), 3).alias("mean_lag"))
    return found.select("song_id", "lines", *[f"pct_{s}" for s in sources], "mean_drift", F.col("w.drift").alias("worst_drift"), (-F.col("w.line")).alias("worst_line"), "mean_lag")


def compression(ratio: Column) -> Column:
    """How strongly a line of ratio times its wanted length is shortened: piecewise linear between fixed points."""
    # Ratio and strength at the bends.
    bends = [(1.2, 0.0), (1.8, 0.35), (2.5, 0.85), (4.0, 0.93), (6.0, 0.97)]
    out = F.when(ratio <= bends[0][0], 0.0)
    for (x, y), (u, v) in zip(bends, bends[1:], strict=False):
        out = out.when(ratio <= u, y + (v - y) * (ratio - x) / (u - x))
    return out.otherwise(bends[-1][1])


def adaptive_cap(moras: Column, gap_s: Column, last: Column, wordless: Column, held: Column) -> Column:
    """Seconds that a line may be shown, from its moras, the pause after it and how it ends."""
    room = F.when(last | (gap_s > 20), 5.0).when(gap_s > 4, 1.0).when(gap_s > 1.5, 0.5).otherwise(0.0)
    cap = 4 + 0.3 * moras + F.when(held, 1.5).otherwise(0.0) + room
    cap = F.when(wordless & ~held, F.least(cap, moras * 0.4 * 1.3)).otherwise(cap)
    return F.greatest(F.lit(4.0), F.least(F.lit(14.0), cap))


def suspect_repeats(lines: DataFrame, least: int = 2) -> DataFrame:
    """song_id, first, last: runs of repeated lines of which one but the last is short and the last is stretched.

    lines must have repeat and filled (placed by an earlier repair; such runs are skipped).
    """
    number = F.row_number().over(song())
    inside = lines.withColumn("_k", number).where("repeat").withColumn("_run", F.col("_k") - F.row_number().over(song()))
    ordered = F.array_sort(F.collect_list(F.struct("line_index", (F.col("end_ms") - F.col("start_ms")).alias("d"))))
    runs = inside.groupBy("song_id", "_run").agg(ordered.alias("x"), F.max("filled").alias("filled")).where((F.size("x") >= least) & ~F.col("filled"))
    others = F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda x: x["d"])
    runs = runs.where((F.array_min(others) < 2000) & (F.element_at("x", -1)["d"] > 2 * F.array_max(others)))
    return runs.select("song_id", F.col("x")[0]["line_index"].alias("first"), F.element_at("x", -1)["line_index"].alias("last"))


def flag_runs(lines: DataFrame, flag: Column) -> DataFrame:
    """song_id, first, last: maximal runs of lines with the flag."""
    inside = lines.withColumn("_k", F.row_number().over(song())).where(flag).withColumn("_run", F.col("_k") - F.row_number().over(song()))
    return inside.groupBy("song_id", "_run").agg(F.min("line_index").alias("first"), F.max("line_index").alias("last")).drop("_run")


def reference_durations(lines: DataFrame, least_ms: int = 500) -> DataFrame:
    """lines with reference_ms: the first earlier duration above least_ms of the same text."""
    dur = F.col("end_ms") - F.col("start_ms")
    earlier = W.partitionBy("song_id", "text").orderBy("line_index").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("reference_ms", F.first(F.when(dur > least_ms, dur), ignorenulls=True).over(earlier))


def confidence_adjustment(count: Column, japanese: Column) -> Column:
    """What a provider's confidence is multiplied by, for its number of lines and its share of Japanese letters."""
    few = F.when(count < 4, 0.5).when(count < 10, 0.8).otherwise(1.0)
    other = F.when(japanese < 0.3, 0.5).when(japanese < 0.6, 0.75).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), few * other))


def drop_repeated_blocks(lines: DataFrame, groups: DataFrame, block: int = 2) -> DataFrame:
    """lines without all but the first block of each group (song_id, chorus, start): block lines from each start."""
    later = groups.withColumn("_k", F.row_number().over(W.partitionBy("song_id", "chorus").orderBy("start"))).where("_k > 1")
    gone = later.select("song_id", F.explode(F.sequence(F.col("start"), F.col("start") + block - 1)).alias("line_index")).distinct()
    return lines.join(gone, ["song_id", "line_index"], "left_anti")
