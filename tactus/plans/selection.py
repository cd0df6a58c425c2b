"""Choice between an acoustic and a DTW timeline, and what a stage runner must do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values by acoustic method: trust, least similarity and least confidence of a DTW timeline that may replace it.
TRUST = {"whisperx_official": 1.0, "whisperx_forced": 0.95, "whisperx": 0.75, "faster-whisper": 0.7, "transcriber": 0.65, "cached": 0.6, "aeneas": 0.55, "gentle": 0.45, "even": 0.1, "unknown": 0.5}
LEAST_SIMILARITY = {"whisperx_official": 0.65, "whisperx_forced": 0.6, "whisperx": 0.5, "faster-whisper": 0.5, "transcriber": 0.5, "cached": 0.45, "aeneas": 0.35, "gentle": 0.3, "even": 0.25, "unknown": 0.4}
LEAST_CONFIDENCE = {"whisperx_official": 0.58, "whisperx_forced": 0.55, "whisperx": 0.48, "faster-whisper": 0.48, "transcriber": 0.48, "cached": 0.45, "aeneas": 0.4, "gentle": 0.35, "even": 0.35, "unknown": 0.4}
DRIFT_MS, DRIFT_SIMILARITY, ZERO_SHARE, GAIN = 10_000, 0.5, 0.1, 0.05


def _of(values: dict[str, float], method: Column, default: float) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(known, method), F.lit(default))


def acoustic_score(method: Column, overall: Column, validity: Column) -> Column:
    return F.round(_of(TRUST, method, 0.5) * overall * validity, 4)


def dtw_score(similarity: Column, confidence: Column, anchors: Column, flagged: Column, lines: Column, playback: Column, validity: Column) -> Column:
    n = F.greatest(lines, F.lit(1))
    raw = 0.35 * similarity + 0.3 * confidence + F.least(F.lit(0.1), anchors / n * 0.2) - flagged / n * 0.15 + 0.25 * playback
    return F.round(F.greatest(F.lit(0.0), raw) * validity, 4)


def choose(candidates: DataFrame) -> DataFrame:
    """candidates with source (acoustic or dtw) and the rung of the ladder that decided.

    Columns: method, acoustic_lines, dtw_lines, similarity, confidence, drift_ms,
    zero (lines without times), backwards, clean_after_repair, acoustic, dtw (scores).
    """
    c = F.col
    rung = (
        F.when((c("acoustic_lines") == 0) & (c("dtw_lines") > 0), "only_dtw")
        .when(c("dtw_lines") == 0, "no_dtw")
        .when(c("similarity") < _of(LEAST_SIMILARITY, c("method"), 0.4), "low_similarity")
        .when(c("confidence") < _of(LEAST_CONFIDENCE, c("method"), 0.4), "low_confidence")
        .when((c("drift_ms") > DRIFT_MS) & (c("similarity") < DRIFT_SIMILARITY), "drift")
        .when(c("zero") > ZERO_SHARE * c("dtw_lines"), "zero_times")
        .when((c("backwards") > 0) & (c("backwards") <= 3) & (c("dtw") - c("acoustic") > GAIN) & c("clean_after_repair"), "repaired")
        .when(c("backwards") > 0, "backwards")
        .when(c("dtw") > c("acoustic"), "dtw_score")
        .otherwise("acoustic_score")
    )
    return candidates.withColumn("rung", rung).withColumn("source", F.when(c("rung").isin("only_dtw", "repaired", "dtw_score"), "dtw").otherwise("acoustic"))


def provider_chain(attempts: DataFrame) -> DataFrame:
    """song_id, provider, confidence and failed (providers tried before): the first success by priority; none without any."""
    won = attempts.where("success").groupBy("song_id").agg(F.min(F.struct("priority", "provider", "confidence")).alias("w"))
    joined = attempts.join(won, "song_id", "left")
    before = F.when(~F.col("success") & (F.col("w").isNull() | (F.col("priority") < F.col("w.priority"))), F.struct("priority", "provider"))
    found = joined.groupBy("song_id").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(before)).alias("f"))
    return found.select("song_id", F.coalesce("w.provider", F.lit("none")).alias("provider"), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"), F.transform("f", lambda x: x["provider"]).alias("failed"))


def stages_to_run(manifest: DataFrame, order: list[str], version: str) -> DataFrame:
    """song_id, stage of each stage that is missing or of another version, or follows one that is."""
    planned = manifest.select("song_id").distinct().select("song_id", F.posexplode(F.array(*[F.lit(s) for s in order])).alias("position", "stage"))
    done = manifest.where((F.col("version") == version) & F.col("completed_at").isNotNull()).select("song_id", "stage", F.lit(True).alias("done"))
    state = planned.join(done, ["song_id", "stage"], "left")
    first = state.where("done is null").groupBy("song_id").agg(F.min("position").alias("first"))
    return planned.join(first, "song_id").where("position >= first").select("song_id", "stage", "position")
