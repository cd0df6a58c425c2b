"""Window operators over the lines of a song.

Every operator partitions by song_id and orders by line_index (or start), so a
song's lines meet in one task and one sort serves all windows of a plan.
Times are integer milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def song():
    return W.partitionBy("song_id").orderBy("line_index")


def before():
    return song().rowsBetween(W.unboundedPreceding, -1)


def so_far():
    return song().rowsBetween(W.unboundedPreceding, 0)


def gap_class(gap_ms: Column) -> Column:
    """STRONG above 4 s, SOFT above 1.5 s, else CONT; END without a next line."""
    return F.when(gap_ms.isNull(), "END").when(gap_ms > 4000, "STRONG").when(gap_ms > 1500, "SOFT").otherwise("CONT")


def with_gaps(lines: DataFrame) -> DataFrame:
    """lines with gap_ms to the next line, and gap_class."""
    gap = F.lead("start_ms").over(song()) - F.col("end_ms")
    return lines.withColumn("gap_ms", gap).withColumn("gap_class", gap_class(F.col("gap_ms")))


def phrases(lines: DataFrame) -> DataFrame:
    """song_id, phrase, lines, start_ms, end_ms: runs of lines that SOFT and STRONG gaps end."""
    ends = with_gaps(lines).withColumn("ends", F.col("gap_class").isin("SOFT", "STRONG").cast("int"))
    numbered = ends.withColumn("phrase", F.coalesce(F.sum("ends").over(before()), F.lit(0)))
    return numbered.groupBy("song_id", "phrase").agg(F.count(F.lit(1)).alias("lines"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def islands(df: DataFrame, starts: Column, name: str, order=None) -> DataFrame:
    """df with the number of the run that a row is in; starts is true where one begins."""
    return df.withColumn(name, F.sum(starts.cast("int")).over((order or song()).rowsBetween(W.unboundedPreceding, 0)))


def collapse_adjacent(lines: DataFrame) -> DataFrame:
    """Consecutive lines of equal text become one, from the first start to the last known end."""
    fresh = F.coalesce(F.col("text") != F.lag("text").over(song()), F.lit(True))
    runs = islands(lines.withColumn("fresh", fresh), F.col("fresh"), "run")
    return runs.groupBy("song_id", "run").agg(
        F.min_by("text", "line_index").alias("text"),
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), F.col("line_index"))).alias("end_ms"),
        F.count(F.lit(1)).alias("lines"),
    )


def merge_short(lines: DataFrame, least: int = 2) -> DataFrame:
    """Lines shorter than least letters are appended to the line before."""
    begins = (F.length("text") >= least) | (F.row_number().over(song()) == 1)
    runs = islands(lines.withColumn("begins", begins), F.col("begins"), "run")
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    merged = runs.groupBy("song_id", "run").agg(F.min("line_index").alias("line_index"), F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
    return merged.drop("run")


def merge_short_segments(lines: DataFrame, least: int = 3, within_ms: int = 3000) -> DataFrame:
    """Short segments close behind the one before are appended to it and extend it."""
    near = F.col("start_ms") - F.lag("end_ms").over(song()) < within_ms
    begins = ~((F.length("text") < least) & F.coalesce(near, F.lit(False)))
    runs = islands(lines.withColumn("begins", begins), F.col("begins"), "run")
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "text", "end_ms")))
    parts = runs.groupBy("song_id", "run").agg(F.min("line_index").alias("line_index"), F.min_by("start_ms", "line_index").alias("start_ms"), ordered.alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["text"]), "")
    return parts.select("song_id", "line_index", text.alias("text"), "start_ms", F.element_at("x", -1)["end_ms"].alias("end_ms"))


def drop_hallucinations(lines: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """Without texts that a song repeats at least least times and in share of its lines."""
    same, song = W.partitionBy("song_id", "text"), W.partitionBy("song_id")
    counted = lines.withColumns({"same": F.count(F.lit(1)).over(same), "all": F.count(F.lit(1)).over(song)})
    return counted.where(F.col("same") < F.greatest(F.lit(float(least)), F.col("all") * share)).drop("same", "all")


def word_clusters(words: DataFrame, gap_ms: int = 2500, least: int = 3) -> DataFrame:
    """Clusters of at least least words without a pause of gap_ms."""
    order = W.partitionBy("song_id").orderBy("start_ms", "line_index", "word_index")
    apart = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order) >= gap_ms, F.lit(True))
    runs = islands(words.withColumn("apart", apart), F.col("apart"), "cluster", order)
    found = runs.groupBy("song_id", "cluster").agg(F.count(F.lit(1)).alias("words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return found.where(F.col("words") >= least)


def match_scores(lines: DataFrame) -> DataFrame:
    """lines (with similarity) with temporal and neighbour scores, the anchor mark and confidence.

    An anchor has similarity 0.62 and starts after all anchors before it.
    """
    sim = F.col("similarity")
    earlier_start, after = F.coalesce(F.lag("start_ms").over(song()), F.lit(0)), F.lead("start_ms").over(song())
    fits = (F.col("start_ms") >= earlier_start - 100) & (after.isNull() | (F.col("start_ms") <= after + 1000))
    neighbour = (F.coalesce(F.lag("similarity").over(song()), sim) + sim + F.coalesce(F.lead("similarity").over(song()), sim)) / 3
    good = F.when(sim >= 0.62, F.col("start_ms"))
    scored = lines.withColumns({"temporal": F.when(fits, F.lit(1.0)).otherwise(F.lit(0.3)), "neighbour": neighbour, "_good": good})
    earlier = F.max("_good").over(before())
    anchor = F.col("_good").isNotNull() & (earlier.isNull() | (F.col("_good") > earlier))
    confidence = F.least(F.lit(1.0), 0.5 * sim + 0.25 * F.col("temporal") + 0.2 * F.col("neighbour") + F.when(F.col("anchor"), F.lit(0.005)).otherwise(F.lit(0.0)))
    return scored.withColumn("anchor", anchor).withColumn("confidence", confidence).drop("_good")


def anchor_distance(lines: DataFrame) -> DataFrame:
    """lines (with anchor) with the distance to the nearest anchor, -1 without any."""
    at = F.when(F.col("anchor"), F.col("line_index"))
    last = F.last(at, ignorenulls=True).over(so_far())
    following = F.first(at, ignorenulls=True).over(song().rowsBetween(0, W.unboundedFollowing))
    near = F.least(F.col("line_index") - last, following - F.col("line_index"))
    return lines.withColumn("anchor_distance", F.coalesce(near, F.lit(-1)))


def repeats(lines: DataFrame) -> DataFrame:
    """lines with repeat: whether the text was sung before."""
    return lines.withColumn("repeat", F.row_number().over(W.partitionBy("song_id", "text").orderBy("line_index")) > 1)


def bridge_gaps(lines: DataFrame, words: DataFrame, least_ms: int = 50, most_ms: int = 1500) -> DataFrame:
    """lines (with transcript_index) that start where the line before ends, if the pause between them isn't sung.

    Within one segment any pause goes; between adjacent segments one shorter
    than most_ms without a word of the transcript in it. Whether a word touches
    a pause is told by the latest end of all words that start before the pause
    is over: words and pauses are merged in time order, not joined by range.
    """
    ended, seg = F.lag("end_ms").over(song()), F.col("transcript_index")
    df = lines.withColumns({"_end": ended, "_seg": F.lag(seg).over(song())}).withColumn("_gap", F.col("start_ms") - F.col("_end"))
    ends = df.where(F.col("_gap") > least_ms).select("song_id", "line_index", (F.col("start_ms") + 50).alias("t"), F.col("_end").alias("from"))
    spoken = words.select("song_id", F.lit(None).cast("int").alias("line_index"), F.col("start_ms").alias("t"), F.lit(None).cast("bigint").alias("from"), "end_ms")
    merged = spoken.unionByName(ends.withColumn("end_ms", F.lit(None).cast("bigint")))
    # words come before a pause that ends at the same time
    order = W.partitionBy("song_id").orderBy("t", F.col("line_index").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    told = merged.withColumn("_latest", F.max("end_ms").over(order)).where("line_index is not null")
    sung = told.select("song_id", "line_index", (F.col("_latest") >= F.col("from") - 50).alias("_sung"))
    df = df.join(sung, ["song_id", "line_index"], "left")
    inside = (F.col("_seg") >= 0) & (F.col("_seg") == seg)
    beside = (F.col("_seg") >= 0) & (F.col("_seg") + 1 == seg) & (F.col("_gap") < most_ms) & ~F.coalesce("_sung", F.lit(False))
    moved = F.when((F.col("_gap") > least_ms) & (inside | beside), F.col("_end")).otherwise(F.col("start_ms"))
    return df.withColumn("start_ms", moved).drop("_end", "_seg", "_gap", "_sung")


def subdivide_shared(lines: DataFrame) -> DataFrame:
    """Consecutive lines with one and the same span share it in equal parts."""
    same = (F.col("start_ms") == F.lag("start_ms").over(song())) & (F.col("end_ms") == F.lag("end_ms").over(song())) & (F.col("start_ms") > 0)
    runs = islands(lines.withColumn("own", ~F.coalesce(same, F.lit(False))), F.col("own"), "run")
    run = W.partitionBy("song_id", "run")
    placed = runs.withColumns({"k": F.row_number().over(run.orderBy("line_index")) - 1, "of": F.count(F.lit(1)).over(run), "dur": F.col("end_ms") - F.col("start_ms")})
    start, end = F.expr("start_ms + k * dur div of"), F.expr("start_ms + (k + 1) * dur div of")
    return placed.withColumns({"start_ms": start, "end_ms": end}).drop("own", "run", "k", "of", "dur")


def extend_to_next(lines: DataFrame, most_ms: int = 1200, keep_ms: int = 50) -> DataFrame:
    """A line followed by a pause ends keep_ms before the next one, but is extended by most_ms at most; others stay."""
    following = F.lead("start_ms").over(song())
    gap = following - F.col("end_ms")
    end = F.when(gap <= most_ms, following - keep_ms).otherwise(F.least(F.col("end_ms") + most_ms, following - keep_ms))
    return lines.withColumn("end_ms", F.when(gap > 0, end).otherwise(F.col("end_ms")))


def numbered_bigrams(lines: DataFrame) -> DataFrame:
    """song_id, line_index and grams: the letter pairs of the text, the second and later of a kind numbered.

    So multisets of pairs meet as sets. A single letter is its own gram; an empty or null text has none.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    each = lines.select("song_id", "line_index", "text", F.explode_outer(at).alias("p"))
    each = each.select("song_id", "line_index", F.substring("text", F.col("p"), F.lit(2)).alias("g"))
    counts = each.groupBy("song_id", "line_index", "g").agg(F.count("g").cast("int").alias("n"))
    copies = F.when(F.col("g").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda k: F.concat(F.col("g"), F.lit("#"), k.cast("string"))))
    return counts.groupBy("song_id", "line_index").agg(F.flatten(F.collect_list(copies)).alias("grams"))


def grams_dice(a: Column, b: Column) -> Column:
    """bigram_sim of two texts from their numbered bigrams."""
    return F.coalesce(2.0 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(0.0))


def song_pairs(lines: DataFrame, *columns: str) -> DataFrame:
    """song_id, i, j and the columns of both lines (a_, b_) of all pairs i < j of a song's lines."""
    a = lines.select("song_id", F.col("line_index").alias("i"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = lines.select("song_id", F.col("line_index").alias("j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, "song_id").where("i < j")


def repeated_diagonals(lines: DataFrame, similar, least: int = 2) -> DataFrame:
    """song_id, offset, first, size: runs of least or more lines that are like those offset lines on."""
    a = lines.select("song_id", F.col("line_index").alias("i"), F.col("text").alias("a"))
    b = lines.select("song_id", F.col("line_index").alias("j"), F.col("text").alias("b"))
    pairs = a.join(b, "song_id").where(F.col("j") - F.col("i") >= least).where(similar(F.col("a"), F.col("b")))
    pairs = pairs.select("song_id", (F.col("j") - F.col("i")).alias("offset"), "i")
    return diagonal_runs(pairs, least)


def diagonal_runs(pairs: DataFrame, least: int) -> DataFrame:
    """Runs of pairs (song_id, offset, i) with consecutive i."""
    diagonal = W.partitionBy("song_id", "offset").orderBy("i")
    runs = pairs.withColumn("run", F.col("i") - F.row_number().over(diagonal)).groupBy("song_id", "offset", "run")
    return runs.agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).drop("run")
