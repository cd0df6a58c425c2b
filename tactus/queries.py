"""Registered queries of the timed-text operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.adapters import LINES_SQL, TIMELINE_SQL, WORDS_SQL, doc_lines, doc_timeline, doc_words, table
from tactus.functions import similarity as sim
from tactus.functions import text as tx
from tactus.operators import align, folds, joins, line_pairs, quality, relations, sequence
from tactus.plans import selection
from tactus.sources import captions, cards
from tactus.streaming import sync

#: Milliseconds of the events' zoneless time.
MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_timeline(table(spark, sf_dir, "documents"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(table(spark, sf_dir, "documents"))


GAPS_SQL = f"""WITH {TIMELINE_SQL}, gaps AS (
  SELECT *, lead(start_ms) OVER w - end_ms AS gap_ms, greatest(end_ms - start_ms, 0) AS dur FROM doc_timeline
  WINDOW w AS (PARTITION BY song_id ORDER BY line_index)),
classed AS (SELECT *, CASE WHEN gap_ms IS NULL THEN 'END' WHEN gap_ms > 4000 THEN 'STRONG' WHEN gap_ms > 1500 THEN 'SOFT' ELSE 'CONT' END AS gap_class FROM gaps)"""


@query("gap_classes", f"{GAPS_SQL} SELECT song_id, line_index, gap_ms, gap_class FROM classed")
def gap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.with_gaps(_timeline(spark, sf_dir)).select("song_id", "line_index", "gap_ms", "gap_class")


@query(
    "phrase_segments",
    f"""{GAPS_SQL}, numbered AS (
  SELECT *, coalesce(sum(CASE WHEN gap_class IN ('SOFT', 'STRONG') THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY line_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS phrase FROM classed)
SELECT song_id, phrase, count(*) AS lines, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM numbered GROUP BY song_id, phrase""",
)
def phrase_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.phrases(_timeline(spark, sf_dir))


@query(
    "timeline_grade",
    f"""{GAPS_SQL}, agg AS (
  SELECT song_id, count(*) AS lines, count(*) FILTER (dur < 1500) AS n_short, count(*) FILTER (gap_ms < -10) AS n_overlaps,
    count(*) FILTER (gap_class = 'CONT' AND gap_ms > 500) AS wide, coalesce(sum(gap_ms) FILTER (gap_class = 'CONT'), 0) AS ms,
    count(*) FILTER (gap_class = 'CONT') AS n FROM classed GROUP BY song_id),
scored AS (SELECT song_id, lines, greatest(0, least(100, floor(round(100 - 8 * n_short - 20 * n_overlaps - 3 * wide
  - CASE WHEN n > 0 THEN greatest((ms::DOUBLE / n - 300) / 100, 0.0) ELSE 0.0 END, 6))))::INT AS score FROM agg)
SELECT song_id, lines, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade FROM scored""",
)
def timeline_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.timeline_grade(_timeline(spark, sf_dir))


@query(
    "timeline_quality",
    f"""{GAPS_SQL}, agg AS (SELECT song_id, count(*) AS lines, count(*) FILTER (dur > 8000) AS over_8s, count(*) FILTER (dur > 5000 AND dur <= 8000) AS over_5s,
  count(*) FILTER (dur < 1200) AS under_1s FROM classed GROUP BY song_id)
SELECT *, greatest(0, 100 - 15 * over_8s - 3 * over_5s - 5 * under_1s)::INT AS readability FROM agg""",
)
def timeline_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.timeline_quality(_timeline(spark, sf_dir))


@query(
    "playback_score",
    f"""{GAPS_SQL}, agg AS (SELECT song_id, count(*) AS n, count(*) FILTER (gap_ms > 750 AND gap_ms < 20000) AS gaps,
  count(*) FILTER (dur < 1500) AS short, count(*) FILTER (dur > 8000) AS long FROM classed GROUP BY song_id)
SELECT song_id, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE round(round(greatest(0.0::DOUBLE, 1 - (least(0.6::DOUBLE, gaps::DOUBLE / n * 0.9::DOUBLE)
  + least(0.2::DOUBLE, short::DOUBLE / n * 0.4::DOUBLE) + least(0.15::DOUBLE, long::DOUBLE / n * 0.3::DOUBLE))), 9), 4) END AS playback FROM agg""",
)
def playback_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.playback_score(_timeline(spark, sf_dir))


@query(
    "timestamp_issues",
    f"""WITH {TIMELINE_SQL}, r AS (SELECT *, max(end_ms) OVER (PARTITION BY song_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM doc_timeline)
SELECT song_id, count(*) AS lines, count(*) FILTER (start_ms < reached - 100) AS backwards, count(*) FILTER (end_ms < start_ms) AS negative,
  count(*) FILTER (start_ms = 0 AND end_ms = 0) AS zero, count(*) FILTER (start_ms - reached > 30000) AS giant FROM r GROUP BY song_id""",
)
def timestamp_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.timestamp_issues(_timeline(spark, sf_dir))


@query(
    "confidence_report",
    f"""WITH {WORDS_SQL}, per_line AS (
  SELECT song_id, line_index, count(*) AS n, count(*) FILTER (score > 0) AS timed, count(*) FILTER (score < 0.4) AS low, sum(round(score * 100)::BIGINT) AS cents
  FROM doc_words GROUP BY song_id, line_index),
gaps AS (SELECT song_id, line_index, greatest(start_ms - coalesce(lag(end_ms) OVER (PARTITION BY song_id ORDER BY line_index), 0), 0) AS gap FROM doc_timeline),
per_song AS (SELECT g.song_id, count(*) AS lines, sum(n) AS words, sum(timed) AS timed, sum(low) AS low, sum(cents) AS cents,
  count(*) FILTER (cents < 35 * greatest(n, 1)) AS flagged, list_sort(list(gap) FILTER (gap > 0)) AS p, list(gap) AS a
  FROM gaps g LEFT JOIN per_line USING (song_id, line_index) GROUP BY g.song_id),
m AS (SELECT *, p[len(p) // 2 + 1] AS median FROM per_song)
SELECT song_id, round(timed::DOUBLE / words::DOUBLE, 3) AS coverage, round(cents::DOUBLE / words::DOUBLE / 100, 3) AS mean_score, low::BIGINT AS low_words, flagged,
  len(list_filter(a, lambda g: g > 3 * median AND g > 2000))::BIGINT AS odd_gaps,
  round(timed::DOUBLE / words::DOUBLE * (0.4::DOUBLE + 0.6::DOUBLE * (cents::DOUBLE / words::DOUBLE / 100)) * (1 - 0.5::DOUBLE * flagged / lines), 3) AS overall FROM m""",
)
def confidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.confidence_report(doc_words(docs), doc_timeline(docs))


SPLIT_SQL = """c AS (SELECT song_id, line_index, count(*) AS w FROM doc_words GROUP BY song_id, line_index),
d AS (SELECT t.song_id, greatest(end_ms - start_ms, 0) AS d, avg(greatest(end_ms - start_ms, 0)) OVER (PARTITION BY t.song_id) AS m, coalesce(w, 0) AS w
  FROM doc_timeline t LEFT JOIN c ON c.song_id = t.song_id AND c.line_index = t.line_index),
agg AS (SELECT song_id, count(*) AS lines, min(d) AS least, max(d) AS most, round(avg(d), 3) AS mean, round(avg(abs(d - m)), 3) AS deviation,
  count(*) FILTER (d < 400) AS short, count(*) FILTER (w = 0) AS wordless, count(*) FILTER (w <= 1) AS sparse FROM d GROUP BY song_id),
split AS (SELECT *, CASE WHEN least > 0 THEN round(most::DOUBLE / greatest(least, 1)::DOUBLE, 1) ELSE 'inf'::DOUBLE END AS ratio FROM agg)"""


@query("split_metrics", f"WITH {WORDS_SQL}, {SPLIT_SQL} SELECT * FROM split")
def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.split_metrics(doc_timeline(docs), doc_words(docs))


@query(
    "dedupe_adjacent",
    """WITH lines AS (SELECT conv_id AS song_id, turn::INT AS line_index, role AS text, turn * 1000 AS start_ms, turn * 1000 + length(text) AS end_ms FROM conversations),
f AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY song_id ORDER BY line_index) THEN 0 ELSE 1 END AS fresh FROM lines),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY line_index) AS run FROM f)
SELECT song_id, run::BIGINT AS run, arg_min(text, line_index) AS text, min(start_ms)::BIGINT AS start_ms, arg_max(end_ms, line_index)::BIGINT AS end_ms, count(*) AS lines FROM r GROUP BY song_id, run""",
)
def dedupe_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS song_id", "int(turn) AS line_index", "role AS text", "bigint(turn * 1000) AS start_ms", "bigint(turn * 1000 + length(text)) AS end_ms"
    )
    return sequence.collapse_adjacent(turns)


@query(
    "merge_short_lines",
    f"""WITH {LINES_SQL}, b AS (SELECT *, CASE WHEN length(text) >= 30 OR row_number() OVER (PARTITION BY song_id ORDER BY line_index) = 1 THEN 1 ELSE 0 END AS b FROM doc_lines),
r AS (SELECT *, sum(b) OVER (PARTITION BY song_id ORDER BY line_index) AS run FROM b)
SELECT song_id, min(line_index) AS line_index, string_agg(text, '' ORDER BY line_index) AS text FROM r GROUP BY song_id, run""",
)
def merge_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.merge_short(_lines(spark, sf_dir), 30)


@query(
    "hallucination_filter",
    f"""WITH {LINES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY song_id, text) AS same, count(*) OVER (PARTITION BY song_id) AS n FROM doc_lines)
SELECT song_id, line_index, text FROM c WHERE same < greatest(3.0, n * 0.4)""",
)
def hallucination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.drop_hallucinations(_lines(spark, sf_dir)).select("song_id", "line_index", "text")


@query(
    "word_clusters",
    f"""WITH {WORDS_SQL}, a AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w < 2500 THEN 0 ELSE 1 END AS apart FROM doc_words
  WINDOW w AS (PARTITION BY song_id ORDER BY start_ms, line_index, word_index)),
r AS (SELECT *, sum(apart) OVER (PARTITION BY song_id ORDER BY start_ms, line_index, word_index) AS cluster FROM a)
SELECT song_id, cluster::BIGINT AS cluster, count(*) AS words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY song_id, cluster HAVING count(*) >= 3""",
)
def word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.word_clusters(doc_words(table(spark, sf_dir, "documents")))


#: Line similarity to the next line, as a stand-in for a transcript's.
SCORED_SQL = f"""WITH {TIMELINE_SQL}, s AS (SELECT song_id, line_index, start_ms, end_ms, (length(text) * 37 % 101) / 100.0::DOUBLE AS similarity FROM doc_timeline)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).select("song_id", "line_index", "start_ms", "end_ms", (F.length("text") * 37 % 101 / 100.0).cast("double").alias("similarity"))


ANCHORS_SQL = f"""{SCORED_SQL}, g AS (SELECT *, CASE WHEN similarity >= 0.62 THEN start_ms END AS good,
    CASE WHEN start_ms >= coalesce(lag(start_ms) OVER w, 0) - 100 AND (lead(start_ms) OVER w IS NULL OR start_ms <= lead(start_ms) OVER w + 1000) THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS temporal,
    (coalesce(lag(similarity) OVER w, similarity) + similarity + coalesce(lead(similarity) OVER w, similarity)) / 3 AS neighbour
  FROM s WINDOW w AS (PARTITION BY song_id ORDER BY line_index)),
e AS (SELECT *, max(good) OVER (PARTITION BY song_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM g),
a AS (SELECT *, good IS NOT NULL AND (earlier IS NULL OR good > earlier) AS anchor FROM e)"""


@query(
    "match_scores",
    f"""{ANCHORS_SQL} SELECT song_id, line_index, temporal, round(neighbour, 4) AS neighbour, anchor,
  round(least(1.0::DOUBLE, 0.5::DOUBLE * similarity + 0.25::DOUBLE * temporal + 0.2::DOUBLE * neighbour + CASE WHEN anchor THEN 0.005::DOUBLE ELSE 0.0::DOUBLE END), 4) AS confidence FROM a""",
)
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.match_scores(_scored(spark, sf_dir)).select(
        "song_id", "line_index", "temporal", F.round("neighbour", 4).alias("neighbour"), "anchor", F.round("confidence", 4).alias("confidence")
    )


@query(
    "nearest_anchor",
    f"""{ANCHORS_SQL}, n AS (SELECT song_id, line_index, max(CASE WHEN anchor THEN line_index END) OVER (PARTITION BY song_id ORDER BY line_index) AS l,
  min(CASE WHEN anchor THEN line_index END) OVER (PARTITION BY song_id ORDER BY line_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM a)
SELECT song_id, line_index, coalesce(least(line_index - l, f - line_index), -1)::INT AS anchor_distance FROM n""",
)
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequence.anchor_distance(sequence.match_scores(_scored(spark, sf_dir)))
    return found.select("song_id", "line_index", F.col("anchor_distance").cast("int").alias("anchor_distance"))


@query("repeat_flags", f"WITH {LINES_SQL} SELECT song_id, line_index, row_number() OVER (PARTITION BY song_id, text ORDER BY line_index) > 1 AS repeat FROM doc_lines")
def repeat_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.repeats(_lines(spark, sf_dir)).select("song_id", "line_index", "repeat")


@query(
    "bridge_gaps",
    f"""WITH {WORDS_SQL}, p AS (SELECT *, line_index // 2 AS seg, lag(end_ms) OVER w AS pe, lag(line_index // 2) OVER w AS ps FROM doc_timeline WINDOW w AS (PARTITION BY song_id ORDER BY line_index)),
s AS (SELECT p.song_id, p.line_index, bool_or(w.end_ms >= pe - 50) AS sung FROM p JOIN doc_words w ON w.song_id = p.song_id AND w.line_index % 3 = 0 AND w.start_ms <= p.start_ms + 50 GROUP BY p.song_id, p.line_index)
SELECT p.song_id, p.line_index, CASE WHEN start_ms - pe > 50 AND (seg = ps OR seg = ps + 1 AND start_ms - pe < 1500 AND NOT coalesce(sung, false)) THEN pe ELSE start_ms END AS start_ms, end_ms
FROM p LEFT JOIN s ON s.song_id = p.song_id AND s.line_index = p.line_index""",
)
def bridge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines a segment; the transcript has the words of every third line."""
    docs = table(spark, sf_dir, "documents")
    lines = doc_timeline(docs).withColumn("transcript_index", F.expr("line_index div 2"))
    return sequence.bridge_gaps(lines, doc_words(docs).where("line_index % 3 = 0")).select("song_id", "line_index", "start_ms", "end_ms")


@query(
    "extend_to_next",
    f"""WITH {TIMELINE_SQL}, p AS (SELECT *, lead(start_ms) OVER (PARTITION BY song_id ORDER BY line_index) AS ns FROM doc_timeline)
SELECT song_id, line_index, start_ms, CASE WHEN ns IS NULL OR ns <= end_ms THEN end_ms WHEN ns - end_ms <= 1200 THEN ns - 50 ELSE least(end_ms + 1200, ns - 50) END AS end_ms FROM p""",
)
def extend_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.extend_to_next(_timeline(spark, sf_dir)).select("song_id", "line_index", "start_ms", "end_ms")


@query(
    "subdivide_shared",
    f"""WITH {TIMELINE_SQL}, q AS (SELECT song_id, line_index, start_ms // 20000 * 20000 AS start_ms, start_ms // 20000 * 20000 + 20000 AS end_ms FROM doc_timeline),
s AS (SELECT *, CASE WHEN start_ms = lag(start_ms) OVER w AND end_ms = lag(end_ms) OVER w AND start_ms > 0 THEN 0 ELSE 1 END AS own FROM q WINDOW w AS (PARTITION BY song_id ORDER BY line_index)),
r AS (SELECT *, sum(own) OVER (PARTITION BY song_id ORDER BY line_index) AS run FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY song_id, run ORDER BY line_index) - 1 AS k, count(*) OVER (PARTITION BY song_id, run) AS n FROM r)
SELECT song_id, line_index, (start_ms + k * (end_ms - start_ms) // n)::BIGINT AS start_ms, (start_ms + (k + 1) * (end_ms - start_ms) // n)::BIGINT AS end_ms FROM k""",
)
def subdivide_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = _timeline(spark, sf_dir).selectExpr("song_id", "line_index", "start_ms div 20000 * 20000 AS start_ms", "start_ms div 20000 * 20000 + 20000 AS end_ms")
    return sequence.subdivide_shared(coarse)


@query(
    "repeat_diagonals",
    f"""WITH {LINES_SQL}, p AS (SELECT a.song_id, b.line_index - a.line_index AS off, a.line_index AS i FROM doc_lines a JOIN doc_lines b
    ON a.song_id = b.song_id AND b.line_index - a.line_index >= 2 AND a.text = b.text),
r AS (SELECT *, i - row_number() OVER (PARTITION BY song_id, off ORDER BY i) AS run FROM p)
SELECT song_id, off AS "offset", min(i) AS first, count(*) AS size FROM r GROUP BY song_id, off, run HAVING count(*) >= 1""",
)
def repeat_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # equal lines meet by hash, without the pairs of a song's other lines
    lines = _lines(spark, sf_dir)
    a, b = lines.select("song_id", "text", F.col("line_index").alias("i")), lines.select("song_id", "text", F.col("line_index").alias("j"))
    pairs = a.join(b, ["song_id", "text"]).where("j - i >= 2").selectExpr("song_id", "j - i AS offset", "i")
    return sequence.diagonal_runs(pairs, 1)


@query("similar_diagonals")
def similar_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeat_diagonals as W08 has it: runs of two or more lines with bigram similarity 0.78 or more."""
    return line_pairs.similar_runs(_lines(spark, sf_dir), 0.78, 2)


@query(
    "repair_monotone",
    f"""WITH RECURSIVE {TIMELINE_SQL}, o AS (SELECT song_id, line_index, start_ms - (line_index % 5) * 700 AS s, end_ms AS e FROM doc_timeline),
f(song_id, line_index, start_ms, end_ms, reached) AS (
  SELECT song_id, line_index, s, e, greatest(-1000, e) FROM (SELECT song_id, line_index, s, e FROM o WHERE line_index = 0)
  UNION ALL
  SELECT o.song_id, o.line_index, CASE WHEN o.s < f.reached - 100 THEN f.reached + 50 ELSE o.s END,
    CASE WHEN o.s < f.reached - 100 AND o.e < f.reached + 50 THEN f.reached + 550 ELSE o.e END,
    greatest(f.reached, CASE WHEN o.s < f.reached - 100 AND o.e < f.reached + 50 THEN f.reached + 550 ELSE o.e END)
  FROM f JOIN o ON o.song_id = f.song_id AND o.line_index = f.line_index + 1)
SELECT song_id, line_index, start_ms, end_ms FROM f""",
)
def repair_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    jittered = _timeline(spark, sf_dir).withColumn("start_ms", F.col("start_ms") - F.col("line_index") % 5 * 700)
    return folds.repair_monotone(jittered)


@query("finalize_timeline")
def finalize_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    jittered = _timeline(spark, sf_dir).withColumn("start_ms", F.greatest(F.col("start_ms") - F.col("line_index") % 5 * 700, F.lit(0)))
    return folds.finalize(jittered)


@query(
    "asof_active_line",
    f"""WITH {TIMELINE_SQL}, p AS (SELECT event_id, user_id AS song_id, epoch_us(ts) // 1000 % 60000 AS t_ms FROM events),
m AS (SELECT p.*, d.line_index, d.end_ms FROM p ASOF LEFT JOIN (SELECT song_id, start_ms, arg_max(line_index, line_index) AS line_index, arg_max(end_ms, line_index) AS end_ms
    FROM doc_timeline GROUP BY song_id, start_ms) d ON p.song_id = d.song_id AND p.t_ms >= d.start_ms)
SELECT song_id, event_id, t_ms, CASE WHEN t_ms <= end_ms THEN line_index ELSE -1 END::INT AS active_line FROM m""",
)
def asof_active_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS song_id", f"{MILLIS} % 60000 AS t_ms")
    return joins.as_of(heads, _timeline(spark, sf_dir))


SEGMENTS_SQL = f"""WITH {TIMELINE_SQL}, segments AS (
  SELECT song_id, (line_index // 3)::INT AS seg_index, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM doc_timeline GROUP BY song_id, line_index // 3)"""


def _segments(lines: DataFrame) -> DataFrame:
    return lines.groupBy("song_id", F.expr("int(line_index div 3)").alias("seg_index")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(
    "duration_map",
    f"""{SEGMENTS_SQL}, s AS (SELECT *, greatest(end_ms - start_ms, 100) AS dur FROM segments),
c AS (SELECT *, sum(dur) OVER (PARTITION BY song_id ORDER BY seg_index) AS upto, sum(dur) OVER (PARTITION BY song_id) AS total FROM s),
l AS (SELECT song_id, line_index, count(*) OVER (PARTITION BY song_id) AS n FROM doc_timeline)
SELECT song_id, line_index, seg_index FROM l JOIN c USING (song_id) WHERE (2 * line_index + 1) * total >= 2 * n * (upto - dur) AND (2 * line_index + 1) * total < 2 * n * upto""",
)
def duration_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timeline(spark, sf_dir)
    return joins.duration_map(lines, _segments(lines))


@query(
    "interval_overlap",
    f"""{SEGMENTS_SQL}, b AS (SELECT l.song_id, line_index AS i, seg_index AS j,
    greatest(least(l.end_ms, s.end_ms) - greatest(l.start_ms, s.start_ms), 0) AS ms FROM doc_timeline l JOIN segments s USING (song_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id, i ORDER BY ms DESC, j) AS k FROM b)
SELECT song_id, i, j, ms AS overlap_ms FROM r WHERE k = 1""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timeline(spark, sf_dir)
    return joins.best_overlap(lines.withColumnRenamed("line_index", "i"), _segments(lines).withColumnRenamed("seg_index", "j"))


@query(
    "range_containment",
    f"""{SEGMENTS_SQL} SELECT l.song_id, line_index, seg_index FROM doc_timeline l JOIN segments s ON l.song_id = s.song_id AND l.start_ms BETWEEN s.start_ms AND s.end_ms""",
)
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timeline(spark, sf_dir)
    return joins.contained(lines, _segments(lines)).select("song_id", "line_index", "seg_index")


PAIRS_SQL = f"""WITH {LINES_SQL}, bench AS (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark),
pairs AS (SELECT song_id, line_index, item_id, l.text AS a, b.text AS b FROM doc_lines l JOIN bench b
  ON substr(l.text, 1, 6) = substr(b.text, 1, 6) AND length(l.text) > 5 AND length(b.text) > 5)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents and of the benchmark, blocked by their first six letters."""
    a = _lines(spark, sf_dir).where("length(text) > 5").selectExpr("song_id", "line_index", "text AS a", "substr(text, 1, 6) AS k")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n", -1)).alias("b")).where("length(b) > 5")
    return a.join(b.withColumn("k", F.expr("substr(b, 1, 6)")), "k").select("song_id", "line_index", "item_id", "a", "b")


@query("lev_sim")  # DuckDB counts bytes
def lev_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a song's lines."""
    pairs = line_pairs.distance_pairs(_lines(spark, sf_dir))
    return pairs.select("song_id", "i", "j", F.round(line_pairs.lev_sim_of(F.col("distance"), F.col("longer")), 6).alias("similarity"))


@query("song_bigram_dice")
def song_bigram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bigram_dice of all pairs of a song's lines."""
    pairs = line_pairs.gram_pairs(_lines(spark, sf_dir))
    return pairs.select("song_id", "i", "j", F.round(line_pairs.dice_of(F.col("common"), F.col("total")), 6).alias("similarity"))


@query("song_recall_sim")
def song_recall_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall_sim both ways of all pairs of a song's lines, without the first letters that its SQL asks for."""
    grams = _lines(spark, sf_dir).withColumn("grams", F.array_distinct(sim.bigrams(F.col("text"))))
    pairs = sequence.song_pairs(grams, "grams")
    common = F.size(F.array_intersect("a_grams", "b_grams"))
    share = [F.coalesce(F.round(common / F.nullif(F.size(c), F.lit(0)), 4), F.lit(0.0)) for c in ("a_grams", "b_grams")]
    return pairs.select("song_id", "i", "j", share[0].alias("similarity"), share[1].alias("reverse"))


_BIGRAMS = "list_transform(range(1, length({0})::BIGINT), lambda i: substr({0}, i, 2))"


#: All lines of documents and all of the benchmark; letter pairs are counted once a text and meet by joins.
DICE_SQL = f"""WITH {LINES_SQL}, bench AS (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark),
x AS (SELECT text, g, count(*) AS n FROM (SELECT text, unnest({_BIGRAMS.format("text")}) AS g FROM (SELECT DISTINCT text FROM doc_lines)) GROUP BY text, g),
y AS (SELECT text, g, count(*) AS n FROM (SELECT text, unnest({_BIGRAMS.format("text")}) AS g FROM (SELECT DISTINCT text FROM bench)) GROUP BY text, g),
met AS (SELECT x.text AS a, y.text AS b, sum(least(x.n, y.n)) AS n FROM x JOIN y ON x.g = y.g GROUP BY x.text, y.text)
SELECT song_id, line_index, item_id, CASE WHEN l.text = '' OR b.text = '' THEN 0.0::DOUBLE WHEN length(l.text) < 2 OR length(b.text) < 2 THEN (l.text = b.text)::INT::DOUBLE
  ELSE round(2.0::DOUBLE * coalesce(met.n, 0) / (length(l.text) + length(b.text) - 2), 6) END AS similarity
FROM doc_lines l CROSS JOIN bench b LEFT JOIN met ON met.a = l.text AND met.b = b.text"""


@query("bigram_dice", DICE_SQL)
def bigram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents with every line of the benchmark."""
    others = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    return line_pairs.dice_with(_lines(spark, sf_dir), others, "item_id")


@query(
    "recall_sim",
    f"""{PAIRS_SQL}, g AS (SELECT song_id, line_index, item_id, list_distinct({_BIGRAMS.format("a")}) AS x, {_BIGRAMS.format("b")} AS y FROM pairs)
SELECT song_id, line_index, item_id, round(len(list_intersect(x, y))::DOUBLE / len(x), 4) AS similarity FROM g""",
)
def recall_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("song_id", "line_index", "item_id", sim.recall_sim(F.col("a"), F.col("b")).alias("similarity"))


@query(
    "noise_filter",
    f"""WITH {LINES_SQL}, b AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM doc_lines)
SELECT song_id, line_index FROM b WHERE NOT (length(bare) = 0 OR regexp_matches(bare, '^[-─━=～〜＝]{{3,}}\\s*$')
  OR length(regexp_replace(regexp_replace(bare, '[\\[【（(][^】\\]）)]*[\\]】）)]', '', 'g'), '\\s+', '', 'g')) = 0
  OR (length(bare) <= 3 AND NOT regexp_matches(bare, '[぀-ゟ゠-ヿ一-鿿㐀-䶿]')))""",
)
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(~tx.is_noise(F.col("text"))).select("song_id", "line_index")


@query(
    "mora_count",
    f"""WITH {LINES_SQL} SELECT song_id, line_index, greatest(len(regexp_extract_all(text, '[A-Za-z]')), 1)::INT AS moras FROM doc_lines""",
)
def mora_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("song_id", "line_index", tx.mora_count(F.col("text")).cast("int").alias("moras"))


@query(
    "job_queue_depth",
    "SELECT user_id, count(*) FILTER (event_type IN ('signup', 'click')) AS open_jobs, count(*) AS jobs FROM events GROUP BY user_id",
)
def job_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = F.when(F.col("event_type").isin("signup", "click"), F.lit(1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(waiting).alias("open_jobs"), F.count(F.lit(1)).alias("jobs"))


@query(
    "provider_chain",
    """WITH p AS (SELECT doc_id % 50 AS song_id, doc_id, substr(source, 4)::INT AS priority, length(text) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY priority, doc_id) AS k FROM p WHERE n >= 300)
SELECT song_id, doc_id, priority FROM r WHERE k = 1""",
)
def provider_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provider, by priority, with enough text; an aggregate, since one winner a song is wanted."""
    p = table(spark, sf_dir, "documents").selectExpr("doc_id % 50 AS song_id", "doc_id", "int(substr(source, 4)) AS priority", "length(text) AS n").where("n >= 300")
    return p.groupBy("song_id").agg(F.min(F.struct("priority", "doc_id")).alias("m")).select("song_id", "m.doc_id", "m.priority")


@query(
    "recent_rich_log",
    """WITH j AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY user_id, ts::DATE),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM j WHERE n >= 2)
SELECT user_id, day, n FROM r WHERE k = 1""",
)
def recent_rich_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return jobs.groupBy("user_id").agg(F.max(F.struct("day", "n")).alias("m")).select("user_id", "m.day", "m.n")


@query(
    "onset_regression",
    """WITH p AS (SELECT user_id AS song_id, epoch_us(ts) // 1000 % 60000 AS t_ms, event_id % 977 AS lag_ms FROM events)
SELECT song_id, count(*) AS n, round(regr_slope(lag_ms, t_ms), 6) AS slope FROM p GROUP BY song_id HAVING count(*) >= 4""",
)
def onset_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").selectExpr("user_id AS song_id", f"{MILLIS} % 60000 AS t_ms", "event_id % 977 AS lag_ms")
    return quality.onset_regression(points)


@query(
    "normalize_lines",
    f"""WITH {LINES_SQL}, a AS (SELECT song_id, line_index, translate(text, '–･’‘“”', '—・''''""') AS t FROM doc_lines),
b AS (SELECT song_id, line_index, regexp_replace(regexp_replace(regexp_replace(t, '[\\[(（][0-9]{{1,2}}:[0-9]{{2}}(?:\\.[0-9]+)?[\\])）]', '', 'g'),
  '[\\[【（(][^】\\]）)]*[\\]】）)]', '', 'g'), '^[ \\t\\r　]+|[ \\t\\r　]+$', '', 'g') AS t FROM a)
SELECT song_id, line_index, regexp_replace(trim(t), '[ \\t　]{{2,}}', ' ', 'g') AS text FROM b""",
)
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("song_id", "line_index", tx.normalize_line(F.col("text")).alias("text"))


@query(
    "card_rows",
    """SELECT item_id, concat_ws(chr(9), 'Basic', 'deck', 'Item ' || item_id, replace(replace(text, chr(9), '    '), chr(10), '<br>'), 'a_b c') AS value FROM benchmark""",
)
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards_in = table(spark, sf_dir, "benchmark").selectExpr("item_id", "'Basic' AS note_type", "'deck' AS deck", "concat('Item ', item_id) AS front", "text AS back", "array('a b', 'c') AS tags")
    return cards.tsv_rows(cards_in, "item_id")


_METHODS = list(selection.TRUST)
_SELECTOR_SQL = ", ".join(f"({k}, '{m}', {selection.LEAST_SIMILARITY[m]}::DOUBLE, {selection.LEAST_CONFIDENCE[m]}::DOUBLE)" for k, m in enumerate(_METHODS))


@query(
    "selector",
    f"""WITH m(k, method, ls, lc) AS (VALUES {_SELECTOR_SQL}), c AS (
  SELECT doc_id AS song_id, method, ls, lc, n_chars % 11 AS al, n_chars % 13 AS dl, (n_chars % 100) / 100.0::DOUBLE AS similarity, (n_chars * 7 % 100) / 100.0::DOUBLE AS confidence,
    n_chars * 13 % 20000 AS drift, CASE WHEN n_chars % 7 = 0 THEN 3 ELSE 0 END AS zero, n_chars % 6 AS bw, n_chars % 2 = 0 AS clean,
    (n_chars * 3 % 100) / 100.0::DOUBLE AS a, (n_chars * 11 % 100) / 100.0::DOUBLE AS d FROM documents JOIN m ON m.k = doc_id % 10),
r AS (SELECT song_id, CASE WHEN al = 0 AND dl > 0 THEN 'only_dtw' WHEN dl = 0 THEN 'no_dtw' WHEN similarity < ls THEN 'low_similarity' WHEN confidence < lc THEN 'low_confidence'
  WHEN drift > 10000 AND similarity < 0.5 THEN 'drift' WHEN zero > 0.1 * dl THEN 'zero_times' WHEN bw > 0 AND bw <= 3 AND d - a > 0.05::DOUBLE AND clean THEN 'repaired'
  WHEN bw > 0 THEN 'backwards' WHEN d > a THEN 'dtw_score' ELSE 'acoustic_score' END AS rung FROM c)
SELECT song_id, rung, CASE WHEN rung IN ('only_dtw', 'repaired', 'dtw_score') THEN 'dtw' ELSE 'acoustic' END AS source FROM r""",
)
def selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.element_at(F.array(*[F.lit(m) for m in _METHODS]), (F.col("doc_id") % 10 + 1).cast("int"))
    candidates = table(spark, sf_dir, "documents").withColumn("method", method).selectExpr(
        "doc_id AS song_id", "method", "n_chars % 11 AS acoustic_lines", "n_chars % 13 AS dtw_lines", "double(n_chars % 100 / 100.0) AS similarity", "double(n_chars * 7 % 100 / 100.0) AS confidence",
        "n_chars * 13 % 20000 AS drift_ms", "if(n_chars % 7 = 0, 3, 0) AS zero", "n_chars % 6 AS backwards", "n_chars % 2 = 0 AS clean_after_repair",
        "double(n_chars * 3 % 100 / 100.0) AS acoustic", "double(n_chars * 11 % 100 / 100.0) AS dtw",
    )
    return selection.choose(candidates).select("song_id", "rung", "source")


@query(
    "stage_plan",
    """WITH s(position, stage) AS (VALUES (0, 'download'), (1, 'transcribe'), (2, 'align'), (3, 'postprocess')),
p AS (SELECT DISTINCT user_id AS song_id FROM events), done AS (SELECT DISTINCT user_id AS song_id, event_type FROM events WHERE event_id % 97 < 2),
state AS (SELECT p.song_id, s.position, s.stage, EXISTS (SELECT 1 FROM done d WHERE d.song_id = p.song_id AND d.event_type = CASE s.position WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'error' END) AS ok FROM p, s),
f AS (SELECT song_id, min(position) AS first FROM state WHERE NOT ok GROUP BY song_id)
SELECT state.song_id, stage, position::INT AS position FROM state JOIN f USING (song_id) WHERE position >= first""",
)
def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = "CASE event_type WHEN 'click' THEN 'download' WHEN 'view' THEN 'transcribe' WHEN 'purchase' THEN 'align' WHEN 'error' THEN 'postprocess' END"
    manifest = table(spark, sf_dir, "events").selectExpr("user_id AS song_id", f"{stage} AS stage", "if(event_id % 97 < 2, '25', '24') AS version", "ts AS completed_at").distinct()
    manifest = manifest.groupBy("song_id", "stage").agg(F.max("version").alias("version"), F.max("completed_at").alias("completed_at"))
    return selection.stages_to_run(manifest, ["download", "transcribe", "align", "postprocess"], "25")


@query("match_pipeline")
def match_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as official lines against the user's and assistant's turns as a transcript."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id AS song_id", "int(turn) AS line_index", "text", "role")
    official = turns.select("song_id", "line_index", tx.match_form(F.col("text")).alias("form"))
    transcript = turns.where("role <> 'system'").select("song_id", F.col("line_index").alias("seg_index"), tx.match_form(F.col("text")).alias("form"), F.expr("bigint(line_index * 4000) AS start_ms"), F.expr("bigint(line_index * 4000 + 3500) AS end_ms"))
    return sequence.match_scores(align.match(official, transcript)).drop("neighbour")


@query("vtt_parse")
def vtt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a WebVTT file, one cue a second and turn, and back to lines."""
    cue = "concat(turn, '\\n00:', lpad(turn div 60, 2, '0'), ':', lpad(turn % 60, 2, '0'), '.000 --> 00:', lpad((turn + 1) div 60, 2, '0'), ':', lpad((turn + 1) % 60, 2, '0'), '.000\\n', replace(text, '\\n', ' '))"
    cues = table(spark, sf_dir, "conversations").selectExpr("conv_id AS song_id", "turn", f"{cue} AS cue")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "cue")))
    files = cues.groupBy("song_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(ordered, lambda x: x["cue"]), "\n\n")).alias("text"))
    return captions.webvtt(files)


@query("sync_sessions")
def sync_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players' events as sessions: clicks seek, purchases anchor by hand, the rest tick."""
    kind = "CASE event_type WHEN 'click' THEN 'seek' WHEN 'purchase' THEN 'manual_anchor' ELSE 'tick' END"
    events = table(spark, sf_dir, "events").selectExpr("user_id AS session_id", f"{MILLIS} AS now_ms", f"{kind} AS kind", "double(event_id % 81 - 40) / 10 AS drift", "double(event_id % 100) / 100 AS confidence")
    return sync.batch(events)


@query(
    "song_upsert",
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' END AS lang, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT item_id + 1000000, 'xx', NULL FROM benchmark)
SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, coalesce(c.lang, d.lang) AS lang, coalesce(c.source, d.source) AS source FROM documents d FULL JOIN c ON d.doc_id = c.doc_id""",
)
def song_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changed = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'new' END AS lang", "source")
    added = table(spark, sf_dir, "benchmark").selectExpr("item_id + 1000000 AS doc_id", "'xx' AS lang", "string(null) AS source")
    return relations.upsert(docs, changed.unionByName(added), "doc_id", ["lang", "source"])


@query(
    "drift_stats",
    f"""WITH {TIMELINE_SQL}, z AS (SELECT song_id, abs((line_index % 4) * 4000 - song_id % 9000) AS d FROM doc_timeline)
SELECT song_id, max(d) AS most, round(avg(d), 3) AS mean, count(*) FILTER (d > 10000) AS large FROM z GROUP BY song_id""",
)
def drift_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timeline(spark, sf_dir)
    moved = lines.withColumn("start_ms", F.expr("start_ms - line_index % 4 * 4000 + song_id % 9000"))
    return relations.drift_stats(relations.positional_zip(lines, moved))


@query(
    "unclaimed_words",
    f"""WITH {WORDS_SQL} SELECT w.song_id, line_index, word_index FROM doc_words w
WHERE NOT EXISTS (SELECT 1 FROM doc_words c WHERE c.line_index % 3 = 0 AND c.song_id = w.song_id AND c.start_ms = w.start_ms)""",
)
def unclaimed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = doc_words(table(spark, sf_dir, "documents"))
    return relations.unclaimed(words, words.where("line_index % 3 = 0")).select("song_id", "line_index", "word_index")


@query(
    "words_in_gaps",
    f"""WITH {TIMELINE_SQL}, w AS (SELECT song_id, start_ms + 2600 AS t FROM doc_timeline), g AS (
  SELECT song_id, line_index, end_ms AS low, lead(start_ms) OVER (PARTITION BY song_id ORDER BY line_index) AS high FROM doc_timeline)
SELECT g.song_id, line_index, count(*) AS words FROM g JOIN w ON w.song_id = g.song_id AND t > low + 50 AND t < high - 50 WHERE high - low >= 1500 GROUP BY g.song_id, line_index""",
)
def words_in_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timeline(spark, sf_dir)
    return relations.words_in_gaps(lines, lines.withColumn("start_ms", F.col("start_ms") + 2600), least_ms=1500)


@query(
    "timeline_summary",
    f"""{GAPS_SQL}, a AS (SELECT song_id, count(*) FILTER (gap_class = 'CONT') AS cont, count(*) FILTER (gap_class = 'SOFT') AS soft, count(*) FILTER (gap_class = 'STRONG') AS strong,
  max(gap_ms) AS longest_gap, list_sort(list(end_ms - start_ms)) AS d FROM classed GROUP BY song_id)
SELECT song_id, soft + strong + 1 AS phrases, cont, soft, strong, longest_gap, d[len(d) // 2 + 1] AS median_ms FROM a""",
)
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.timeline_summary(_timeline(spark, sf_dir))


@query(
    "boundary_audit",
    f"""WITH {TIMELINE_SQL}, r AS (SELECT *, end_ms - start_ms AS dur, start_ms - lag(end_ms) OVER (PARTITION BY song_id ORDER BY line_index) AS delta FROM doc_timeline)
SELECT song_id, count(*) FILTER (dur <= 0) AS n_empty, count(*) FILTER (dur > 0 AND dur < 500) AS n_short, count(*) FILTER (delta < -10) AS n_back, count(*) FILTER (delta > 2000) AS n_gap,
  count(*) FILTER (dur < 500 OR delta < -10 OR delta > 2000) AS odd, min(line_index) FILTER (delta < -10) AS first_drift FROM r GROUP BY song_id""",
)
def boundary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.boundary_audit(_timeline(spark, sf_dir))


@query(
    "drift_curve",
    f"""{SEGMENTS_SQL}, o AS (SELECT l.song_id, seg_index, arg_min(l.start_ms - s.start_ms, line_index) AS offset_ms FROM doc_timeline l JOIN segments s
  ON l.song_id = s.song_id AND l.start_ms BETWEEN s.start_ms - 1000 AND s.end_ms + 1000 GROUP BY l.song_id, seg_index)
SELECT *, (sum(offset_ms) OVER (PARTITION BY song_id ORDER BY seg_index))::BIGINT AS total_ms FROM o""",
)
def drift_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timeline(spark, sf_dir)
    return relations.drift_curve(lines, _segments(lines))


@query(
    "recent_logs",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5",
)
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest log rows of each job: a top-k report."""
    return relations.recent(table(spark, sf_dir, "events"), "user_id", "event_id", 5).select("user_id", "event_id", "event_type")


@query(
    "even_split",
    f"WITH {TIMELINE_SQL} SELECT song_id, line_index, k::INT AS part, start_ms + k * (end_ms - start_ms) // 4 AS start_ms, start_ms + (k + 1) * (end_ms - start_ms) // 4 AS end_ms FROM doc_timeline, range(4) r(k)",
)
def even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.even_split(_timeline(spark, sf_dir), 4)


@query(
    "status_changes",
    "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type",
)
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.changes_only(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
