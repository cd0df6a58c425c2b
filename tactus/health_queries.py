"""Registered queries of timeline checks, state and sinks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.adapters import LINES_SQL, TIMELINE_SQL, WORDS_SQL, doc_timeline, doc_words, table
from tactus.operators import health, quality, sequence, state
from tactus.queries import SPLIT_SQL, SQL, _lines, _timeline, query
from tactus.sources import cards

_SOURCES = ["char_boundary", "word_boundary", "proportional"]
_PAUSES_SQL = f"""{TIMELINE_SQL}, p AS (SELECT *, greatest(end_ms - start_ms, 0) AS dur, start_ms - lag(end_ms) OVER (PARTITION BY song_id ORDER BY line_index) AS pause,
  ['char_boundary', 'word_boundary', 'proportional'][line_index % 3 + 1] AS source FROM doc_timeline)"""


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).withColumn("source", F.element_at(F.array(*map(F.lit, _SOURCES)), F.col("line_index") % 3 + 1))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.split_metrics(doc_timeline(docs), doc_words(docs))


@query(
    "karaoke_health",
    f"""WITH {_PAUSES_SQL}, c AS (SELECT song_id, count(*) AS n, count(*) FILTER (dur < 250) AS short, count(*) FILTER (dur > 15000) AS very_long, count(*) FILTER (dur > 8000 AND dur <= 15000) AS "long",
  count(*) FILTER (pause > 5000) AS big_gaps, count(*) FILTER (pause < -10) AS crossing, (100 * count(*) FILTER (source <> 'proportional')) // count(*) AS acoustic_pct FROM p GROUP BY song_id),
s AS (SELECT *, greatest(0, 100 - least(20, 4 * short) - least(30, 15 * very_long) - least(10, 3 * "long") - least(10, 3 * big_gaps) - least(20, 5 * crossing)
  - CASE WHEN acoustic_pct < 60 THEN (60 - acoustic_pct) // 3 ELSE 0 END) AS score FROM c)
SELECT *, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 55 THEN 'FAIR' ELSE 'POOR' END AS grade FROM s""",
)
def karaoke_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.karaoke_health(_sourced(spark, sf_dir))


@query(
    "sanity_check",
    f"""WITH {_PAUSES_SQL}, c AS (SELECT song_id, min(dur) AS least, max(dur) AS most, count(*) FILTER (dur < 400) AS short, count(*) FILTER (pause < -10) AS back, count(*) FILTER (pause > 3000) AS big_gaps FROM p GROUP BY song_id)
SELECT *, short = 0 AND least > 0 AND most::DOUBLE / least::DOUBLE <= 20 AND back = 0 AND big_gaps <= 2 AS usable FROM c""",
)
def sanity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.sanity(_timeline(spark, sf_dir))


@query(
    "segment_quality",
    f"""WITH {WORDS_SQL}, {SPLIT_SQL} SELECT song_id, round(greatest(0, least(1, 1 - CASE WHEN short > 0 THEN 0.3 ELSE 0 END - CASE WHEN ratio > 8 THEN least(0.4, (ratio - 8) / 50) ELSE 0 END
  - CASE WHEN song_id % 2 = 0 THEN 0.15 ELSE 0 END - CASE WHEN wordless > 0.3 * lines THEN 0.2 ELSE 0 END))::DOUBLE, 3) AS score FROM split""",
)
def segment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("song_id") % 2 == 0, "char_weighted").otherwise("word_gap")
    return health.segment_quality(_split(spark, sf_dir), method).select("song_id", "score")


@query(
    "pathological_splits",
    f"""WITH {WORDS_SQL}, {SPLIT_SQL} SELECT song_id, CASE WHEN lines <= 1 THEN NULL WHEN least < 400 THEN 'short' WHEN most::DOUBLE / least::DOUBLE > 8 THEN 'ratio'
  WHEN sparse::DOUBLE / lines > 0.5 THEN 'sparse' END AS reason FROM split""",
)
def pathological_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.pathological(_split(spark, sf_dir)).select("song_id", "reason")


@query(
    "compare_splits",
    f"""WITH {WORDS_SQL}, {SPLIT_SQL}, k AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY line_index) - 1 AS k, count(*) OVER w AS n, min(start_ms) OVER w AS low, max(end_ms) OVER w AS high
  FROM doc_timeline WINDOW w AS (PARTITION BY song_id)),
e AS (SELECT song_id, greatest((k + 1) * (high - low) // n - k * (high - low) // n, 0) AS d FROM k),
even AS (SELECT song_id, CASE WHEN min(d) > 0 THEN round(max(d)::DOUBLE / min(d)::DOUBLE, 1) ELSE 'inf'::DOUBLE END AS ratio FROM e GROUP BY song_id)
SELECT s.song_id, s.ratio AS acoustic_ratio, e.ratio AS proportional_ratio, CASE WHEN s.ratio > greatest(2 * e.ratio, 8) THEN 'proportional_superior' ELSE 'acoustic_ok' END AS verdict
FROM split s JOIN even e ON e.song_id = s.song_id""",
)
def compare_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = doc_words(table(spark, sf_dir, "documents"))
    return health.compare_splits(_split(spark, sf_dir), quality.split_metrics(health.even_timeline(_timeline(spark, sf_dir)), words))


@query("timestamp_validity", f"""SELECT *, round(greatest(0, 1 - least(1, (backwards * 15 + negative * 20 + zero * 10 + giant * 5)::DOUBLE / (100 * lines) * 5)), 6) AS validity FROM ({SQL["timestamp_issues"]})""")
def timestamp_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.timestamp_validity(quality.timestamp_issues(_timeline(spark, sf_dir)))


@query(
    "recognition_gate",
    f"""WITH confidence AS ({SQL["confidence_report"]}), t AS (WITH {TIMELINE_SQL} SELECT * FROM doc_timeline),
wanted AS (SELECT song_id, count(*) AS lyric_lines FROM t WHERE trim(text, ' ') <> '' GROUP BY song_id),
twice AS (SELECT song_id, sum(m)::BIGINT AS segments, count(*) FILTER (m > 1) AS twice FROM (SELECT song_id, (start_ms + 50) // 100 AS b, count(*) AS m FROM t WHERE line_index % 2 = 0 OR song_id % 3 > 0 GROUP BY ALL) GROUP BY song_id),
j AS (SELECT w.song_id, coalesce(segments, 0) AS segments, lyric_lines, coalesce(twice, 0) AS twice, coverage, overall, flagged FROM wanted w LEFT JOIN twice USING (song_id) LEFT JOIN confidence c USING (song_id))
SELECT song_id, segments, lyric_lines, round(segments::DOUBLE / lyric_lines, 3) AS density, coverage, overall, round(flagged::DOUBLE / greatest(segments, 1), 3) AS flagged_ratio, round(twice::DOUBLE / greatest(segments, 1), 3) AS twice_ratio,
  concat_ws(',', CASE WHEN segments::DOUBLE / lyric_lines < 0.35 THEN 'density' END, CASE WHEN coverage < 0.25 THEN 'coverage' END, CASE WHEN overall < 0.35 THEN 'overall' END,
    CASE WHEN 10 * flagged > 4 * greatest(segments, 1) THEN 'flagged' END, CASE WHEN 10 * twice > 3 * greatest(segments, 1) THEN 'twice' END) AS reasons, reasons <> '' AS triggered FROM j""",
)
def recognition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recognition has every second line of each third song, and all of the others."""
    docs, lines = table(spark, sf_dir, "documents"), _timeline(spark, sf_dir)
    return health.recognition_gate(lines.where("line_index % 2 = 0 OR song_id % 3 > 0"), lines, quality.confidence_report(doc_words(docs), lines))


@query(
    "debug_summary",
    f"""WITH {_PAUSES_SQL}, d AS (SELECT *, abs(coalesce(pause, 0)) AS drift, line_index * 37 % 101 AS lag_ms FROM p)
SELECT song_id, count(*) AS lines, round(100.0::DOUBLE * count(*) FILTER (source = 'char_boundary') / count(*), 1) AS pct_char_boundary, round(100.0::DOUBLE * count(*) FILTER (source = 'word_boundary') / count(*), 1) AS pct_word_boundary,
  round(100.0::DOUBLE * count(*) FILTER (source = 'proportional') / count(*), 1) AS pct_proportional, round(avg(drift), 3) AS mean_drift, max(drift) AS worst_drift,
  list(line_index ORDER BY drift DESC, line_index)[1] AS worst_line, round(avg(lag_ms), 3) AS mean_lag FROM d GROUP BY song_id""",
)
def debug_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pause = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(sequence.song()), F.lit(0))
    return health.debug_summary(_sourced(spark, sf_dir).withColumns({"drift_ms": pause, "lag_ms": F.expr("line_index * 37 % 101")}), _SOURCES)


@query(
    "compression_and_cap",
    f"""WITH {_PAUSES_SQL}, r AS (SELECT song_id, line_index, (line_index % 70)::DOUBLE / 10 AS r, length(text) % 60 AS moras, (lead(start_ms) OVER (PARTITION BY song_id ORDER BY line_index) - end_ms)::DOUBLE / 1000 AS gap FROM p),
c AS (SELECT *, 4 + 0.3::DOUBLE * moras + CASE WHEN line_index % 4 = 0 THEN 1.5 ELSE 0 END + CASE WHEN gap IS NULL OR gap > 20 THEN 5 WHEN gap > 4 THEN 1 WHEN gap > 1.5 THEN 0.5 ELSE 0 END AS cap FROM r)
SELECT song_id, line_index, round(CASE WHEN r <= 1.2 THEN 0 WHEN r <= 1.8 THEN 0.35 * (r - 1.2) / 0.6 WHEN r <= 2.5 THEN 0.35 + 0.5 * (r - 1.8) / 0.7 WHEN r <= 4 THEN 0.85 + 0.08 * (r - 2.5) / 1.5
    WHEN r <= 6 THEN 0.93 + 0.04 * (r - 4) / 2 ELSE 0.97 END::DOUBLE, 6) AS strength,
  round(greatest(4, least(14, CASE WHEN line_index % 5 = 0 AND line_index % 4 <> 0 THEN least(cap, moras * 0.52::DOUBLE) ELSE cap END))::DOUBLE, 6) AS cap_s FROM c""",
)
def compression_and_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = (F.lead("start_ms").over(sequence.song()) - F.col("end_ms")) / 1000
    lines = _timeline(spark, sf_dir).withColumns({"gap": gap, "moras": F.length("text") % 60, "ratio": (F.col("line_index") % 70).cast("double") / 10})
    cap = health.adaptive_cap(F.col("moras"), F.coalesce("gap", F.lit(0.0)), F.col("gap").isNull(), F.col("line_index") % 5 == 0, F.col("line_index") % 4 == 0)
    return lines.select("song_id", "line_index", F.round(health.compression(F.col("ratio")), 6).alias("strength"), F.round(cap, 6).alias("cap_s"))


_REPEATS_SQL = f"{TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY song_id, text ORDER BY line_index) > 1 AS repeat FROM doc_timeline)"


@query(
    "repeat_runs",
    f"""WITH {_REPEATS_SQL}, k AS (SELECT *, line_index - row_number() OVER (PARTITION BY song_id ORDER BY line_index) AS run FROM r WHERE repeat)
SELECT song_id, min(line_index) AS first, max(line_index) AS last FROM k GROUP BY song_id, run""",
)
def repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.flag_runs(sequence.repeats(_timeline(spark, sf_dir)), F.col("repeat"))


@query(
    "suspect_repeats",
    f"""WITH {_REPEATS_SQL}, k AS (SELECT *, line_index - row_number() OVER (PARTITION BY song_id ORDER BY line_index) AS run FROM r WHERE repeat),
g AS (SELECT song_id, min(line_index) AS first, max(line_index) AS last, list(end_ms - start_ms ORDER BY line_index) AS d FROM k GROUP BY song_id, run HAVING count(*) >= 2)
SELECT song_id, first, last FROM g WHERE list_min(d[:-2]) < 2000 AND d[-1] > 2 * list_max(d[:-2])""",
)
def suspect_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.suspect_repeats(sequence.repeats(_timeline(spark, sf_dir)).withColumn("filled", F.lit(False)))


@query(
    "reference_durations",
    f"""WITH {TIMELINE_SQL} SELECT a.song_id, a.line_index, arg_min(b.end_ms - b.start_ms, b.line_index) AS reference_ms FROM doc_timeline a
LEFT JOIN doc_timeline b ON b.song_id = a.song_id AND b.text = a.text AND b.line_index < a.line_index AND b.end_ms - b.start_ms > 500 GROUP BY a.song_id, a.line_index""",
)
def reference_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.reference_durations(_timeline(spark, sf_dir)).select("song_id", "line_index", "reference_ms")


@query(
    "chorus_dedup",
    f"""WITH {LINES_SQL}, b AS (SELECT song_id, line_index, text || chr(10) || lead(text) OVER (PARTITION BY song_id ORDER BY line_index) AS key FROM doc_lines),
k AS (SELECT song_id, line_index, row_number() OVER (PARTITION BY song_id, key ORDER BY line_index) AS k FROM b WHERE key IS NOT NULL),
gone AS (SELECT DISTINCT song_id, unnest([line_index, line_index + 1]) AS line_index FROM k WHERE k > 1)
SELECT l.song_id, l.line_index FROM doc_lines l ANTI JOIN gone g ON g.song_id = l.song_id AND g.line_index = l.line_index""",
)
def chorus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two lines that are equal: each group keeps its first."""
    lines = _lines(spark, sf_dir)
    pair = F.concat_ws("\n", "text", F.lead("text").over(sequence.song()))
    groups = lines.withColumns({"chorus": pair, "_n": F.lead("line_index").over(sequence.song())}).where("_n is not null").select("song_id", "chorus", F.col("line_index").alias("start"))
    return health.drop_repeated_blocks(lines, groups).select("song_id", "line_index")


@query(
    "confidence_adjustment",
    f"""WITH {LINES_SQL}, c AS (SELECT song_id, count(*) AS n, avg(CASE WHEN length(text) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[aeiou]'))::DOUBLE / length(text) END) AS r FROM doc_lines GROUP BY song_id)
SELECT song_id, greatest(0.1, least(1, CASE WHEN n < 4 THEN 0.5 WHEN n < 10 THEN 0.8 ELSE 1 END * CASE WHEN round(r, 9) < 0.3 THEN 0.5 WHEN round(r, 9) < 0.6 THEN 0.75 ELSE 1 END))::DOUBLE AS factor FROM c""",
)
def confidence_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts have no Japanese letters, so vowels stand for them."""
    share = F.when(F.length("text") == 0, 0.0).otherwise(F.regexp_count("text", F.lit("[aeiou]")) / F.greatest(F.length("text"), F.lit(1)))
    songs = _lines(spark, sf_dir).groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 9).alias("r"))
    return songs.select("song_id", health.confidence_adjustment(F.col("n"), F.col("r")).alias("factor"))


@query(
    "step_progress",
    """WITH s AS (SELECT event_id, ['download', 'separate', 'transcribe', 'align'][event_id % 4 + 1] AS step, event_id % 101 AS pct FROM events)
SELECT event_id, step, (CASE step WHEN 'download' THEN 20 * pct // 100 WHEN 'separate' THEN 20 + 25 * pct // 100 WHEN 'transcribe' THEN 45 + 40 * pct // 100 ELSE 85 + 15 * pct // 100 END)::BIGINT AS done FROM s""",
)
def step_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.element_at(F.array(*[F.lit(s[0]) for s in state.STEPS]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", step.alias("step"), state.progress(step, F.col("event_id") % 101).alias("done"))


@query("lines_per_song", f"WITH {LINES_SQL} SELECT doc_id AS song_id, lang, count(line_index) AS n_lines FROM documents LEFT JOIN doc_lines ON song_id = doc_id AND doc_lines.text <> '' GROUP BY doc_id, lang")
def lines_per_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"), "lang")
    return state.counted(songs, _lines(spark, sf_dir).where("text <> ''"), "song_id", "n_lines")


@query("recent_songs", "SELECT doc_id, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 6")
def recent_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six first songs of a list: a top-k report."""
    return state.latest(table(spark, sf_dir, "documents"), 6, F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "lang")


@query("top2_matches", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 2")
def top2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best candidates of each key, of equal scores the first."""
    return state.best_per_key(table(spark, sf_dir, "events"), ["user_id"], 2, F.desc("value"), F.asc("event_id")).select("user_id", "event_id", "rank")


@query(
    "merged_timeline",
    f"""WITH {TIMELINE_SQL}, i AS (SELECT song_id, line_index, 'inserted' AS text, end_ms AS start_ms, end_ms + 500 AS end_ms FROM doc_timeline WHERE line_index % 7 = 4), u AS (SELECT song_id, line_index, text, start_ms, end_ms FROM doc_timeline UNION ALL SELECT * FROM i)
SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY start_ms, line_index, end_ms) - 1)::INT AS line_index, text, start_ms, end_ms FROM u""",
)
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _timeline(spark, sf_dir)
    inserted = lines.where("line_index % 7 = 4").selectExpr("song_id", "line_index", "'inserted' AS text", "end_ms AS start_ms", "end_ms + 500 AS end_ms")
    return state.merged_timeline(lines, inserted)


@query(
    "maximal_sets",
    """WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS items FROM events WHERE event_id % 10 < 2 GROUP BY user_id), d AS (SELECT DISTINCT items FROM s),
g AS (SELECT DISTINCT a.items FROM d a JOIN d b ON len(b.items) > len(a.items) AND list_has_all(b.items, a.items))
SELECT user_id, array_to_string(items, ',') AS items FROM s WHERE items NOT IN (SELECT items FROM g)""",
)
def maximal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose kinds of marked events (ids that end in 0 or 1) aren't a proper part of another's."""
    kinds = table(spark, sf_dir, "events").where("event_id % 10 < 2").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("items"))
    return state.maximal_sets(kinds).select("user_id", F.array_join("items", ",").alias("items"))


@query("selection_toggle", "SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.toggled(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    "ordered_distinct",
    f"""WITH {LINES_SQL}, w AS (SELECT song_id, line_index, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM doc_lines)
SELECT song_id, line_index, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w""",
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("song_id", "line_index", F.array_join(state.ordered_distinct(F.split("text", " ", -1)), " ").alias("words"))


@query(
    "song_with_lines",
    f"WITH {LINES_SQL} SELECT doc_id, count(line_index) AS n, coalesce(string_agg(l.text, '|' ORDER BY line_index), '') AS lines FROM documents d LEFT JOIN doc_lines l ON l.song_id = d.doc_id AND l.line_index % 2 = 1 GROUP BY doc_id",
)
def song_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("song_id"))
    both = state.with_children(songs, _lines(spark, sf_dir).where("line_index % 2 = 1"), "song_id", "line_index", "text")
    return both.select(F.col("song_id").alias("doc_id"), F.size("children").cast("bigint").alias("n"), F.array_join("children.text", "|").alias("lines"))


@query(
    "cache_eviction",
    """WITH e AS (SELECT user_id, min(ts) AS created_at, max(ts) FILTER (event_type = 'view') AS accessed_at FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id FROM e, n WHERE coalesce(accessed_at, created_at) < now - INTERVAL 2 DAY""",
)
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that nobody viewed for two days before the last event."""
    events = table(spark, sf_dir, "events")
    entries = events.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("accessed_at"))
    return state.evicted(entries, events.agg(F.max("ts")).scalar(), 2).select("user_id")


@query("tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Here:\\n```json\\n', props, '\\n```') WHEN 2 THEN concat('so: ', props, ' done') ELSE 'none' END")
    return table(spark, sf_dir, "events").select("event_id", state.parsed(raw, "k string")["k"].alias("k"))


@query(
    "card_csv",
    """SELECT doc_id, '"' || replace(regexp_replace(substr(text, 1, 60), '<[^>]*>', '', 'g'), '"', '""') || '","' || lang || '","' || source || ' ' || lang || '",""' AS value FROM documents""",
)
def card_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of a card is the first 60 letters of a text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("front"), F.col("lang").alias("back"), F.array("source", "lang").alias("tags"), F.lit(None).cast("string").alias("deck"))
    return cards.csv_rows(docs, "doc_id")
