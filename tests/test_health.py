"""Timeline checks, state, Japanese columns and sinks: queries against their SQL, and worked examples."""

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tactus import health_queries, queries
from tactus.functions import japanese
from tactus.operators import align, health, quality, relations, sequence, state
from tactus.sources import artifacts, cards
from tactus.streaming import sync

SF = "/root/testdata/sf0.001"
MENDED = ["split_metrics", "bridge_gaps", "extend_to_next", "boundary_audit", "drift_curve"]
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == health_queries.__name__] + MENDED
TIMED = "song_id long, line_index int, text string, start_ms long, end_ms long"


@pytest.mark.parametrize("name", NAMES)
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)

    def rounded(rows):
        return sorted([tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows], key=repr)

    assert rounded(df.select(*names).collect()) == rounded(found.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_japanese(spark):
    assert one(spark, japanese.align_furigana(F.lit("始めて"), F.lit("はじめて"))) == "始(はじ)めて"
    assert one(spark, japanese.align_furigana(F.lit("夢"), F.lit("ゆめ"))) == "夢(ゆめ)"
    assert one(spark, japanese.align_furigana(F.lit("かな"), F.lit("かな"))) is None
    assert one(spark, japanese.align_furigana(F.lit("x"), F.lit("えっくす"))) is None
    assert one(spark, japanese.furigana(F.lit("食べる"), F.lit("タベル"))) == "食(た)べる"
    assert one(spark, japanese.furigana(F.lit("食べる"), F.lit(""))) is None
    assert one(spark, japanese.ruby(F.lit(""), F.lit("漢字(かんじ)"), F.lit("x"))) == "<ruby>漢字<rt>かんじ</rt></ruby>"
    assert one(spark, japanese.ruby(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    assert [one(spark, japanese.looks_like_reading(F.lit(x))) for x in ("かな カナー", "漢", "", None)] == [True, False, False, False]
    assert one(spark, japanese.japanese_runs(F.lit("a夢をb見る"))) == ["夢を", "見る"]
    assert [one(spark, japanese.vowel_tail(F.lit(x))) for x in ("ああ！ ", "よー", "する", "", "...")] == [True, True, False, False, False]
    assert one(spark, japanese.ends_held(F.lit("する！"))) is True
    assert one(spark, japanese.soft(F.lit(" a \t b\n"))) == "a b"


def test_lyrics_block(spark):
    verse = "夢を見る\n空を飛ぶ\n君と歩く\n明日へ"
    credit = "作曲: 誰か\n編曲: 彼\n監督: 君\n撮影: 僕"
    assert one(spark, japanese.lyrics_block(F.lit(f"hello\n\n{credit}\n\n{verse}\n\nbye"))) == verse
    assert one(spark, japanese.lyrics_block(F.lit(f"intro\nLyrics:\n{verse}\nCredits:\nx"))) == verse
    assert one(spark, japanese.lyrics_block(F.lit("nothing here"))) is None
    assert one(spark, japanese.lyrics_block(F.lit(None).cast("string"))) is None


def test_state(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["b", "a", "a"]), (4, []), (5, ["c"])], "id int, items array<string>")
    assert sorted(r.id for r in state.maximal_sets(sets).collect()) == [1, 3, 5]
    assert [r.id for r in state.maximal_sets(sets.where("id = 4")).collect()] == [4]
    raws = ['{"k": "1"}', 'x ```json\n{"k": "2"}\n``` y', 'so {"k": "3"} then', "none", "", None, '{"k": ']
    got = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", state.parsed(F.col("raw"), "k string")["k"].alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == ["1", "2", "3", None, None, None, None]
    assert [one(spark, state.progress(F.lit(s), F.lit(p))) for s, p in (("download", 50), ("align", 100), ("separate", 33), ("other", 1))] == [10, 100, 28, None]
    now = datetime.datetime(2024, 3, 1)
    entries = [("a", now - datetime.timedelta(31), None), ("b", now - datetime.timedelta(99), now), ("c", None, None), ("d", now - datetime.timedelta(30), None)]
    kept = state.evicted(spark.createDataFrame(entries, "key string, created_at timestamp, accessed_at timestamp"), F.lit(now))
    assert [r.key for r in kept.collect()] == ["a"]


def test_empty_tables(spark):
    none, words = spark.createDataFrame([], TIMED), spark.createDataFrame([], "song_id long, line_index int, start_ms long, end_ms long, score double")
    for df in (health.karaoke_health(none.withColumn("source", F.lit("x"))), health.sanity(none), quality.split_metrics(none, words), quality.confidence_report(words, none), relations.boundary_audit(none)):
        assert df.collect() == []
    line = spark.createDataFrame([(1, 0, "a", 0, 900)], TIMED)
    r = quality.confidence_report(words, line).first()  # a song without words
    assert (r.coverage, r.mean_score, r.overall) == (0, 0, 0)
    assert quality.split_metrics(line, words).first().wordless == 1


def test_mended_operators(spark):
    lines = spark.createDataFrame([(1, 0, "a", 0, 3000), (1, 1, "b", 2000, 4000), (1, 2, "c", 5220, 6000), (1, 3, "d", 6300, 7000)], TIMED)
    assert [r.end_ms for r in sequence.extend_to_next(lines).orderBy("line_index").collect()] == [3000, 5170, 6250, 7000]
    words = spark.createDataFrame([(1, 5000, 5100)], "song_id long, start_ms long, end_ms long")
    for segs, want in (([0, 0, 0, 0], [0, 2000, 4000, 6000]), ([0, 1, 2, 3], [0, 2000, 5220, 6000]), ([0, 1, 3, 5], [0, 2000, 5220, 6300])):
        at = lines.withColumn("transcript_index", F.element_at(F.array(*map(F.lit, segs)), F.col("line_index") + 1))
        assert [r.start_ms for r in sequence.bridge_gaps(at, words).orderBy("line_index").collect()] == want
    audit = relations.boundary_audit(lines).first()
    assert (audit.n_back, audit.n_gap, audit.odd, audit.first_drift) == (1, 0, 1, 1)
    assert align.assign_groups(align.np.array([[0.0, 0.0]])) == [1]


def test_sessions_follow_the_line(spark):
    session = sync.Session()
    tick = lambda now, played, start, kind="tick", confidence=0.9: session.step({"kind": kind, "now_ms": now, "playback": played, "line_start": start, "confidence": confidence})
    assert tick(9000, 10.0, 9.0)["correction"] == pytest.approx(0.15)
    assert tick(17000, 20.0, 19.0)["correction"] == 0  # 8000 ms aren't more than 8000 ms
    assert tick(17001, 20.0, 19.0)["drift"] == pytest.approx(0.85)  # the offset counts
    assert tick(18000, 30.0, 20.0, "manual_anchor", None)["correction"] == pytest.approx(10 - 0.15 - 0.1275)  # hard
    small = tick(27000, session.offset + 5.01, 5.0)
    assert small["correction"] == 0 and session.last_anchor_ms == 27000
    assert not small["reliable"] and tick(28000, 1.0, 1.0, "seek")["reliable"]


def test_artifacts_and_cards(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "b", 1000, 2000), (1, 0, "a", 0, 900), (2, 0, None, 5, 6)], TIMED)
    now = F.lit(datetime.datetime(2024, 1, 1))
    artifacts.write(artifacts.line_documents(lines, "dtw", now), str(tmp_path / "store"), "canonical")
    back = artifacts.read(spark, str(tmp_path / "store"), "canonical", artifacts.LINES)
    assert sorted(map(tuple, artifacts.lines_of(back).collect()), key=repr) == sorted(map(tuple, lines.collect()), key=repr)
    assert [(r.lineCount, r.source) for r in back.orderBy("song_id").collect()] == [(2, "dtw"), (1, "dtw")]
    assert artifacts.legacy(back).where("text = 'b'").first().startTime == 1.0
    segments = spark.createDataFrame([(1, 2.0, 3.0, "y"), (1, 0.0, 1.0, "x")], "song_id long, start double, end double, text string")
    assert [s.text for s in artifacts.transcript_documents(segments, "asr", now).first().segments] == ["x", "y"]
    some = spark.createDataFrame([(1, "N", "D", 'a "q"', "<b>x</b>", ["t u"], None), (2, "N", None, None, "", None, "g")], "key int, note_type string, deck string, front string, back string, tags array<string>, guid string")
    assert [r.value for r in cards.csv_rows(some, "key").orderBy("key").collect()] == ['"a ""q""","x","t u","D"', '"","","",""']
    decks = {r.deck: json.loads(r.json) for r in cards.json_decks(some).collect()}
    assert decks["D"]["count"] == 1 and decks["Japanese Lyrics"]["cards"][0]["tags"] == []
    cards.write_tsv(some, str(tmp_path / "deck"))
    assert spark.read.text(str(tmp_path / "deck/_header/*.txt")).first().value == "#separator:tab"
