"""Operators on timed text: worked examples, and queries against their SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus import queries
from tactus.functions import similarity, text
from tactus.operators import align, folds, sequence
from tactus.plans import selection
from tactus.sources import captions, cards
from tactus.streaming import sync

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_examples(spark):
    assert one(spark, text.match_form(F.lit("ガガガガ、ー！ABC"))) == "ががabc"
    assert one(spark, text.match_form(F.lit("ｶﾞ ﾊﾟ"), compose=True)) == "がぱ"
    assert one(spark, text.normalize_line(F.lit(" [00:30] 愛して　　る（サビ） "))) == "愛して る"
    assert one(spark, text.mora_count(F.lit("きょう、愛って"))) == 2 + 2 + 2
    assert one(spark, text.pitch_mora_count(F.lit("きょうって"))) == 3
    assert one(spark, text.furigana_to_ruby(F.lit("漢字(かんじ)だ"))) == "<ruby>漢字<rt>かんじ</rt></ruby>だ"
    assert one(spark, text.youtube_id(F.lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk"
    assert one(spark, text.vtt_seconds(F.lit("01:02:03.500"))) == 3723.5
    assert one(spark, text.vtt_seconds(F.lit("x"))) == 0.0
    assert one(spark, text.japanese_ratio(F.lit("あa"))) == 0.5
    for line, noise in (("", True), ("----", True), ("[Chorus]", True), ("by", True), ("ああ", False), ("hello", False)):
        assert one(spark, text.is_noise(F.lit(line))) is noise


def test_similarities_follow_plain_ones(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcé", k=rng.randint(0, 9))), "".join(rng.choices("abcé", k=rng.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", similarity.lev_sim(F.col("a"), F.col("b")).alias("l"), similarity.bigram_sim(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r.l == pytest.approx(align.edit_similarity(r.a, r.b))
        assert r.d == pytest.approx(align.bigram_dice(r.a, r.b))


def test_gap_classes_at_their_limits(spark):
    got = [r.x for r in spark.createDataFrame([(1500,), (1501,), (4000,), (4001,), (-5,)], "g int").select(sequence.gap_class(F.col("g")).alias("x")).collect()]
    assert got == ["CONT", "SOFT", "SOFT", "STRONG", "CONT"]


def plain_finalize(lines):
    lines = sorted([list(x) for x in lines])
    for k, line in enumerate(lines):
        line[2] = max(line[2], line[0] + 1200)
        if k + 1 < len(lines) and line[2] > lines[k + 1][0]:
            if line[2] - lines[k + 1][0] <= 500:
                lines[k + 1][0] = line[2]
            else:
                line[2] = max(lines[k + 1][0], line[0] + 1200)
                lines[k + 1][0] = max(lines[k + 1][0], line[2])
    return [(i, s, e) for s, i, e in lines]


def test_finalize_follows_a_plain_loop(spark):
    rng = random.Random(2)
    rows = []
    for song in range(30):
        at = 0
        for i in range(rng.randint(1, 12)):
            at += rng.choice([0, 300, 500, 800, 1300, 3000])
            rows.append((song, i, at, at + rng.choice([100, 1200, 1700, 1701, 2500])))
    got = folds.finalize(spark.createDataFrame(rows, "song_id long, line_index int, start_ms long, end_ms long")).collect()
    for song in range(30):
        want = plain_finalize([(s, i, e) for g, i, s, e in rows if g == song])
        mine = sorted((r.line_index, r.start_ms, r.end_ms) for r in got if r.song_id == song)
        assert mine == sorted(want)
        inside = sorted(mine, key=lambda x: (x[1], x[0]))
        assert all(a[2] <= b[1] for a, b in zip(inside, inside[1:], strict=False))


def test_dtw_ties_and_groups():
    assert align.dtw(np.zeros((2, 2))) == [(0, 0), (1, 1)]
    assert align.cheapest_on_path([(0, 0), (0, 1), (1, 1)], np.array([[0.5, 0.5], [1, 0]])) == [0, 1]
    assert align.assign_groups(np.array([[1, 0], [1, 0], [0, 1.0]])) == [0, 0, 1]
    alike = np.zeros((7, 7), bool)
    alike[0, 4] = alike[1, 5] = True
    assert align.choruses(alike) == [range(0, 2)]
    alike[2, 6] = True  # a run that ends with the diagonal doesn't count
    assert align.choruses(alike) == []


def test_match_and_stats(spark):
    words = ["aaaa bbbb", "cccc dddd", "eeee ffff"]
    official = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "song_id long, line_index int, form string")
    transcript = spark.createDataFrame([(1, i, w, 1000 * i, 1000 * i + 900) for i, w in enumerate(words)], "song_id long, seg_index int, form string, start_ms long, end_ms long")
    scored = sequence.match_scores(align.match(official, transcript))
    assert [r.transcript_index for r in scored.orderBy("line_index").collect()] == [0, 1, 2]
    stats = align.match_stats(scored).first()
    assert (stats.anchors, stats.unmatched, stats.flagged) == (3, 0, []) and stats.avg_confidence == 0.955


def test_captions(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<b>hello</b> there\n\n00:00:02.000 --> 00:00:03.500\nhello there\n\nNOTE x\n\n00:00:04.000 --> 00:00:05.000\nby"
    got = captions.webvtt(spark.createDataFrame([(1, vtt)], "song_id long, text string")).collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("hello there", 1000, 3500)]
    data = '{"events":[{"tStartMs":10,"dDurationMs":5,"segs":[{"utf8":"hi "},{"utf8":"you"}]},{"tStartMs":20,"segs":[]},{"tStartMs":30,"dDurationMs":5,"segs":[{"utf8":"more"}]}]}'
    got = captions.json3(spark.createDataFrame([(1, data)], "song_id long, text string")).orderBy("start_ms").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("hi you", 10, 15), ("more", 30, 35)]


def test_cards(spark):
    df = spark.createDataFrame([("Basic", "d", "a\tb", "x\ny", ["t 1", "u"])], "note_type string, deck string, front string, back string, tags array<string>")
    assert cards.tsv_rows(df).first().value == "Basic\td\ta    b\tx<br>y\tt_1 u"
    assert one(spark, cards.checksum(F.lit("<b>a</b>"))) == int("86f7e437", 16)


def test_selection_ladder(spark):
    base = {"method": "whisperx", "acoustic_lines": 9, "dtw_lines": 9, "similarity": 0.9, "confidence": 0.9, "drift_ms": 0, "zero": 0, "backwards": 0, "clean_after_repair": True, "acoustic": 0.5, "dtw": 0.6}
    cases = [
        ({}, "dtw_score", "dtw"), ({"dtw": 0.5}, "acoustic_score", "acoustic"), ({"acoustic_lines": 0}, "only_dtw", "dtw"), ({"dtw_lines": 0}, "no_dtw", "acoustic"),
        ({"similarity": 0.49}, "low_similarity", "acoustic"), ({"confidence": 0.47}, "low_confidence", "acoustic"), ({"method": "even", "similarity": 0.3, "drift_ms": 10001}, "drift", "acoustic"),
        ({"zero": 1}, "zero_times", "acoustic"), ({"backwards": 3}, "repaired", "dtw"), ({"backwards": 4}, "backwards", "acoustic"),
    ]
    rows = [tuple((base | c | {"id": k}).values()) for k, (c, _, _) in enumerate(cases)]
    got = selection.choose(spark.createDataFrame(rows, [*base, "id"])).orderBy("id").collect()
    assert [(r.rung, r.source) for r in got] == [(a, b) for _, a, b in cases]


def test_providers_and_stages(spark):
    attempts = spark.createDataFrame([(1, 2, "b", True, 0.8), (1, 1, "a", False, 0.0), (1, 3, "c", True, 0.9), (2, 1, "a", False, 0.0)], "song_id long, priority int, provider string, success boolean, confidence double")
    got = {r.song_id: (r.provider, r.failed) for r in selection.provider_chain(attempts).collect()}
    assert got == {1: ("b", ["a"]), 2: ("none", ["a"])}
    manifest = spark.createDataFrame([(1, "x", "25", "t"), (1, "y", "24", "t"), (1, "z", "25", "t")], "song_id long, stage string, version string, completed_at string")
    assert sorted(r.stage for r in selection.stages_to_run(manifest, ["x", "y", "z"], "25").collect()) == ["y", "z"]


def test_sessions_in_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, 3000 * k, rng.choice(["tick", "tick", "seek", "manual_anchor"]), rng.uniform(-4, 4), rng.random()) for s in range(4) for k in range(12)]
    schema = "session_id long, now_ms long, kind string, drift double, confidence double"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, sync.batch(df).collect()))
    for part, (low, high) in enumerate(((0, 15000), (15000, 10**9))):
        df.where(f"now_ms >= {low} and now_ms < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = sync.stream(live).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sessions").collect())) == want


@pytest.mark.parametrize("name", ["timeline_grade", "repair_monotone", "asof_active_line", "confidence_report", "match_scores", "merge_short_lines"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)

    def rounded(rows):
        return sorted([tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows], key=repr)

    assert rounded(df.select(*names).collect()) == rounded(found.fetchall())


def test_pairs_of_a_song_need_no_common_prefix(spark):
    """The pair queries compare all lines of a song; multisets as sets give the same Dice."""
    some = [(1, 0, "abababx"), (1, 1, "xabab"), (1, 2, "zz"), (1, 3, "z"), (1, 4, "z"), (1, 5, ""), (1, 6, None), (2, 0, "abababx")]
    lines = spark.createDataFrame(some, "song_id long, line_index int, text string")
    grams = sequence.song_pairs(sequence.numbered_bigrams(lines), "grams")
    got = {(r.i, r.j): r.d for r in grams.select("i", "j", sequence.grams_dice(F.col("a_grams"), F.col("b_grams")).alias("d")).collect()}
    texts = sequence.song_pairs(lines.where("text is not null"), "text").select("i", "j", similarity.bigram_sim(F.col("a_text"), F.col("b_text")).alias("d"))
    assert len(got) == 21 and all(got[r.i, r.j] == pytest.approx(r.d) for r in texts.collect())
    assert got[0, 1] == pytest.approx(0.6) and got[3, 4] == 1
    sizes = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("size(split(text, '\n', -1)) n").where("n > 0")
    want = sizes.selectExpr("sum(n * (n - 1) div 2) w").first().w
    for name in ("lev_sim", "song_bigram_dice", "song_recall_sim"):
        df = queries.QUERIES[name](spark, SF)
        assert df.count() == want and df.columns[:4] == ["song_id", "i", "j", "similarity"]


def test_similar_diagonals(spark, tmp_path):
    """A chorus whose lines differ by a letter is a run, a single repeated line is none; against plain loops."""
    song = ["we sing along the road", "until the night is over", "a verse", "we sing along the roads", "until the night is over!", "another one", "a verse"]
    draw = random.Random(5)
    other = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 4))) for _ in range(40)]
    texts = {1: song, 2: other}
    spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def dice(a, b):
        if not a or not b:
            return 0.0
        if min(len(a), len(b)) < 2:
            return float(a == b)
        x, y = ([t[i : i + 2] for i in range(len(t) - 1)] for t in (a, b))
        return 2 * sum(min(x.count(g), y.count(g)) for g in set(x)) / (len(x) + len(y))

    want = set()
    for k, t in texts.items():
        for off in range(2, len(t)):
            hits = [dice(t[i], t[i + off]) >= 0.78 for i in range(len(t) - off)] + [False]
            start = None
            for i, hit in enumerate(hits):
                if hit and start is None:
                    start = i
                if not hit and start is not None:
                    if i - start >= 2:
                        want.add((k, off, start, i - start))
                    start = None
    got = {(r.song_id, r.offset, r.first, r["size"]) for r in queries.QUERIES["similar_diagonals"](spark, str(tmp_path)).collect()}
    assert (1, 3, 0, 2) in got and {x for x in got if x[0] == 1} == {(1, 3, 0, 2)} and got == want
