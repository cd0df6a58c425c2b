"""Pairs of a song's lines: against plain versions, and in size."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus import queries
from tactus.functions import similarity
from tactus.operators import align, line_pairs

SF = "/root/testdata/sf0.001"


def some_texts(n=40, letters="aab é語", seed=2):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 9, 70, 130]))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_match_of_long_lines(spark):
    """Packed distances and common pairs are the plain ones; a song of long lines takes seconds."""
    texts = some_texts()
    want = [[round((1 - align.edit_similarity(a, b)) * max(len(a), len(b))) for b in texts] for a in texts]
    assert line_pairs.edit_distances(texts, texts).tolist() == want
    grams = line_pairs.Grams(texts)
    got = np.vstack([line_pairs.dice(c, grams.sizes[k : k + len(c)], grams.sizes) for k, c in grams.common()])
    apart = ~np.eye(len(texts), dtype=bool)
    assert (got == [[align.bigram_dice(a, b) for b in texts] for a in texts])[apart].all()
    draw = random.Random(4)
    long = [(1, k, "".join(draw.choice("abcdefgh") for _ in range(6000))) for k in range(12)]
    official = spark.createDataFrame(long, "song_id long, line_index int, form string")
    transcript = official.selectExpr("song_id", "line_index AS seg_index", "form", "bigint(0) AS start_ms", "bigint(1) AS end_ms")
    began = time.time()
    assert [r.similarity for r in align.match(official, transcript).collect()] == [1.0] * 12
    assert time.time() - began < 15


def test_similar_diagonals_exchange_lines_only(spark):
    """Neither letter pairs nor pairs of lines are joined or exploded, and runs end at a song's gaps."""
    assert "Join" not in (found := plan(queries.QUERIES["similar_diagonals"](spark, SF))) and found.count("Generate") == 1
    some = [(1, k, t) for k, t in [(0, "abcd"), (1, "efgh"), (2, "abcd"), (3, "efgh"), (5, "abcd"), (6, "efgh")]]
    lines = spark.createDataFrame(some, "song_id long, line_index int, text string")
    assert sorted(map(tuple, line_pairs.similar_runs(lines, 0.78, 2).collect())) == [(1, 2, 0, 2), (1, 3, 2, 2), (1, 5, 0, 2)]


def test_song_bigram_dice_exchanges_lines_only(spark, monkeypatch):
    """The pairs are made within a song's task; blocks and batches of any size give the same."""
    assert "Join" not in (found := plan(queries.QUERIES["song_bigram_dice"](spark, SF))) and found.count("Generate") == 1
    texts = some_texts()
    want = {(i, j): align.bigram_dice(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j}
    lines = spark.createDataFrame(list(enumerate(texts)), "line_index int, text string").withColumn("song_id", F.lit(7))
    got = line_pairs.gram_pairs(lines).select("i", "j", line_pairs.dice_of(F.col("common"), F.col("total")).alias("d")).collect()
    assert len(got) == len(want) and all(r.d == pytest.approx(want[r.i, r.j]) for r in got)
    grams = line_pairs.Grams(texts)
    whole = np.vstack([c for _, c in grams.common()])
    monkeypatch.setattr(line_pairs, "CELLS", 300)
    assert (np.vstack([c for _, c in grams.common()]) == whole).all()


def test_bigram_similarity_of_long_lines(spark):
    """Linear in the lines' length: 40,000 letters of many kinds take seconds."""
    draw = random.Random(6)
    a, b = ("".join(chr(draw.randrange(0x4E00, 0x4F00)) for _ in range(40_000)) for _ in range(2))
    began = time.time()
    df = spark.createDataFrame([(a, b), (None, b), ("x", "x"), ("x", ""), ("ab", "ba")], "a string, b string")
    got = [r.d for r in df.select(similarity.bigram_sim(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [align.bigram_dice(a, b), None, 1.0, 0.0, 0.0] and time.time() - began < 15


def test_edit_similarity_of_long_lines(spark, monkeypatch):
    """All pairs of a song's lines; a dozen lines of 12,000 letters take seconds."""
    texts = [*some_texts(30), None, None]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_index int, text string").withColumn("song_id", F.lit(7).cast("long"))
    sim = F.round(line_pairs.lev_sim_of(F.col("distance"), F.col("longer")), 6)
    got = {(r.i, r.j): r.s for r in line_pairs.distance_pairs(lines).select("i", "j", sim.alias("s")).collect()}
    plain = lambda a, b: None if a is None or b is None else round(align.edit_similarity(a, b), 6)
    assert got == {(i, j): plain(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j}
    draw = random.Random(8)
    long = [(1, k, "".join(draw.choice("abcdefgh") for _ in range(12_000))) for k in range(12)]
    began = time.time()
    assert line_pairs.distance_pairs(spark.createDataFrame(long, "song_id long, line_index int, text string")).count() == 66
    assert time.time() - began < 25


def test_bigram_dice_of_all_lines(spark, tmp_path, monkeypatch):
    """Every line of the documents meets every line of the benchmark, whatever its first letters and length, as in its SQL; blocks of any size give the same."""
    texts, bench = some_texts(30), some_texts(20, seed=3)
    docs = [(k, "\n".join(texts[3 * k : 3 * k + 3])) for k in range(10)] + [(10, None), (11, ""), (12, "x" + bench[4])]
    items = [(k, "\n".join(bench[2 * k : 2 * k + 2])) for k in range(10)] + [(10, None), (11, "a")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lines = [(d, i, x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    want = sorted((d, i, b, align.bigram_dice(x, y)) for d, i, x in lines for b, t in items if t is not None for y in t.split("\n"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")

    def found():
        return sorted(map(tuple, queries.QUERIES["bigram_dice"](spark, str(tmp_path)).collect()))

    got = found()
    assert got == sorted(con.execute(queries.SQL["bigram_dice"]).fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-6)
    monkeypatch.setattr(line_pairs, "BLOCK_BYTES", 200)
    assert found() == got
    monkeypatch.setattr(line_pairs, "CELLS", 300)
    groups = list(line_pairs._grouped(list(enumerate(bench))))
    assert len(groups) > 2 and [k for keys, _ in groups for k in keys] == list(range(20))
    assert (np.hstack([g.dice(texts) for _, g in groups]) == line_pairs.Others(bench).dice(texts)).all()


def test_bigram_dice_exchanges_nothing(spark):
    assert "Join" not in (found := plan(queries.QUERIES["bigram_dice"](spark, SF))) and "Exchange" not in found
