"""Pages whose mark-up is deep or whose class names mislead, and groups that hubs leave open."""

import random
import time

from pyspark.sql import functions as F

from tactus.llm import html_text, lines, linking, neardup

DOCS = "doc_id long, text string"


def test_names_inside_an_article():
    part = "<p>Earlier work by others is long and interesting, as told here in full.</p>"
    page = f'<article><h1>T</h1><p>A long paragraph of an article that says a lot.</p><div class="%s">{part}</div></article>'
    for name in ("related-work", "alert-history", "plain"):  # names with a word of another kind: the ratio decides
        assert "Earlier work" in html_text.main_text(page % name)
    for name in ("related", "share-buttons", "newsletterSignup box"):
        assert "Earlier work" not in html_text.main_text(page % name)
    assert "Earlier work" not in html_text.main_text((page % "related-work").replace("article", "div"))
    few = '<article><p>A long paragraph of an article that says a lot, and more.</p><p>Another long paragraph of the article.</p><p class="share-now"><a>a</a> <a>b</a> <a>c</a></p></article>'
    assert "a b c" not in html_text.main_text(few)


def test_deep_mark_up_takes_linear_time():
    began = time.time()
    for page in ("<div>" * 20_000 + "x", "<div>" * 20_000 + "</b>" * 20_000 + "x", "<p>" + "<figure>" * 20_000 + "x"):
        assert html_text.main_text(page) == "x"
    assert time.time() - began < 20


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "<p>a</p>", "x", "y")], "page_id long, url string, html string, text string, n_chars string")
    r = html_text.extract(df).first()
    assert (r.text, r.n_chars, r.page_id) == ("a", 1, 1)


def test_a_large_group_of_near_copies(spark):
    """Copies with many independent edits: hubs leave many open; against all pairs."""
    draw = random.Random(11)
    words = ["w%d" % i for i in range(5000)]
    base = draw.choices(words, k=150)
    docs = []
    for k in range(400):
        t = list(base)
        for _ in range(draw.randint(0, 22)):
            t[draw.randrange(150)] = draw.choice(words)
        docs.append((k, " ".join(t)))
    sets = [frozenset(zip(t.split(), t.split()[1:])) for _, t in docs]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(400):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {k: find(k) for k in range(400)}
    assert 10 < len(set(want.values())) < 390
    got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(docs, DOCS), size=2).collect()}
    assert got == want


def test_repeats_of_short_lines(spark):
    some = [(1, "Chapter 1\nyes"), (2, "Chapter 2\n Yes \n\n"), (3, "chapter 1"), (4, None)]
    frame = spark.createDataFrame(some, DOCS)
    assert {r.doc_id: tuple(r.removed or ()) for r in lines.dedup(frame, short=True).collect()} == {1: (), 2: (1,), 3: (0,), 4: ()}
    odd = frame.select("*", *[F.lit("x").alias(c) for c in ("_d", "_v", "_t", "n_lines")])
    cleaned = lines.clean(odd, short=True)
    assert {r.doc_id: r.text for r in cleaned.collect()} == {1: some[0][1], 2: "Chapter 2\n\n", 4: None} and cleaned.columns == odd.columns


def test_common_word_pairs_bring_few_lines_together(spark):
    """Unrelated lines that share common word pairs meet in few bands; near copies, and lines of common pairs only, still meet."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(draw.randint(4, 8)))
    usual = ["of the", "to the", "in a"]
    texts = [" ".join(draw.choice(usual) if draw.random() < 0.6 else word() for _ in range(16)) for _ in range(400)]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts[:20]] + ["of the of the to the to the", "to the of the of the to the"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "h long, norm string")
    signed = [tuple(r)[2:] for r in lines._signed(frame, lines._common(frame)).orderBy("h").collect()]
    plain = [tuple(r)[2:] for r in lines._signed(frame, lines._common(frame).limit(0)).orderBy("h").collect()]
    meet = lambda a, b: any(all(a[m] == b[m] for m in picks) for picks in lines._PICKS)
    met = lambda of: sum(meet(of[a], of[b]) for a in range(400) for b in range(a))
    assert 5 * met(signed) < met(plain)
    assert sum(meet(signed[k], signed[400 + k]) for k in range(20)) >= 19 and meet(signed[420], signed[421])


def test_lines_are_apart_only_when_whole_lines_are(spark):
    """What beginnings and ends show never contradicts the edit distance of whole lines."""
    draw = random.Random(8)
    some = []
    for _ in range(400):
        a = "".join(draw.choice("abcd é漢") for _ in range(draw.randint(1, 60)))
        b = list(a)
        for _ in range(draw.randint(0, 1 + len(a) // 3)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 3)] = draw.choice(["", "x", "ab", "dda"])
        some.append((a, "".join(b)))
    frame = spark.createDataFrame(some, "x string, y string")
    whole = F.levenshtein("x", "y") <= F.floor(F.greatest(F.length("x"), F.length("y")) * (100 - lines.PERCENT) / 100)
    got = frame.select(whole.alias("want"), *[lines._similar(F.col("x"), F.col("y"), likely=k).alias(f"k{k}") for k in (True, False)]).collect()
    assert [(r.want, r.want) for r in got] == [(r.kTrue, r.kFalse) for r in got] and 50 < sum(r.want for r in got) < 350


def test_lines_are_stored_in_rounds(spark, monkeypatch):
    """No step collapses, signs or deals all lines at once; each part of the lines is deleted when it is collapsed."""
    from pathlib import Path

    from tactus.llm.common import Scratch

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(draw.randint(3, 7)))
    texts = [" ".join(word() for _ in range(12)) for _ in range(300)]
    frame = spark.createDataFrame([(k, f"{t}\n{t.upper()}!\n{t[:-3]}") for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    sizes, left, keep = {}, [], Scratch.keep

    def noted(self, df, name, *args, **more):
        out = keep(self, df, name, *args, **more)
        sizes.setdefault(name, []).append(out.count())
        if name == "lines":
            self.first = out.stored_at
        if name == "distinct":
            left.append(len(list(Path(self.first).glob("*/*.parquet"))))
        return out

    monkeypatch.setattr(Scratch, "keep", noted)
    gone = lines.removed_lines(frame)
    assert {r.doc_id: tuple(r.removed) for r in gone.collect()} == {k: (1, 2) for k in range(300)}
    for name in ("distinct", "signatures"):
        assert sum(sizes[name]) == 600 and max(sizes[name]) < 200
    assert max(sizes["buckets"]) < sum(sizes["buckets"]) / 4
    assert left == sorted(left, reverse=True) and left[-1] < left[0] / 3
    folder = Path(gone.stored_at).parent
    assert not [x for name in sizes if name != "gone" for x in folder.glob(f"{name}-*/**/*.parquet")]


def test_anchors_bound_the_distance_of_lines(spark):
    """Pieces between anchors give no less than the distance, and nearly that, where text is put in, left out or repeated."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgé漢") for _ in range(draw.randint(2, 7)))
    some = []
    for k in range(60):
        words = [word() for _ in range(draw.choice([4, 40, 300]))]
        if k % 3 == 0:
            words[1:1] = ["la"] * 60
        other = list(words)
        for _ in range(len(words) // 30):
            at = draw.randrange(len(other) + 1)
            other[at : at + draw.randint(0, 2)] = draw.choice([[], [word()], [word(), word()]])
        if k % 2:
            other[2:2] = [word() for _ in range(len(words) // 30)]
        if k % 5 == 0:
            other = [word() for _ in other]
        some.append((k, " ".join(words), " ".join(other)))
    frame = spark.createDataFrame(some, "k long, x string, y string").repartition(2)
    longer = F.greatest(F.length("x"), F.length("y"))
    most = F.floor(longer * (100 - lines.PERCENT) / 100).cast("int")
    got = frame.select("k", F.levenshtein("x", "y").alias("whole"), most.alias("most"), lines._anchored(F.col("x"), F.col("y"), most).alias("bound")).collect()
    assert all(r.bound >= min(r.whole, r.most + 1) for r in got)
    near = [r for r in got if r.k % 5 and r.whole <= r.most / 2]
    assert len(near) > 35 and 10 * sum(r.bound <= r.most for r in near) >= 9 * len(near)


def test_runs_of_words_bound_the_distance_of_lines(spark):
    """Lines of long runs, of which some are put in, left out or replaced, are told apart from others without comparing them whole."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 7)))
    some = []
    for k in range(60):
        runs = [(word(), draw.choice([1, 1, 20, 40])) for _ in range(draw.randint(8, 16))] if k % 4 else [(word(), 1) for _ in range(4)]
        other = list(runs)
        at = draw.randrange(len(runs))
        other[at : at + draw.randint(0, 1)] = draw.choice([[], [(word(), other[at][1])], [(word(), 1), other[at]]])
        if k % 5 == 0:
            other = [(word(), n) for _, n in runs]
        some.append((k, *[" ".join(w for w, n in x for _ in range(n)) for x in (runs, other)]))
    frame = spark.createDataFrame(some, "k long, x string, y string").repartition(2)
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * (100 - lines.PERCENT) / 100).cast("int")
    m = lines._middles(F.col("x"), F.col("y"))
    got = frame.select("k", F.levenshtein("x", "y").alias("whole"), most.alias("most"), lines._worded(F.col("x"), F.col("y"), most).alias("bound"), F.levenshtein(m["x"], m["y"]).alias("middles"), F.length(m["x"]).alias("left"), F.length("x").alias("all")).collect()
    assert all(r.bound >= min(r.whole, r.most + 1) and r.middles == r.whole for r in got)
    near = [r for r in got if r.k % 5 and r.whole <= r.most / 2]
    assert len(near) > 20 and 10 * sum(r.bound <= r.most for r in near) >= 9 * len(near)
    assert 2 * sum(r.left for r in near) < sum(r.all for r in near)


def test_blocks_name_the_largest_component(spark):
    """So that two lines outside it can be compared once, not from either side."""
    source = spark.createDataFrame([(1, k, 10, c) for k, c in ((1, 1), (2, 1), (3, 1), (4, 4), (5, 5))] + [(2, 6, 10, 6), (2, 7, 10, 6)], "k long, id long, size int, c long")
    got = linking.blocks(source, 1 << 17).collect()
    assert {(r.k, r.major) for r in got} == {(1, 1)} and {r.id for r in got if r.minor} == {4, 5} and len(got) == 7


def test_scripts_without_spaces_begin_at_thai(spark):
    below = spark.range(0x80, 0xE00).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("letter"))
    assert below.where(F.col("letter").rlike(lines.UNSPACED)).count() == 0
    letters = spark.createDataFrame([(c,) for c in "ก漢ひカກកက々𠀀"], "letter string")
    seen = letters.where(F.col("letter").rlike(lines.UNSPACED))
    assert seen.count() == 9 and seen.where(F.col("letter").rlike(lines.FROM_THAI)).count() == 9
