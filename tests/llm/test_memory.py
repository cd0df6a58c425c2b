"""What operators keep or send besides their results."""

import public_tokenizers
import pyarrow as pa

from tactus.llm import bpe, quality


def test_bpe_forgets_what_a_task_learned():
    """An idle worker holds the model only, and encodes the same afterwards."""
    model = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    first = model.encode_batch([b"some words, and others"])
    assert model.pieces and model.spelled and any(model.follows)
    model.forget()
    assert not model.pieces and not model.spelled and not any(model.follows) and model.encode_batch([b"some words, and others"]) == first


def test_quality_sends_a_text_once(spark, monkeypatch):
    """The rows that clean hands to Python hold each text once, and come back with their columns in order."""
    sent, judge = [], quality.judge
    monkeypatch.setattr(quality, "judge", lambda docs, forest, text="text": sent.append(docs.schema.simpleString()) or judge(docs, forest, text))
    docs = spark.createDataFrame([(1, "x", " ".join(f"w{k}" for k in range(60)), 5)], "doc_id long, kept string, text string, n_words long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r)[:2] + tuple(r)[3:] for r in quality.clean(docs, labels).collect()] == [(1, "x", 5)]
    assert quality.clean(docs, labels).columns == docs.columns and sent[0].count("text:string") == 1


def test_bpe_divides_a_part_of_a_batch_at_a_time(monkeypatch):
    """The words and results of a whole batch are never held together; nulls and long texts keep their rows."""
    monkeypatch.setattr(bpe, "PART", 30)
    texts = [b"some words", None, b"one text that is longer than a part by itself", b"", b"others, too", b"some words"] * 3
    model, seen = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), []
    whole = model.encode_batch(texts)
    divide = model.encode_batch
    monkeypatch.setattr(model, "encode_batch", lambda some: seen.append(sum(len(t or b"") for t in some)) or divide(some))
    for kind in (pa.string(), pa.large_string()):
        assert list(model.encode_column(pa.array([t and t.decode() for t in texts], kind))) == whole
    assert len(seen) > 6 and max(seen) == len(texts[2]) and list(model.encode_column(pa.array([], pa.string()))) == []


def test_bpe_that_forgets_holds_a_part_of_the_caches(monkeypatch):
    """Beside other steps the caches and parts are smaller, and the results are the same."""
    monkeypatch.setattr(bpe, "CACHE", 40)
    monkeypatch.setattr(bpe, "PART", 300)
    texts = pa.array([f"a{k} b{k} c{k}" for k in range(200)])
    model, most = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), {}
    for model.lean in (1, bpe.LEAN):
        model.forget()
        learn, held = bpe.WordBpe.learn, []
        monkeypatch.setattr(model, "learn", lambda chunks: learn(model, chunks) or held.append(len(model.pieces)))
        most[model.lean] = list(model.encode_column(texts)), max(held)
    assert most[1][0] == most[bpe.LEAN][0] and most[bpe.LEAN][1] <= 3 * bpe.CACHE // bpe.LEAN < most[1][1]
