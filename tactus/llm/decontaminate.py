"""Benchmark decontamination by Wu-Manber search over words.

A text is a sequence of lower-cased words; the patterns are the benchmark
items' windows of 13 words. For each pattern length m a table is kept:

* ``shift``: for the last block of words (two, or one where m is 1) that the
  search looks at, how far it may move on without missing a pattern. A block
  in no pattern allows m - block + 1 words, so most of a clean text is never
  looked at.
* ``buckets``: patterns by their suffix block, then by their first word, which
  select the strings to test when the shift is zero.
* direct comparison of all words confirms an occurrence.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text; each block
is one bounded broadcast, and the documents pass the blocks one after another
in the same narrow stage, so a larger benchmark costs more passes, never more
memory. There is no shuffle.

Defined cases: a null or empty text has no words and is not contaminated; a
benchmark row without an id, a text or words is skipped; an item whose id
repeats counts once; repeated document rows are judged alike; other columns
are untouched, and a document column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes

WINDOW = 13
BLOCK_BYTES = 1 << 20
#: A document is contaminated when at least one word in so many is hit.
PER_HIT = 20
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
HITS = "array<struct<start:int,end:int,item:string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class _Length:
    """Shift table and buckets for the patterns of m words."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], list[str]]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            bucket = self.buckets.setdefault(pattern[m - self.block :], {})
            bucket.setdefault(pattern[0], []).append((list(pattern), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        m, block, shift, default = self.m, self.block, self.shift, self.default
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            move = shift.get(key, default)
            if move:
                end += move
                continue
            start = end - m
            for pattern, items in self.buckets[key].get(words[start], ()):
                if words[start:end] == pattern:
                    yield start, end, items
            end += 1


class WuManber:
    """Searches for the windows of (item_id, text bytes) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for item, text in items:
            words = words_of(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1) if m else ():
                owners = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
                if item not in owners:
                    owners.append(item)
        self.lengths = [_Length(m, patterns) for m, patterns in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, word after the last, items) of each occurrence."""
        for length in self.lengths:
            yield from length.search(words)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of bounded size (an item is never divided)."""
    blocks: list[list[tuple[str, bytes]]] = [[]]
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    for row in rows.where("item is not null and text is not null").toLocalIterator():
        text = row.text.encode()
        if blocks[-1] and size + len(text) > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row.item, text))
        size += len(text)
    return blocks


def _pass(df: DataFrame, held, window: int) -> DataFrame:
    """Appends the occurrences of one block's patterns to the column ``_hits``."""
    names, schema = df.columns, df.schema
    at, hits_at = names.index("_text"), names.index("_hits")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))

    def batches(it):
        matcher = WuManber(held.value, window)
        for batch in it:
            found = []
            for text, hits in zip(as_bytes(batch.column(at)), batch.column(hits_at).to_pylist(), strict=True):
                hits = hits or []
                for start, end, items in matcher.search(words_of(text)):
                    hits += [{"start": start, "end": end, "item": item} for item in items]
                found.append(hits)
            columns = list(batch.columns)
            columns[hits_at] = pa.array(found, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(batches, schema)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with ``n_words``, ``hits`` (start, end, item of each occurrence), ``n_hit``, ``items`` and ``contaminated``."""
    spark = docs.sparkSession
    results = ["n_words", "hits", "n_hit", "items", "contaminated"]
    df = docs.drop(*(set(results) - {text})).withColumns({"_text": F.col(text), "_hits": F.lit(None).cast(HITS)})
    blocks = item_blocks(benchmark, block_bytes)
    for block in blocks[:-1]:
        df = _pass(df, spark.sparkContext.broadcast(block), window)
    held = spark.sparkContext.broadcast(blocks[-1])
    names = [c for c in df.columns if c not in ("_text", "_hits", *results)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in names), f"n_words bigint, hits {HITS}, n_hit bigint, items array<string>, contaminated boolean"])
    at, hits_at = df.columns.index("_text"), df.columns.index("_hits")
    keep = [df.columns.index(c) for c in names]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))

    def batches(it):
        matcher = WuManber(held.value, window)
        for batch in it:
            n_words, all_hits, n_hit, all_items, bad = [], [], [], [], []
            for value, hits in zip(as_bytes(batch.column(at)), batch.column(hits_at).to_pylist(), strict=True):
                words = words_of(value)
                hits = hits or []
                for start, end, items in matcher.search(words):
                    hits += [{"start": start, "end": end, "item": item} for item in items]
                count = 0
                if hits:
                    mark = bytearray(len(words))
                    for h in hits:
                        mark[h["start"] : h["end"]] = b"\1" * (h["end"] - h["start"])
                    count = mark.count(1)
                n_words.append(len(words))
                all_hits.append(hits)
                n_hit.append(count)
                all_items.append(sorted({h["item"] for h in hits}))
                bad.append(count > 0 and PER_HIT * count >= len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in keep),
                    pa.array(n_words, pa.int64()),
                    pa.array(all_hits, kind),
                    pa.array(n_hit, pa.int64()),
                    pa.array(all_items, pa.list_(pa.string())),
                    pa.array(bad, pa.bool_()),
                ],
                [*names, *results],
            )

    return df.mapInArrow(batches, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    marks = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("text").alias("text"))
    return find(marks, benchmark).where("not contaminated").select("_row.*")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of a result of find()."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
