"""Substring de-duplication with a log-structured fingerprint index.

A word is removed if it stands in a window of ``WINDOW`` consecutive words that
also starts in a document with a smaller id.

Fingerprints. Every window contains WINDOW - ``GRAM`` + 1 grams of GRAM words;
the least of their hashes is the window's fingerprint. Equal windows have equal
fingerprints, and neighbouring windows mostly share theirs, so a text is stored
as stretches of windows with one fingerprint, each with a digest of its words
(about one stretch for 16 words).

Index. Documents come in batches of ascending ids. A batch's stretches,
reduced to one row (fingerprint, digest, smallest id) for each distinct
stretch, are written as an immutable run, bucketed and sorted by fingerprint.
A new batch is merge-joined with all runs:

* a stretch whose digest an earlier document has is a copy as a whole;
* a fingerprint with several digests may hide equal windows in unequal
  stretches. One document for each digest is enough to verify that: its text
  is read again and all its windows under such fingerprints are hashed in full
  (64 bits over the words, beside the fingerprint's 64), and equal windows are
  those with equal hashes.

Runs are compacted: once there are ``FAN_IN``, they are merged into one, keeping
the smallest id of each stretch, and the old ones are deleted. Only fingerprints
that the new batch has are verified again.

Groups of copies of any size cost one row of a run; nothing is enumerated in
pairs. Defined cases: a null or empty text and a text of fewer than WINDOW
words have no windows; windows never cross documents, and windows that repeat
only in documents of the same id are kept; rows with a null id are not
compared with others and lose nothing; rows that share id and text are treated
alike.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes, discard, shared_dir, written
from tactus.llm.neardup import Hashes

WINDOW, GRAM = 50, 20
BATCHES, FAN_IN, BUCKETS = 2, 2, 16
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive ids."""
    n = len(ids)
    up, down = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * up[:n], dtype=np.uint64)))
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each run of size consecutive values."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    more = size - width
    return np.minimum(values[:-more], values[more:]) if more else values


def stretches(words: list[bytes], hashes: Hashes) -> list[tuple[int, int, int]]:
    """(fingerprint, first window, number of windows) along a text."""
    if len(words) < WINDOW:
        return []
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    least = _least(_rolling(ids, GRAM), WINDOW - GRAM + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.concatenate((first, [len(least)])))
    return list(zip(least[first].view(np.int64).tolist(), first.tolist(), n.tolist(), strict=True))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _stretched(docs: DataFrame) -> DataFrame:
    """doc_id, v, fp, dg (digest of the stretch's words), s (first window), n (windows)."""

    def batches(it):
        hashes = Hashes()
        for batch in it:
            rows: list[tuple] = []
            owners: list[int] = []
            for i, text in enumerate(as_bytes(batch.column(2))):
                words = text.split() if text else []
                for fp, s, n in stretches(words, hashes):
                    owners.append(i)
                    rows.append((fp, int.from_bytes(_digest(words[s : s + n + WINDOW - 1])[:8], "little", signed=True), s, n))
            at = pa.array(owners, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at)]
            columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "fp", "dg", "s", "n"])

    return docs.select("doc_id", "v", "text").mapInArrow(batches, "doc_id bigint, v bigint, fp bigint, dg bigint, s int, n int")


class FingerprintIndex:
    """Sorted immutable runs of (fp, dg, doc, v, s, n) in the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int = BUCKETS):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets
        self.folder = f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[str] = []

    def entries(self) -> DataFrame:
        """One row for each stretch, from all runs."""
        out = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            out = out.unionByName(self.spark.table(name))
        return self.reduced(out) if len(self.runs) > 1 else out

    @staticmethod
    def reduced(entries: DataFrame) -> DataFrame:
        least = F.min(F.struct("doc", "v", "s", "n")).alias("m")
        return entries.groupBy("fp", "dg").agg(least).select("fp", "dg", "m.doc", "m.v", "m.s", "m.n")

    def add(self, stretched: DataFrame) -> None:
        """Writes the batch as a new run, then compacts if there are too many."""
        rows = stretched.select("fp", "dg", F.col("doc_id").alias("doc"), "v", "s", "n")
        self._write(self.reduced(rows))
        if len(self.runs) >= self.fan_in:
            self.compact()

    def compact(self) -> None:
        old, self.runs = self.runs, []
        merged = None
        for name in old:
            merged = self.spark.table(name) if merged is None else merged.unionByName(self.spark.table(name))
        self._write(self.reduced(merged))
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, f"{self.folder}/{name}")

    def _write(self, run: DataFrame) -> None:
        name = f"run_{uuid.uuid4().hex}"
        sorted_run = run.repartition(self.buckets, "fp").write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp")
        sorted_run.option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.runs.append(name)


def _window_hashes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Full hashes (a) of the windows of stretches (fp, dg, doc, v, s, n), with their offset in the stretch."""
    spans = wanted.groupBy("doc", "v").agg(F.collect_list(F.struct("s", "n", "fp", "dg")).alias("spans"))
    joined = spans.join(texts, ["doc", "v"]).select("doc", "spans", "text")
    names = ["doc", "fp", "dg", "off", "a"]

    def batches(it):
        for batch in it:
            where: list[int] = []
            rows: list[list[int]] = [[], [], [], []]
            for i, (spans, text) in enumerate(zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True)):
                words = text.split()
                for span in spans:
                    for off in range(span["n"]):
                        s = span["s"] + off
                        where.append(i)
                        values = span["fp"], span["dg"], off, int.from_bytes(_digest(words[s : s + WINDOW])[:8], "little", signed=True)
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
            columns = [pa.array(r, pa.int32() if k == 2 else pa.int64()) for k, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *columns], names)

    return joined.mapInArrow(batches, "doc bigint, fp bigint, dg bigint, off int, a bigint")


def _covered(stretched: DataFrame, index: FingerprintIndex, texts: DataFrame, low: int | None) -> DataFrame:
    """doc_id, v and x (s, n): windows of the batch that a smaller id has, as stretches.

    The index holds the batch already; texts: doc, v, text of all documents so
    far; low: the largest id before the batch.
    """
    known = index.entries()
    counts = known.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max("doc").alias("newest")).where("c > 1")
    several = (counts if low is None else counts.where(F.col("newest") > low)).select("fp")
    # one document for each digest under fingerprints with several digests
    hashed = written(_window_hashes(known.join(several, "fp"), texts), "windows")
    least = hashed.groupBy("fp", "a").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    partly = hashed.join(least, ["fp", "a"]).where("doc > least").groupBy("fp", "dg").agg(F.collect_set("off").alias("offs"))
    fates = known.select("fp", "dg", F.col("doc").alias("first")).join(partly, ["fp", "dg"], "left")
    # later copies of a stretch are covered as a whole; in its first document, the windows verified to stand in an earlier one
    whole = F.array(F.struct("s", "n"))
    some = F.transform("offs", lambda o: F.struct((F.col("s") + o).alias("s"), F.lit(1).alias("n")))
    spans = F.when(F.col("doc_id") > F.col("first"), whole).when((F.col("doc_id") == F.col("first")) & F.col("offs").isNotNull(), some)
    found = stretched.join(fates, ["fp", "dg"]).select("doc_id", "v", spans.alias("spans")).where("spans is not null").select("doc_id", "v", F.explode("spans").alias("x"))
    out = written(found, "covered")
    for used in (hashed, stretched):
        discard(out.sparkSession, used.stored_at)
    return out


def intervals(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, v and spans (s, n: covered windows) of each document that loses words."""
    spark = docs.sparkSession
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("v"), "text")
    index = FingerprintIndex(spark)
    edges = keyed.stat.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    cuts = [None, *sorted({int(e) for e in edges}), None]
    found = None
    for low, high in zip(cuts, cuts[1:], strict=False):
        batch = keyed if low is None else keyed.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        so_far = keyed if high is None else keyed.where(F.col("doc_id") <= high)
        stretched = written(_stretched(batch), "stretches")
        index.add(stretched)
        texts = so_far.select(F.col("doc_id").alias("doc"), "v", "text")
        covered = _covered(stretched, index, texts, low)
        found = covered if found is None else found.unionByName(covered)
    return found.groupBy("doc_id", "v").agg(F.collect_set("x").alias("spans"))


def dedup(docs: DataFrame, batches: int = BATCHES, digests: bool = False) -> DataFrame:
    """docs' doc_id with n_words, n_removed and, either the kept words joined by spaces, or their SHA-256."""
    spans = intervals(docs, batches).withColumnsRenamed({"doc_id": "_d", "v": "_v"})
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("v"))
    joined = rows.join(spans, (F.col("doc_id") == F.col("_d")) & (F.col("v") == F.col("_v")), "left").select("doc_id", "text", "spans")
    name = "kept_sha256" if digests else "kept_text"

    def batches_of(it):
        for batch in it:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                n_words.append(len(words))
                gone = 0
                if spans:
                    mark = bytearray(len(words))
                    for x in spans:
                        mark[x["s"] : x["s"] + x["n"] + WINDOW - 1] = b"\1" * (x["n"] + WINDOW - 1)
                    gone = mark.count(1)
                    words = [w for w, m in zip(words, mark, strict=True) if not m]
                n_removed.append(gone)
                rest = b" ".join(words)
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", name])

    return joined.mapInArrow(batches_of, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string")
