"""Language-model scores: prediction by partial matching over bytes.

A text's bytes (A-Z lower-cased), ended by a mark, are predicted from up to
``ORDER`` bytes before. Training counts every (context, byte) of every training
text: each task counts its longest grams, Spark sums them, and the shorter
orders are their sums. No gram is left out, however rare. A context that
occurs T times with q different successors escapes to the next shorter one
with probability q / (T + q) (method C), and the successors of the longer
context are excluded from the shorter one's counts. Since the successors of a
context are also successors of its suffix, what exclusion leaves depends on
the context alone.

The probability of a byte depends on its gram alone. Longest grams that make
up at least 2**-GRAM_BITS of all bytes (no more than 2**GRAM_BITS can) are
broadcast with theirs. What a text has of the others is stored beside its
score and joined with a table that grows with the corpus: grams are dealt by
the last LOCAL bytes of their context, which holds all orders from LOCAL up of
a part of the trie together, and a task works through its parts one after
another. A part has at most 256**(ORDER + 1 - LOCAL) grams and the orders
below LOCAL, which every task gets, at most 256**LOCAL, at any size.

The base is a unigram model of words. Words that make up at least
2**-WORD_BITS of all tokens (no more than 2**WORD_BITS words) are broadcast;
the rarer words of each document are joined with their counts.

Defined cases: a null text counts as empty: one token, the end; a null doc_id
is learnt from and not held out; repeated rows are counted and scored each;
with no training text, every count is 0 and every byte equally likely. Texts
of any length are worked through in pieces.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import Scratch, as_bytes, cut

ORDER, LOCAL, GRAM_BITS, WORD_BITS = 5, 3, 23, 19
#: Marks the end of a text, and stands before its beginning; no byte of UTF-8.
MARK = 0xFF
CHUNK = 1 << 20
#: Entries that a task counts before it hands them on.
HELD = 1_500_000
HELD_WORDS = 300_000
#: Grams from which on a task works through the parts of the trie that it has read.
PART = 1 << 18
#: Texts that are scored at once.
ROWS = 512


def remainder():
    """Documents where this is 1 are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(0))


def _pieces(texts: list[bytes]):
    """Lists of about CHUNK bytes of texts: the number of the text, and a piece of it after the ORDER bytes before that."""
    mark = bytes([MARK])
    some, size = [], 0
    for i, t in enumerate(texts):
        t = mark * ORDER + t + mark
        for at in range(0, len(t) - ORDER, CHUNK):
            some.append((i, t[at : at + CHUNK + ORDER]))
            size += len(some[-1][1])
            if size >= CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


def _keys(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of ORDER + 1 bytes that ends at each byte of the pieces but their first ORDER, and where each piece's begin."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    keys = np.zeros(len(data), np.int64)
    for back in range(ORDER + 1):
        keys[back:] |= data[: len(data) - back].astype(np.int64) << (8 * back)
    sizes = np.array([len(p) - ORDER for p in pieces])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    keep = np.ones(len(data), bool)
    at = begins + ORDER * np.arange(len(pieces))
    for j in range(ORDER):
        keep[at + j] = False
    return keys[keep], begins


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of ORDER + 1 bytes that ends at each byte and end of the texts, and where each text's begin."""
    mark = bytes([MARK])
    return _keys([mark * ORDER + t + mark for t in texts])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _shorter(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of an order and their counts, from those of a longer one."""
    return _summed([(keys & ((1 << (8 * (order + 1))) - 1), counts)])


def _counted(docs: DataFrame) -> DataFrame:
    """Partial counts: of grams (k) and of words (w; the end is the empty word)."""

    def rows(kind: str, values, counts) -> pa.RecordBatch:
        n = len(counts)
        k = pa.array(values, pa.int64()) if kind == "k" else pa.nulls(n, pa.int64())
        w = pa.array(values, pa.binary()) if kind == "w" else pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([k, w, pa.array(counts, pa.int64())], ["k", "w", "n"])

    def batches(it):
        parts, held, words = [], 0, Counter()
        for batch in (b.slice(at, ROWS) for b in it for at in range(0, b.num_rows, ROWS)):
            texts = [(t or b"").lower() for t in as_bytes(batch.column(0))]
            for t in texts:
                words.update(t.split())
                if len(words) > HELD_WORDS:
                    yield rows("w", list(words), list(words.values()))
                    words = Counter()
            words[b""] += len(texts)
            for some in _pieces(texts):
                parts.append(np.unique(_keys([p for _, p in some])[0], return_counts=True))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield rows("k", *parts[0])
                        parts, held = [], 0
        if parts:
            yield rows("k", *_summed(parts))
        if words:
            yield rows("w", list(words), list(words.values()))

    return docs.select("text").mapInArrow(batches, "k bigint, w binary, n bigint")


@dataclass
class Level:
    """One order of the trie: kept grams, and contexts with what follows from exclusion."""

    keys: np.ndarray  # context and byte, sorted
    log_n: np.ndarray
    log_p: np.ndarray  # without exclusion
    contexts: np.ndarray  # sorted
    escape: np.ndarray  # log10, without exclusion
    next_total: np.ndarray  # log10 of the shorter context's total without this one's successors
    next_escape: np.ndarray  # log10 of escaping from the shorter context after that


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == keys, i, -1)


class Ppm:
    """levels: for each order from 0, sorted grams, their counts, sorted contexts and how often those occur."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        shorter = None
        for order, (keys, counts, all_contexts, occurrences) in enumerate(levels):
            context = keys >> 8
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
            contexts = context[first]
            q = np.diff(np.concatenate((first, [len(keys)])))
            kept = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
            total = occurrences[_at(all_contexts, contexts)] if len(keys) else np.zeros(0)
            next_total = next_escape = np.zeros(len(contexts))
            if order and len(keys):
                up = _at(shorter["contexts"], contexts & ((1 << (8 * (order - 1))) - 1))
                gram = _at(shorter["keys"], keys & ((1 << (8 * order)) - 1))
                excluded = np.add.reduceat(shorter["counts"][gram], first)
                fresh = shorter["q"][up] - q
                rest = shorter["total"][up] - excluded + fresh
                leaving = shorter["total"][up] - shorter["kept"][up] + fresh
                with np.errstate(divide="ignore"):
                    next_total = np.log10(np.maximum(rest, 1e-300))
                    # nothing is left to predict: one escapes for certain
                    next_escape = np.where(leaving > 0, np.log10(np.maximum(leaving, 1e-300)) - next_total, 0.0)
            level = Level(keys, np.log10(counts), np.log10(counts) - np.log10(np.repeat(total + q, q)), contexts, np.log10(total - kept + q) - np.log10(total + q), next_total, next_escape)
            self.levels.append(level)
            shorter = {"contexts": contexts, "total": total, "kept": kept, "q": q, "keys": keys, "counts": counts}
            if order == 0:
                self.rest = math.log10(max(1, MARK + 1 - len(keys)))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each gram after the others."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        keys = keys.copy()
        came = np.full(len(keys), -1)  # context of the order above that was left
        for order in range(len(self.levels) - 1, -1, -1):
            level = self.levels[order]
            keys &= (1 << (8 * (order + 1))) - 1
            found = _at(level.keys, keys)
            hit = found >= 0
            plain = hit & (came < 0)
            out[todo[plain]] += level.log_p[found[plain]]
            cut_off = hit & (came >= 0)
            if cut_off.any():
                out[todo[cut_off]] += level.log_n[found[cut_off]] - self.levels[order + 1].next_total[came[cut_off]]
            todo, keys, came = todo[~hit], keys[~hit], came[~hit]
            if not len(todo):
                return out
            context = _at(level.contexts, keys >> 8)
            leaves = (came < 0) & (context >= 0)
            out[todo[leaves]] += level.escape[context[leaves]]
            passes = came >= 0
            if passes.any():
                out[todo[passes]] += self.levels[order + 1].next_escape[came[passes]]
            came = context
        out[todo] -= self.rest
        return out


def _whole(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of a trie of which all grams are kept."""
    return keys, counts, *_summed([(keys >> 8, counts)])


def _frequent(longest: DataFrame, often) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent longest grams and the log10 of their probabilities."""
    contexts = longest.groupBy(F.shiftright("k", 8).alias("c")).agg((F.sum("n") + F.count(F.lit(1))).alias("t"))
    grams = longest.where(often).withColumn("c", F.shiftright("k", 8)).join(contexts, "c")
    got = grams.select("k", (F.log10("n") - F.log10("t")).alias("p")).toArrow()
    keys, logs = (got.column(c).to_numpy() for c in ("k", "p"))
    order = np.argsort(keys)
    return keys[order], logs[order]


def _whole_parts(batches, least: int):
    """Columns but the first of sorted batches, put together so that rows equal in the first stay together."""
    held, size, last = [], 0, None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        part = rows[0]
        if not len(part):
            continue
        ends = int(np.searchsorted(part, part[-1]))  # what follows may go on in the next batch
        if size + ends >= least and (ends or part[0] != last) and size + ends:
            yield [np.concatenate([*(h[c] for h in held), rows[c][:ends]]) for c in range(1, len(rows))]
            held, size, rows = [], 0, [r[ends:] for r in rows]
        held.append(rows)
        size += len(rows[0])
        last = part[-1]
    if held:
        yield [np.concatenate([h[c] for h in held]) for c in range(1, len(held[0]))]


def _rare(longest: DataFrame, asked: DataFrame, often) -> DataFrame:
    """k and p, its log10 probability: of every longest gram that is not frequent and every one asked for."""
    spark = longest.sparkSession
    mask = (1 << (8 * LOCAL)) - 1
    got = longest.groupBy(F.col("k").bitwiseAND(F.lit(mask)).alias("k")).agg(F.sum("n").alias("n")).toArrow()
    keys, counts = _summed([(got.column("k").to_numpy(), got.column("n").to_numpy().astype(np.float64))])
    low = spark.sparkContext.broadcast([_whole(*_shorter(keys, counts, o)) for o in range(LOCAL)])

    def scored(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        seen = counts > 0
        grams = keys[seen], counts[seen].astype(np.float64)
        model = Ppm([*low.value, *(_whole(*_shorter(*grams, o)) for o in range(LOCAL, ORDER + 1))])
        out = np.unique(keys[wanted])
        return pa.RecordBatch.from_arrays([pa.array(out), pa.array(model.log_probabilities(out))], ["k", "p"])

    def batches(it):
        for keys, counts, wanted in _whole_parts(it, PART):
            yield scored(keys, counts, wanted)

    part = F.shiftright("k", 8).bitwiseAND(F.lit(mask)).alias("part")
    model = longest.select(part, "k", "n", (~often).alias("wanted"))
    every = model.union(asked.distinct().select(part, "k", F.lit(0).cast("bigint"), F.lit(True)))
    return every.repartition("part").sortWithinPartitions("part").mapInArrow(batches, "k bigint, p double")


def _looked_up(texts: list[bytes], known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """Sum of the logs of each text's known grams, and its other grams (k) with how often it has them (n).

    A gram and the number of its text, 15 bits at most, are sorted as one number.
    """
    sums, sizes, bits = np.zeros(len(texts)), np.zeros(len(texts) + 1, np.int64), 8 * (ORDER + 1)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for some in _pieces(texts):
        all_grams, begins = _keys([p for _, p in some])
        owners = np.array([i for i, _ in some], np.int64)
        both, n = np.unique(all_grams | np.repeat(owners << bits, np.diff([*begins, len(all_grams)])), return_counts=True)
        owner, key = both >> bits, both & ((1 << bits) - 1)
        at = _at(known[0], key)
        hit = at >= 0
        sums += np.bincount(owner[hit], known[1][at[hit]] * n[hit], len(texts))
        sizes[1:] += np.bincount(owner[~hit], minlength=len(texts))
        keys.append(key[~hit])
        times.append(n[~hit])
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(times))], ["k", "n"])
    return sums, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pairs)


def score(docs: DataFrame, gram_bits: int = GRAM_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    gram_bits decides which grams are looked up in a broadcast and which in a join; the scores are the same.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    partial = scratch.keep(_counted(docs.where(remainder() != 1)), "counts")
    longest = scratch.keep(partial.where("k is not null").groupBy("k").agg(F.sum("n").alias("n")), "grams")
    total = longest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    often = F.col("n") >= -(-total // (1 << gram_bits))
    model = spark.sparkContext.broadcast(_frequent(longest, often))
    counts = cut(partial.where("w is not null").groupBy("w").agg(F.sum("n").alias("c")))
    scratch.drop(partial)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums.n, sums.v
    frequent = F.col("c") * (1 << WORD_BITS) >= n
    # at most 2**WORD_BITS words
    known = counts.where(frequent).select("w", "c").toArrow()
    words = spark.sparkContext.broadcast(dict(zip(known.column("w").to_pylist(), known.column("c").to_pylist(), strict=True)))
    del known
    divisor = math.log10(n + 0.5 * (v + 1))

    def batches(it):
        grams_known, logs, has = model.value, {w: math.log10(c + 0.5) for w, c in words.value.items()}, words.value
        end = (math.log10(has[b""] + 0.5), 1) if b"" in has else None
        for batch in (b.slice(at, ROWS) for b in it for at in range(0, b.num_rows, ROWS)):
            texts = [(t or b"").lower() for t in as_bytes(batch.column(2))]
            n_tokens, n_known, base, rare = [], [], [], []
            for t in texts:
                tokens = t.split()
                found = [logs[w] for w in tokens if w in logs]
                others = Counter([w for w in tokens if w not in logs]) if len(found) < len(tokens) else {}
                if end is None:
                    others = {**others, b"": 1}
                else:
                    found.append(end[0])
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(found))
                base.append(math.fsum(found))
                rare.append([{"w": w, "n": k} for w, k in others.items()])
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_tokens, n_known)), pa.array(base, pa.float64())]
            sums, others = _looked_up(texts, grams_known)
            columns += [pa.array(sums), others, pa.array(rare, pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "grams", "rare"])

    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, grams array<struct<k:bigint,n:bigint>>, rare array<struct<w:binary,n:bigint>>"
    rows = docs.select("doc_id", (remainder() == 1).alias("held_out"), "text").mapInArrow(batches, kinds)
    rows = scratch.keep(rows.withColumn("r", F.monotonically_increasing_id()), "scores")
    apart = rows.select("r", "held_out", F.explode("grams").alias("x")).select("r", "held_out", "x.k", "x.n")
    chances = scratch.keep(_rare(longest, apart.where("held_out").select("k"), often), "chances")
    scratch.drop(longest)
    nothing, zero = F.lit(0).cast("bigint"), F.lit(0.0)
    gram_part = apart.join(chances, "k").select("r", nothing.alias("k"), zero.alias("b"), (F.col("n") * F.col("p")).alias("s"))
    each = rows.select("r", F.explode("rare").alias("x")).select("r", "x.w", "x.n").join(counts.where(~frequent), "w", "left")
    c = F.coalesce("c", F.lit(0))
    word_part = each.select("r", F.when(c > 0, F.col("n")).otherwise(nothing).alias("k"), (F.col("n") * F.log10(c + 0.5)).alias("b"), zero.alias("s"))
    others = gram_part.union(word_part).groupBy("r").agg(*(F.sum(x).alias(x) for x in "kbs"))
    joined = rows.drop("rare", "grams").join(others.withColumnRenamed("s", "more"), "r", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
