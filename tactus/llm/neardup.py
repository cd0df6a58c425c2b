"""Near-duplicate documents: banded MinHash with odd sketches.

1. One pass over the texts gives each document's set of word shingles as a
   128-bit digest, ``BANDS`` x ``ROWS`` MinHash samples folded into band keys,
   and an odd sketch: the samples thrown into ``BITS`` parity bits.
2. Documents with equal sets form a class at once; only one of a class goes
   on, so groups of copies of any size cost one aggregation.
3. Classes that share a band key are candidates, which ``linking.resolve``
   joins to components without all pairs of a bucket. Pairs are judged by the
   XOR population count of their sketches, with a generous bound that a pair at
   the threshold passes but for chance of about 1e-8, and confirmed on the full
   sets of shingles.

A pair at similarity 0.8 misses all bands with probability (1 - 0.8**5)**32,
about 3e-6. What a bucket's hub leaves open is compared in blocks: the sketches of a
block at once, then the full sets of the rows that are left. The tables between
the steps are stored in the shared folder and deleted when they are used up.

Defined cases: documents without words (null, empty or only white space) have
an empty set, are linked with nothing and stand alone; a text of fewer words
than a shingle is one shingle; a null doc_id links with nothing and has a null
component; rows that share a doc_id count as one document with the links of
all; other columns don't matter.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import Scratch, as_bytes, tasks
from tactus.llm.linking import labelled, resolve, shared

BANDS, ROWS, BITS = 32, 5, 512
PERCENT = 80
SHINGLE = 5
#: Estimated similarity below which a candidate is not compared on its full sets.
ESTIMATE_FROM = 0.6
_HASHES = 200_000
_rng = np.random.default_rng(20_240_601)
_FACTORS = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_SEEDS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_PLACES = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(c | 1) for c in _rng.integers(1, 1 << 63, 3, dtype=np.uint64).tolist())


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: list[bytes], size: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    n = len(words)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(size, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = (h * _C1) ^ (ids[j : n - size + 1 + j] * _C2)
        h ^= h >> np.uint64(31)
    return np.unique(_mix(h))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch) of a set of shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, ((x[None, i : i + 4096] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    wide = least.astype(np.uint64)
    bands = _SEEDS.copy()
    for j in range(ROWS):
        bands = _mix((bands ^ wide.reshape(BANDS, ROWS)[:, j]) * _C1)
    places = _mix((wide + np.uint64(1)) * _PLACES) % np.uint64(BITS)
    parity = np.bincount(places.astype(np.int64), minlength=BITS) & 1
    return bands.view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64)


def distance_for(similarity: float) -> int:
    """Expected XOR population count of the sketches of two sets with this similarity."""
    return round(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * BANDS * ROWS * (1 - similarity))))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def batches(it):
        hashes = Hashes()
        for batch in it:
            n, digests, bands, sketches = [], [], [], []
            for text in as_bytes(batch.column(1)):
                words = text.lower().split() if text else []
                if not words:
                    n.append(0)
                    digests.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                shingles = shingle_hashes(words, size, hashes)
                keys, sketch = signature(shingles)
                n.append(len(shingles))
                digests.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(keys)
                sketches.append(sketch)
            columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def _exact(words: list[bytes], size: int) -> frozenset:
    size = min(size, len(words))
    return frozenset(zip(*(words[j:] for j in range(size)), strict=False))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets of shingles are similar enough."""
    joined = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    joined = joined.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def batches(it):
        known: dict[bytes, frozenset] = {}

        def of(text: bytes) -> frozenset:
            found = known.get(text)
            if found is None:
                if len(known) >= 64:
                    known.clear()
                found = known[text] = _exact(text.lower().split(), size)
            return found

        for batch in it:
            linked = []
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                s, t = of(x), of(y)
                both = len(s & t)
                linked.append(100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return joined.mapInArrow(batches, "a bigint, b bigint")


def _distance(s: Column, t: Column) -> Column:
    return sum((F.bit_count(s[i].bitwiseXOR(t[i])) for i in range(BITS // 64)), F.lit(0))


def _judged(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity, with their distance z."""
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("s")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("t")), "b")
    return both.select("a", "b", _distance(F.col("s"), F.col("t")).alias("z")).where(F.col("z") <= distance_for(ESTIMATE_FROM))


def _groups(it, key: int):
    """Rows of sorted batches as one table for each run of equal values in the first key columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(key)]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for at, end in zip(starts, starts[1:], strict=False):
            now = tuple(c[at] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _sorted_groups(df: DataFrame) -> DataFrame:
    return df.repartition(tasks(df), "k", "i", "j").sortWithinPartitions("k", "i", "j")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches of row x and column y allow the similarity."""
    z = np.zeros((len(x), len(y)), np.int16)
    for w in range(x.shape[1]):
        z += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
    return z <= distance_for(ESTIMATE_FROM)


def open_rows(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of linking.blocks that have a counterpart in another component which their sketches allow."""
    known = _sorted_groups(rows.join(sketches, "id").select("k", "i", "j", "minor", "id", "c", "sketch"))

    def batches(it):
        for group in _groups(it, 3):
            group = group.combine_chunks()
            minor = group.column(3).to_numpy()
            c = group.column(5).to_numpy()
            sketch = group.column(6).chunk(0).flatten().to_numpy().view(np.uint64).reshape(len(c), -1)
            first, second = np.flatnonzero(minor), np.flatnonzero(~minor)
            stays = np.zeros(len(c), bool)
            for at in range(0, len(first), 256):
                some = first[at : at + 256]
                near = _near(sketch[some], sketch[second]) & (c[some][:, None] != c[second][None])
                stays[some] |= near.any(axis=1)
                stays[second] |= near.any(axis=0)
            if stays.any():
                yield from group.select(range(6)).filter(pa.array(stays)).to_batches()

    return known.mapInArrow(batches, "k bigint, i int, j int, minor boolean, id bigint, c bigint")


def _common(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of first (rows) and second (columns)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_by = times[column] > 1
    owner, column = owner[shared_by], np.unique(column[shared_by], return_inverse=True)[1]
    out = np.zeros((len(first), len(second)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, 4096):
        at, end = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), min(4096, width - low)), np.float32)
        part[owner[at:end], column[at:end] - low] = 1
        out += part[first] @ part[second].T
    return out


def linked_blocks(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components between which a block has a similar pair; full sets are compared."""
    known = _sorted_groups(rows.join(texts, "id").select("k", "i", "j", "minor", "id", "c", "text"))

    def batches(it):
        hashes = Hashes()
        for group in _groups(it, 3):
            minor, ids, c = (group.column(x).to_numpy() for x in (3, 4, 5))
            texts_ = as_bytes(group.column(6))
            sets = [shingle_hashes(t.lower().split(), size, hashes) for t in texts_]
            n = np.array([len(s) for s in sets])
            first, second = np.flatnonzero(minor), np.flatnonzero(~minor)
            a, b = [], []
            both = _common(sets, first, second)
            linked = 100 * both >= percent * (n[first][:, None] + n[second][None] - both)
            linked &= c[first][:, None] != c[second][None]
            root: dict[int, int] = {}

            def find(x: int, root=root) -> int:
                while x in root:
                    x = root[x]
                return x

            for x, y in zip(*(v.tolist() for v in np.nonzero(linked)), strict=True):
                p, q = first[x], second[y]
                u, v = find(int(c[p])), find(int(c[q]))
                if u == v:
                    continue
                s, t = _exact(texts_[p].lower().split(), size), _exact(texts_[q].lower().split(), size)
                if 100 * len(s & t) >= percent * len(s | t):
                    root[max(u, v)] = min(u, v)
                    a.append(ids[p])
                    b.append(ids[q])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return known.mapInArrow(batches, "a bigint, b bigint")


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(signatures(docs, size), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r"))
    classes = scratch.keep(classes.select("digest", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("size"), F.col("r.bands").alias("bands"), F.col("r.sketch").alias("sketch")), "classes")
    brief = scratch.keep(signed.select("doc_id", "n_shingles", "digest"), "sizes")

    buckets = scratch.keep(shared(classes.select("id", "size", F.explode("bands").alias("k"))), "buckets")
    ids = buckets.select("id").distinct()
    sketches = scratch.keep(classes.select("id", "sketch").join(ids, "id", "left_semi"), "sketches")
    members = scratch.keep(classes.select("digest", "id"), "members")
    scratch.drop(signed, classes)
    texts = scratch.keep(docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi"), "texts")

    def compare(rows: DataFrame) -> DataFrame:
        left = scratch.keep(open_rows(rows, sketches), "open")
        return linked_blocks(left, texts, size, percent)

    labels = resolve(buckets, lambda pairs: _judged(pairs, sketches), lambda pairs: confirmed(pairs, texts, size, percent), compare, percent, scratch)
    found = brief.join(labelled(members, labels, "id", "component").select("digest", "component"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = scratch.keep(found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")), "components")
    scratch.close(out)
    return out


def clean(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when one document of each component stays."""
    gone = link(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
