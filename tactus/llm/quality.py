"""Quality rules: gradient-boosted trees over document statistics.

``fit`` learns from at most ``SAMPLE_ROWS`` labelled documents (the labels with
the smallest hash of their doc_id; the bound makes both the broadcast of the
sample and the driver's training set bounded). The trees are grown level by
level on binned statistics with logistic loss; a feature listed with -1 or +1
in ``FEATURES`` may only lower or only raise the score, so that adding symbols,
repetition or shouting to a text never improves it. The forest is flattened
into numpy node arrays (feature, threshold, left, right, value), which a batch
of documents descends in step. Scoring is one narrow pass over whole texts.

Defined cases: a null or empty text has no words and fails the base rules;
without usable labels of both kinds there is no model and the base rules alone
decide; labels without a matching document or with a null count for nothing;
repeated documents are judged alike; other columns are untouched, and a
document column named like a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes

SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, PENALTY, LEAST = 60, 4, 0.25, 64, 1.0, 4.0
#: A document is kept from this probability of good quality on.
KEEP_FROM = 0.5
#: Statistics, and the direction in which each may move the score (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "longest_word": -1,
    "symbols": -1,
    "duplicate_lines": -1,
    "repeated_words": -1,
    "capitals": -1,
    "exclamations": -1,
    "digits": 0,
    "punctuation": 0,
    "words_per_line": 0,
    "distinct_words": 0,
    "most_frequent": -1,
    "short_words": 0,
}
_SPACE, _SYMBOLS, _CAPITALS, _DIGITS, _MARKS, _EXCLAIM = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?", b"!"


def _without(text: bytes, letters: bytes) -> int:
    """How many bytes of text are among letters."""
    return len(text) - len(text.translate(None, letters))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            covered[first : first + 3] = covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - _without(text, _SPACE)
    symbols = _without(text, _SYMBOLS)
    seen: set[bytes] = set()
    duplicates = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                duplicates += 1
            seen.add(line)
    repeats = repeated_words(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    m, c = max(n, 1), max(chars, 1)
    features = [
        np.log1p(n),
        chars / m,
        float(max(map(len, counts), default=0)),
        symbols / c,
        duplicates / max(lines, 1),
        repeats / m,
        _without(text, _CAPITALS) / c,
        _without(text, _EXCLAIM) / m,
        _without(text, _DIGITS) / c,
        _without(text, _MARKS) / m,
        n / max(lines, 1),
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(k for w, k in counts.items() if len(w) <= 3) / m,
    ]
    return [n, chars, symbols, duplicates, repeats], features


@dataclass
class Forest:
    """Trees as node arrays; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row of statistics."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES) -> Forest | None:
    """A forest for rows of statistics x and labels y (0 or 1); None unless both labels occur."""
    if len(y) == 0 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    base = float(np.log(y.mean() / (1 - y.mean())))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def node(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    total, roots = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        root = node(0.0)
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for depth in range(DEPTH):
            following = []
            for k, rows, low, high in open_nodes:
                best = None
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[f][rows]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    vl = np.clip(gl / (hl + PENALTY), low, high)
                    vr = np.clip((gs - gl) / (hs - hl + PENALTY), low, high)
                    gain = 2 * gl * vl - (hl + PENALTY) * vl**2 + 2 * (gs - gl) * vr - (hs - hl + PENALTY) * vr**2
                    fine = (hl >= LEAST) & (hs - hl >= LEAST) & (directions[f] * (vr - vl) >= 0)
                    gain = np.where(fine, gain, -np.inf)
                    i = int(np.argmax(gain))
                    if best is None or gain[i] > best[0]:
                        best = (gain[i], f, i, vl[i], vr[i])
                if best is None or best[0] <= gs**2 / (hs + PENALTY) + 1e-9:
                    continue
                _, f, i, vl, vr = best
                left, right = node(RATE * vl), node(RATE * vr)
                nodes["feature"][k], nodes["threshold"][k], nodes["left"][k], nodes["right"][k] = f, edges[f][i], left, right
                goes = binned[f][rows] <= i
                middle = (vl + vr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[f]]
                following += [(left, rows[goes], *bounds[0]), (right, rows[~goes], *bounds[1])]
                total[rows[goes]] += nodes["value"][left] - nodes["value"][k]
                total[rows[~goes]] += nodes["value"][right] - nodes["value"][k]
            open_nodes = following
    arrays = {k: np.array(v) for k, v in nodes.items()}
    return Forest(**arrays, roots=np.array(roots), base=base)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest | None:
    """A forest from a bounded sample of labelled documents."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def batches(it):
        for batch in it:
            features = [statistics(t)[1] for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = joined.mapInArrow(batches, "doc_id bigint, quality int, x array<double>")
    # a row for each label of the sample, however often its document is repeated
    got = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id", "quality").toPandas()
    if got.empty:
        return None
    return grow(np.array(got["x"].tolist()), got["quality"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """docs with the base statistics, base_failed, quality (the score; null without a model) and kept."""
    results = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "quality": "double"}
    names = [c for c in docs.columns if c not in results]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in names), *(f"{c} {t}" for c, t in results.items())])
    at, keep = docs.columns.index(text), [docs.columns.index(c) for c in names]
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def batches(it):
        forest = held.value
        for batch in it:
            found = [statistics(t) for t in as_bytes(batch.column(at))]
            base = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            score = forest.score(np.array([f[1] for f in found]).reshape(-1, len(FEATURES))) if forest else np.full(len(found), np.nan)
            kept = ~failed & (~(score < KEEP_FROM))
            columns = [*(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score, mask=np.isnan(score))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns], [*names, *results])

    return docs.mapInArrow(batches, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    # the text goes to Python once, as the column that is judged; a name that judge would replace can't clash
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    judged = judge(docs.select(others, "text"), fit(docs, labels)).where("kept")
    return judged.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
