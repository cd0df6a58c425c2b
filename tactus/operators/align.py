"""Alignment of official lyric lines with transcript segments, song by song.

The dynamic programmes carry state along a matrix, which SQL can't express, so
a song's arrays go through ``applyInPandas``; a song has at most some hundred
lines, and songs are spread over all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.operators import line_pairs

ANCHOR_FROM, CHORUS_FROM, CHORUS_LINES = 0.62, 0.78, 2


def dtw(cost: np.ndarray, window: int = 0) -> list[tuple[int, int]]:
    """Cheapest monotone path through a cost matrix; on ties diagonal, then up, then left.

    window: a band around the diagonal, at least as wide as the sides differ; 0: none.
    """
    n, m = cost.shape
    if not n or not m:
        return []
    reach = max(window, abs(n - m)) if window else max(n, m)
    total = np.full((n, m), np.inf)
    for i in range(n):
        low, high = (max(0, i - reach), min(m, i + reach + 1)) if window else (0, m)
        for j in range(low, high):
            if i and j:
                before = min(total[i - 1, j], total[i, j - 1], total[i - 1, j - 1])
            elif i or j:
                before = total[i - 1, 0] if i else total[0, j - 1]
            else:
                before = 0.0
            total[i, j] = cost[i, j] + before
    path = [(n - 1, m - 1)]
    while path[-1] != (0, 0):
        i, j = path[-1]
        steps = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
        path.append(min((s for s in steps if min(s) >= 0), key=lambda s: total[s]))
    return path[::-1]


def cheapest_on_path(path: list[tuple[int, int]], cost: np.ndarray) -> list[int]:
    """For each row, its cheapest column on the path (the first on ties)."""
    best = [-1] * cost.shape[0]
    for i, j in path:
        if best[i] < 0 or cost[i, j] < cost[i, best[i]]:
            best[i] = j
    return best


def assign_groups(similarity: np.ndarray) -> list[int]:
    """The segment of each line when every segment takes a run of lines in order.

    Maximises the sum over segments of their lines' mean similarity. Of equal
    divisions, each segment from the last on takes as many lines as it can; it
    stays empty only where that is better.
    """
    n, m = similarity.shape
    sums = np.vstack([np.zeros(m), np.cumsum(similarity, axis=0)])
    best = np.full((n + 1, m + 1), -np.inf)
    best[0, 0] = 0.0
    came = np.zeros((n + 1, m + 1), int)
    for j in range(1, m + 1):
        best[:, j], came[:, j] = best[:, j - 1], np.arange(n + 1)  # a segment may stay empty, but not on a tie
        for i in range(1, n + 1):
            k = np.arange(i)
            values = best[:i, j - 1] + (sums[i, j - 1] - sums[:i, j - 1]) / (i - k)
            at = int(np.argmax(values))
            if values[at] >= best[i, j]:
                best[i, j], came[i, j] = values[at], at
    out, i = [-1] * n, n
    for j in range(m, 0, -1):
        for line in range(came[i, j], i):
            out[line] = j - 1
        i = came[i, j]
    return out


def bigram_dice(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if len(a) < 2 or len(b) < 2:
        return float(a == b)
    left, count = {}, 0
    for k in range(len(a) - 1):
        left[a[k : k + 2]] = left.get(a[k : k + 2], 0) + 1
    for k in range(len(b) - 1):
        g = b[k : k + 2]
        if left.get(g, 0):
            left[g] -= 1
            count += 1
    return 2 * count / (len(a) + len(b) - 2)


def edit_similarity(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    row = np.arange(len(b) + 1)
    letters = np.array(list(b)) if b else np.zeros(0, str)
    for i, c in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (letters != c))))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return 1 - int(row[-1]) / max(len(a), len(b))


def runs_on_diagonal(similar: np.ndarray, offset: int) -> np.ndarray:
    """(first, end) of the runs of ones on a diagonal that a zero ends; a run up to the diagonal's end is none."""
    marks = np.diag(similar, offset).astype(np.int8)
    steps = np.diff(marks, prepend=0)
    ends = np.flatnonzero(steps < 0)
    return np.column_stack([np.flatnonzero(steps > 0)[: len(ends)], ends])


def choruses(similar: np.ndarray, least: int = CHORUS_LINES) -> list[range]:
    """Runs of least or more lines that are like the lines a fixed offset on, the shortest offsets first.

    A run counts when a line that isn't alike follows it, and its first line is in no run before.
    """
    n = len(similar)
    if n < 2 * least:
        return []
    taken, found = np.zeros(n, bool), []
    for offset in range(least, n):
        spans = runs_on_diagonal(similar, offset)
        for first, end in spans[spans[:, 1] - spans[:, 0] >= least].tolist():
            if not taken[first]:
                taken[first:end] = True
                found.append(range(first, end))
    return found


_MATCHED = "song_id bigint, line_index int, transcript_index int, similarity double, start_ms bigint, end_ms bigint, chorus boolean"


def match(official: DataFrame, transcript: DataFrame, window: int = 0) -> DataFrame:
    """Each official line (song_id, line_index, form) with its transcript segment (seg_index, form, start_ms, end_ms).

    form is the line's form for matching (text.match_form), romaji is left out
    where a script has none: similarity is 0.7 of edit plus 0.3 of bigram
    similarity. Scores follow from sequence.match_scores.
    """

    def song(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("line_index"), b.sort_values("seg_index")
        n, m = len(a), len(b)
        if not n:
            return pd.DataFrame(columns=[c.split()[0] for c in _MATCHED.split(", ")])
        x, y = [s or "" for s in a["form"]], [s or "" for s in b["form"]]
        grams = line_pairs.Grams(x + y)
        alike = np.vstack([line_pairs.dice(c, grams.sizes[k : k + len(c)], grams.sizes) for k, c in grams.common()])[:n]
        longer = np.maximum([[len(s)] for s in x], [[len(t) for t in y]]).reshape(n, m)
        sims = 0.7 * (1 - line_pairs.edit_distances(x, y) / np.maximum(longer, 1)) + 0.3 * alike[:, n:]
        cost = 1 - sims
        to = cheapest_on_path(dtw(cost, window or max(8, int(m * 0.15))), cost) if m else [-1] * n
        chorus = {i for run in choruses(alike[:, :n] >= CHORUS_FROM) for i in run}
        start, end = b["start_ms"].tolist(), b["end_ms"].tolist()
        return pd.DataFrame(
            {
                "song_id": key[0],
                "line_index": a["line_index"].tolist(),
                "transcript_index": to,
                "similarity": [round(sims[i, j], 6) if j >= 0 else 0.0 for i, j in enumerate(to)],
                "start_ms": [start[j] if j >= 0 else 0 for j in to],
                "end_ms": [end[j] if j >= 0 else 0 for j in to],
                "chorus": [i in chorus for i in range(n)],
            }
        )

    return official.groupBy("song_id").cogroup(transcript.groupBy("song_id")).applyInPandas(song, _MATCHED)


def match_stats(scored: DataFrame) -> DataFrame:
    """song_id with mean confidence and similarity, anchors, flagged and unmatched lines of sequence.match_scores."""
    flagged = F.sort_array(F.collect_list(F.when(F.round("confidence", 3) < 0.45, F.col("line_index"))))
    return scored.groupBy("song_id").agg(
        F.round(F.avg(F.round("confidence", 3)), 3).alias("avg_confidence"),
        F.round(F.avg(F.round("similarity", 3)), 3).alias("avg_similarity"),
        F.count(F.when(F.col("anchor"), F.lit(1))).alias("anchors"),
        flagged.alias("flagged"),
        F.count(F.when(F.col("transcript_index") < 0, F.lit(1))).alias("unmatched"),
    )
