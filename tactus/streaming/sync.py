"""Keeping a player in step with its lines, as a state machine over events.

The same transition serves a batch of recorded sessions and a stream: each
session's state is its offset, the time of the last anchor and its last drifts.
Times come with the events (now_ms), never from the clock.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

ANCHOR_EVERY_MS, ANCHOR_CONFIDENCE, LEAST_DRIFT, HARD_DRIFT, SOFTNESS, KEPT, RELIABLE = 8000, 0.55, 0.05, 2.5, 0.15, 20, 1.5
OUT = "session_id bigint, now_ms bigint, kind string, drift double, correction double, shift double, reliable boolean"


@dataclass
class Session:
    offset: float = 0.0
    last_anchor_ms: float = -1e18
    drifts: list[float] = field(default_factory=list)

    def step(self, event: dict) -> dict:
        """Applies one event and reports.

        kind and now_ms; playback and line_start (seconds) of the active or
        reported line, whose drift from the shifted line start is taken; where
        they are missing, drift is used as it is. A tick needs confidence.
        """
        kind, correction = event["kind"], 0.0
        played, start = event.get("playback"), event.get("line_start")
        known = played is not None and start is not None and played == played and start == start
        drift = played - (start + self.offset) if known else (event.get("drift") or 0.0)
        due = event["now_ms"] - self.last_anchor_ms > ANCHOR_EVERY_MS and (event["confidence"] or 0) >= ANCHOR_CONFIDENCE
        if kind == "seek":
            self.drifts = []
        elif kind == "manual_anchor" or due:
            # every anchor is softened alike, unless the drift is hard; a small drift at a tick only renews the anchor
            if kind == "manual_anchor" or abs(drift) >= LEAST_DRIFT:
                correction = drift if abs(drift) > HARD_DRIFT else SOFTNESS * drift
                self.drifts = [*self.drifts, drift][-KEPT:]
                self.offset += correction
            self.last_anchor_ms = event["now_ms"]
        reliable = max(map(abs, self.drifts[-5:]), default=0.0) < RELIABLE
        return {"now_ms": event["now_ms"], "kind": kind, "drift": drift, "correction": correction, "shift": self.offset, "reliable": reliable}


def _run(session: Session, key: int, events: pd.DataFrame) -> pd.DataFrame:
    rows = [{"session_id": key} | session.step(e) for e in events.sort_values(["now_ms", "kind"]).to_dict("records")]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def batch(events: DataFrame) -> DataFrame:
    """Reports of recorded events (session_id, now_ms, kind, confidence and playback and line_start, or drift)."""
    return events.groupBy("session_id").applyInPandas(lambda key, pdf: _run(Session(), key[0], pdf), OUT)


def stream(events: DataFrame) -> DataFrame:
    """The same over a stream; a session's events must arrive in order."""

    def update(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session = Session(**json.loads(state.get[0])) if state.exists else Session()
        parts = list(frames)
        out = _run(session, key[0], pd.concat(parts)) if parts else None
        state.update((json.dumps(asdict(session)),))
        if out is not None:
            yield out

    return events.groupBy("session_id").applyInPandasWithState(update, OUT, "session string", "append", "NoTimeout")
