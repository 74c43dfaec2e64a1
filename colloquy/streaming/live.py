"""Streaming forms of the incremental metrics (ST-01 to ST-05).

Input streams carry an event-time column ``ts`` (timestamp). Late rows beyond the
watermark are dropped by the engine and counted in its progress.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIVE = "session_id long, role string, start_s double, end_s double, n_turns long, mean_turn_s double, n_exchanges long"
STATE = "value string"


class Turns:
    """The open ends of a session's turns: both merges of ``aggregate_turns``, row by row in order of time."""

    def __init__(self, max_pause_s: float, turn_min_s: float, max_gap_s: float, saved: str | None = None):
        self.max_pause_s, self.turn_min_s, self.max_gap_s = max_pause_s, turn_min_s, max_gap_s
        # rows ahead of the watermark; open island of each merge; last turn; counts; time at which all is closed
        self.waiting, self.first, self.second, self.last, self.n, self.total, self.exchanges, self.close_ms = (
            json.loads(saved) if saved else ([], None, None, None, 0, 0.0, 0, 0)
        )
        self.out: list[tuple] = []

    def saved(self) -> str:
        return json.dumps([self.waiting, self.first, self.second, self.last, self.n, self.total, self.exchanges, self.close_ms])

    def _join(self, island, role: str, start: float, end: float):
        """The island with the row in it, or None where the row opens a new one."""
        if island and island[0] == role and start - island[2] <= self.max_pause_s:
            return [role, island[1], max(island[2], end)]
        return None

    def _close_first(self) -> None:
        island, self.first = self.first, None
        if not island or island[2] - island[1] < self.turn_min_s:
            return
        joined = self._join(self.second, *island)
        if joined is None:
            self._close_second()
        self.second = joined or island

    def _close_second(self) -> None:
        turn, self.second = self.second, None
        if not turn:
            return
        role, start, end = turn
        if self.last and self.last[0] != role and 0 < start - self.last[1] <= self.max_gap_s:
            self.exchanges += 1
        self.n, self.total, self.last = self.n + 1, self.total + end - start, [role, end]
        self.out.append((role, start, end, self.n, self.total / self.n, self.exchanges))

    def advance(self, watermark_ms: int, scale: float) -> None:
        """Apply the rows that no later row can precede; close what no later row can extend."""
        ready = sorted(r for r in self.waiting if r[3] <= watermark_ms)
        self.waiting = [r for r in self.waiting if r[3] > watermark_ms]
        for start, end, role, ts in ready:
            joined = self._join(self.first, role, start, end)
            if joined is None:
                self._close_first()
            self.first = joined or [role, start, end]
            self.close_ms = max(self.close_ms, ts + math.ceil((end - start + self.max_pause_s) * 1000 * scale))
        if watermark_ms > self.close_ms:
            self._close_first()
            self._close_second()

    def wake_ms(self) -> int | None:
        """When the watermark has something to do here."""
        times = [r[3] for r in self.waiting] + ([self.close_ms + 1] if self.first or self.second else [])
        return min(times, default=None)


def live_turns(
    segments: DataFrame, max_pause_s: float = 3.0, turn_min_s: float = 1.0, max_gap_s: float = 2.0, watermark: str = "10 minutes", scale: float = 1.0,
) -> DataFrame:
    """ST-01: closed turns of ``aggregate_turns`` with running counts per session.

    ``ts`` is the event time of ``start_s``; ``scale`` event-time seconds pass in a second of
    the recording. Rows wait in the state until the watermark has passed them and are then
    applied in order, so the turns do not depend on how the rows were cut into batches. A
    turn closes when the next row does not extend it, or when the watermark rules such a row
    out. What the last watermark has not passed is not emitted: to flush a bounded source,
    send one row of another session whose ``ts`` lies far ahead. The state holds the rows
    within the watermark's delay, two open turns and four counters.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns = Turns(max_pause_s, turn_min_s, max_gap_s, state.get[0] if state.exists else None)
        if not state.hasTimedOut:
            for b in batches:
                turns.waiting += [
                    [float(x), float(y), r, int(t.timestamp() * 1000)]
                    for r, x, y, t in zip(b["role"], b["start_s"], b["end_s"], b["ts"])
                ]
        now = state.getCurrentWatermarkMs()
        turns.advance(now, scale)
        state.update((turns.saved(),))
        if (wake := turns.wake_ms()) is not None:
            state.setTimeoutTimestamp(max(wake, now + 1))
        if turns.out:
            yield pd.DataFrame([(key[0], *t) for t in turns.out], columns=[f.split()[0] for f in LIVE.split(", ")])

    s = segments.select("session_id", "role", "start_s", "end_s", "ts").where("start_s is not null and end_s is not null and role is not null")
    return s.withWatermark("ts", watermark).groupBy("session_id").applyInPandasWithState(step, LIVE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def window_means(samples: DataFrame, keys: Sequence[str], cols: Sequence[str], win: str, step: str, watermark: str) -> DataFrame:
    """ST-02: windowed means of each signal; windows that the watermark has not closed are not emitted."""
    w = samples.withWatermark("ts", watermark).groupBy(F.window("ts", win, step), *keys)
    a = w.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in cols])
    return a.select(*keys, F.col("window.start").alias("t_start"), F.col("window.end").alias("t_end"), "n", *[f"{c}_mean" for c in cols])


def activity_sessions(samples: DataFrame, keys: Sequence[str], gap: str, watermark: str) -> DataFrame:
    """ST-03: bursts of activity separated by at least ``gap``; the open ones are not emitted."""
    w = samples.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("session_window.start").alias("t_start"), F.col("session_window.end").alias("t_end"), "n")


def gaze_before_speech(onsets: DataFrame, looks: DataFrame, tau: str, watermark: str) -> DataFrame:
    """ST-04: looks that end up within ``tau`` before a speech onset of the same role."""
    a = onsets.select("session_id", "role", F.col("ts").alias("onset_ts")).withWatermark("onset_ts", watermark)
    b = looks.select(F.col("session_id").alias("_s"), F.col("role").alias("_r"), "target", F.col("ts").alias("look_ts")).withWatermark("look_ts", watermark)
    on = (F.col("session_id") == F.col("_s")) & (F.col("role") == F.col("_r")) & (F.col("look_ts") < F.col("onset_ts")) & (F.col("look_ts") >= F.col("onset_ts") - F.expr(f"INTERVAL {tau}"))
    return a.join(b, on).drop("_s", "_r")


def dedup(samples: DataFrame, keys: Sequence[str], watermark: str) -> DataFrame:
    """ST-05: rows repeated by overlapping recordings, once."""
    return samples.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
