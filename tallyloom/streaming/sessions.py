"""Which sessions are served, idle or tried again, kept as state by session id, with timers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

# Fixed value: tries of a session that cannot be read before it is given up.
MOST_TRIES = 5
_STATE = "path string, state string, tries int, since_ms long, seen_ms long, pending boolean, uncounted boolean"
_OUT = f"session_id string, {_STATE}"


@dataclass(frozen=True)
class Record:
    """What is held of a session: where its transcript lies now, its state and since when, tries of a reading that failed, and whether it ever held a cost that no line counts."""

    path: str | None = None
    state: str = "new"
    tries: int = 0
    since_ms: int = 0
    seen_ms: int = 0
    pending: bool = False
    uncounted: bool = False


def observed(held: Record, path: str, at_ms: int, readable: bool, uncounted: bool) -> Record:
    """After an observation. A session that moved goes on under its new path; ``uncounted``, once set, stays.

    One that can be read is served, and its tries are forgotten. One that cannot is tried
    again, unless a try is pending already; beyond MOST_TRIES it is given up.
    """
    held = replace(held, path=path, seen_ms=max(at_ms, held.seen_ms), uncounted=held.uncounted or uncounted)
    if readable:
        return replace(held, state="served", tries=0, pending=False, since_ms=held.since_ms if held.state == "served" else at_ms)
    if held.pending:
        return held
    if held.tries >= MOST_TRIES:
        return replace(held, state="given-up", tries=0, since_ms=at_ms)
    return replace(held, state="retrying", tries=held.tries + 1, pending=True, since_ms=at_ms)


def struck(held: Record, now_ms: int, idle_ms: int, forget_ms: int) -> Record | None:
    """After a timer: a pending try falls due; a session unseen for ``idle_ms`` is idle since it was seen last; None for one to forget."""
    if held.state == "retrying" and held.pending:
        return replace(held, pending=False)
    if held.state == "served" and now_ms - held.seen_ms >= idle_ms:
        return replace(held, state="idle", since_ms=held.seen_ms)
    if held.state in ("idle", "given-up", "retrying") and now_ms - held.seen_ms >= idle_ms + forget_ms:
        return None
    return held


class SessionStates(StatefulProcessor):
    def __init__(self, idle_ms: int, forget_ms: int, retry_ms: int) -> None:
        self.idle_ms, self.forget_ms, self.retry_ms = idle_ms, forget_ms, retry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", _STATE)

    def close(self) -> None:
        pass

    def _get(self) -> Record:
        return Record(*self.held.get()) if self.held.exists() else Record()

    def _keep(self, key, now: Record, now_ms: int) -> pd.DataFrame:
        self.held.update(tuple(asdict(now).values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait = self.retry_ms if now.pending else self.idle_ms if now.state == "served" else self.forget_ms
        self.handle.registerTimer(now_ms + wait)
        return self._said(key, now)

    @staticmethod
    def _said(key, now: Record) -> pd.DataFrame:
        return pd.DataFrame([{"session_id": key[0], **asdict(now)}]).astype({"session_id": "object", "path": "object", "state": "object", "tries": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = now = self._get()
        # arrival is what counts for timers; the observations' own times may lie in the past
        for r in pd.concat(list(rows)).sort_values(["seen_ms", "path"]).to_dict("records"):
            now = observed(now, r["path"], int(r["seen_ms"]), bool(r["readable"]), bool(r["uncounted"]))
        told = self._keep(key, now, timerValues.getCurrentProcessingTimeInMs())
        if now != before:
            yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, now_ms = self._get(), timerValues.getCurrentProcessingTimeInMs()
        now = struck(before, max(now_ms, before.seen_ms), self.idle_ms, self.forget_ms)
        if now is None:
            self.held.clear()
            yield self._said(key, replace(before, state="forgotten", pending=False))
            return
        told = self._keep(key, now, now_ms)
        if now != before:
            yield told


def session_states(observations: DataFrame, idle_ms: int = 120_000, forget_ms: int = 24 * 3600 * 1000, retry_ms: int = 1_000) -> DataFrame:
    """Changes of state of the sessions in a stream of observations (session_id, path, seen_ms, readable, uncounted), by timers of processing time.

    Output: session_id, path, state (served, idle, retrying, given-up, forgotten), tries,
    since_ms, seen_ms, pending, uncounted, a row a change. A session's rows of one
    micro-batch count in the order of their times. Needs the RocksDB state store.
    """
    return observations.groupBy("session_id").transformWithStateInPandas(SessionStates(idle_ms, forget_ms, retry_ms), _OUT, "Update", "ProcessingTime")
