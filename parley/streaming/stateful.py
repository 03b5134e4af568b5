"""Keyed state of live meetings: open rows that windows may still refine, and sessions that end by themselves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.operators import reconcile as rc

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their variables in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# ---- the refined transcript ------------------------------------------------------------------

OPEN = "row_id long, start_ms long, end_ms long, text string, words string"
SEEN = "rows long, newest long"
REFINED = OPEN + ", closed boolean"


class RefineBuffer(StatefulProcessor):
    """A window refines the open row it mostly overlaps, or opens one.

    A row is closed, given out for the last time and forgotten, once it ends before anything that may still come:
    windows come at most `late_ms` behind the newest start.  So the state holds the rows of the last moments only,
    however long the meeting is, and a batch gives out only the rows it has changed or closed.  A window that comes
    later than that opens a row of its own.
    """

    def __init__(self, late_ms: int, keys: int):
        self.late_ms, self.keys = late_ms, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", OPEN)
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, newest = self.seen.get() if self.seen.exists() else (0, -(2**62))
        live = [[s, e, t, json.loads(w), n] for n, s, e, t, w in self.open.get()] if self.open.exists() else []
        live.sort(key=lambda r: (r[0], r[4]))
        changed: dict[int, list] = {}
        got = pd.concat(list(rows)).sort_values("window_id", kind="stable")
        for s, e, text, words in zip(got["start_ms"], got["end_ms"], got["text"], got["words"]):
            s, e, text = int(s), int(e), (text or "").strip()
            if not text:
                continue
            newest = max(newest, s)
            done = [r for r in live if r[1] <= newest - self.late_ms]
            live = [r for r in live if r[1] > newest - self.late_ms]
            changed |= {r[4]: [*r, True] for r in done}
            words = [[w["word"], int(w["start_ms"]), int(w["end_ms"])] for w in words]
            hit = rc.best_overlap(live, s, e)
            if hit is None:
                hit = [s, e, text, words, count]
                live.append(hit)
                count += 1
            else:
                rc.refine(hit, s, e, text, words)
            live.sort(key=lambda r: r[0])
            changed[hit[4]] = [*hit, False]
        self.seen.update((count, newest))
        self.open.clear()
        if live:
            self.open.put([(n, s, e, t, json.dumps(w, ensure_ascii=False)) for s, e, t, w, n in live])
        data = [(*key, n, s, e, t, json.dumps(w, ensure_ascii=False), closed) for s, e, t, w, n, closed in changed.values()]
        names = [f"k{i}" for i in range(self.keys)] + [f.split()[0] for f in REFINED.split(", ")]
        yield pd.DataFrame(data, columns=names)

    def close(self) -> None:
        pass


def refined_rows(windows: DataFrame, keys: list[str], late_ms: int = 0) -> DataFrame:
    """(keys, row_id, start_ms, end_ms, text, words, closed): rows of live transcripts, each time they change.

    `windows` has start_ms, end_ms, text, words and window_id, in which order they are taken.
    """
    use_rocksdb(windows.sparkSession)
    fields = [T.StructField(f"k{i}", windows.schema[k].dataType) for i, k in enumerate(keys)]
    out = T.StructType(fields + list(T._parse_datatype_string(REFINED).fields))
    found = windows.groupBy(*keys).transformWithStateInPandas(RefineBuffer(late_ms, len(keys)), out, "Update", "None")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[f.split()[0] for f in REFINED.split(", ")])


# ---- sessions that end ------------------------------------------------------------------------

STARTED = "started_ms long, last_ms long, gone_ms long, events long"
SESSION = "meeting_id string, started_ms long, ended_ms long, reason string, n_events long"


class Sessions(StatefulProcessor):
    """A meeting's session from its first activity to a stop, or until nobody has come back for `grace_ms`.

    `gone_ms` is when the last client left, or -1.  Leaving sets a timer; coming back removes it.  The timer runs on
    the clock, or with `event_time` on the watermark, so that a replayed log ends sessions as the live one did.  An
    event that comes after a deadline within one batch ends the session first.
    """

    def __init__(self, grace_ms: int, event_time: bool):
        self.grace_ms, self.event_time = grace_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STARTED)

    def _closed(self, key, session: list, at: int, reason: str) -> tuple:
        return (key[0], session[0], at, reason, session[3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = list(self.state.get()) if self.state.exists() else None
        waited = session[2] if session else -1
        clock = 0 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        out = []
        got = pd.concat(list(rows)).sort_values(["at_ms", "event_id"], kind="stable")
        for at, command in zip(got["at_ms"].tolist(), got["command"].tolist()):
            if session and session[2] >= 0 and self.event_time and at > session[2] + self.grace_ms:
                out.append(self._closed(key, session, session[2] + self.grace_ms, "left"))
                session = None
            if session is None:
                if command != "active":
                    continue
                session = [at, at, -1, 0]
            session[1], session[3] = at, session[3] + 1
            session[2] = (at if self.event_time else clock) if command == "left" else -1
            if command == "stop":
                out.append(self._closed(key, session, at, "stop"))
                session = None
        gone = session[2] if session else -1
        if waited >= 0 and gone != waited:
            self.handle.deleteTimer(waited + self.grace_ms)
        if gone >= 0 and gone != waited:
            self.handle.registerTimer(gone + self.grace_ms)
        if session:
            self.state.update(tuple(session))
        else:
            self.state.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session = self.state.get() if self.state.exists() else None
        out = []
        if session and session[2] >= 0 and session[2] + self.grace_ms <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._closed(key, list(session), session[2] + self.grace_ms, "left"))
            self.state.clear()
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[f.split()[0] for f in SESSION.split(", ")]).astype({"meeting_id": object, "started_ms": "int64", "ended_ms": "int64", "reason": object, "n_events": "int64"})

    def close(self) -> None:
        pass


def ended_sessions(control: DataFrame, grace_ms: int, event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """(meeting_id, started_ms, ended_ms, reason, n_events) of each session, when it ends.

    `control` is a stream of meeting_id, at (timestamp), at_ms, event_id and command: `active`, `left` (the last client
    is gone) or `stop`.  With `event_time`, timers follow the watermark of `at`; otherwise the clock.
    """
    use_rocksdb(control.sparkSession)
    if event_time:
        control = control.withWatermark("at", delay)
    mode = "EventTime" if event_time else "ProcessingTime"
    return control.groupBy("meeting_id").transformWithStateInPandas(Sessions(grace_ms, event_time), SESSION, "Append", mode)
