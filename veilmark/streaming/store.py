"""Sessions as the state of a stream: stored, used by chunks, expired and deleted where the chunks are.

Events of a session are ``store`` (its placeholders and time to live), ``chunk`` (of one of its streams) and ``finalize``. State by session: the
session with the instant it expires, a map of its streams with the text each holds back and the instant that expires, the number of the next
event, and events that came early. Both lives are told by the events' own time, so that a replay gives the same output: a session lives for its
time to live from when it was stored last, a stream's text for as long from the stream's last chunk. Timers remove state that the watermark has passed.

A chunk that is not final holds back what may begin a placeholder. Without a live session it passes as it is, or is an error. A context is
deleted with a final chunk only, and goes with all streams of its session.

Events carry ``seq``, dense from 0 in each session, as rows of one batch have no order; one that is early waits for those before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from veilmark.streaming.restore import pending, restore

EVENTS = (
    "session_id string, seq long, at timestamp, kind string, stream_id string, chunk string, final boolean, delete_context boolean, "
    "placeholders array<struct<placeholder:string,original:string>>, ttl_seconds int"
)
OUTPUT = "session_id string, seq long, kind string, stream_id string, output string, replacements int, buffered_chars int, final boolean, context_found boolean, context_deleted boolean, error string"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
DEFAULT_TTL = 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class SessionStore(StatefulProcessor):
    def __init__(self, allow_missing: bool = True):
        self.allow_missing = allow_missing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "placeholders string, ttl_seconds long, expires long")
        self.streams = handle.getMapState("streams", "stream_id string", "buffer string, expires long")
        self.order = handle.getValueState("order", "due long")
        self.early = handle.getMapState("early", "seq long", "event string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        due = self.order.get()[0] if self.order.exists() else 0
        now: dict[int, dict] = {}
        for r in rows:
            if r["seq"] >= due:  # one that was handled already came twice
                now[r["seq"]] = {
                    "kind": r["kind"], "at": int(round(r["at"].timestamp() * 1000)), "stream_id": r["stream_id"], "chunk": r["chunk"] or "", "final": bool(r["final"]), "delete": bool(r["delete_context"]),
                    "placeholders": [(p["placeholder"], p["original"]) for p in r["placeholders"] or []], "ttl": int(DEFAULT_TTL if r["ttl_seconds"] is None else r["ttl_seconds"]),
                }
        while True:
            if due in now:
                event = now.pop(due)
            elif self.early.containsKey((due,)):
                event = json.loads(self.early.getValue((due,))[0])
                self.early.removeKey((due,))
            else:
                break
            out = self._handle(event)
            if out is not None:
                yield Row(*_NAMES)(key[0], due, event["kind"], event["stream_id"], *out)
            due += 1
        for seq, event in now.items():
            self.early.updateValue((seq,), (json.dumps(event),))
        self.order.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        self._clean(expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def _clean(self, now: int) -> None:
        """Removes what has expired; a session that was stored anew since the timer was set stays."""
        if self.session.exists() and self.session.get()[2] <= now:
            self.session.clear()
        for name, (_, expires) in [(k[0], v) for k, v in self.streams.iterator()]:
            if expires <= now:
                self.streams.removeKey((name,))

    def _drop_all(self) -> None:
        self.session.clear()
        self.streams.clear()

    def _handle(self, e: dict):
        """``(output, replacements, buffered_chars, final, context_found, context_deleted, error)``, or nothing for an event that tells nothing."""
        now = e["at"]
        if e["kind"] == "store":
            expires = now + e["ttl"] * 1000
            self.session.update((json.dumps(e["placeholders"]), e["ttl"], expires))
            self.handle.registerTimer(expires)
            return None
        stored = self.session.get() if self.session.exists() else None
        live = stored is not None and stored[2] > now
        if e["kind"] == "finalize":
            self._drop_all()
            return "", 0, 0, True, live, live, None
        chunk, final, delete = e["chunk"], e["final"], e["delete"]
        if delete and not final:
            return None, 0, 0, final, live, False, "a context is deleted with the final chunk only"
        if not live:
            if not self.allow_missing:
                return None, 0, 0, final, False, False, "missing or expired session"
            return chunk, 0, 0, final, False, False, None
        known, ttl = [tuple(p) for p in json.loads(stored[0])], stored[1]
        text, n, held = chunk, 0, ""
        if known:
            stream = (e["stream_id"],)
            before = self.streams.getValue(stream) if self.streams.containsKey(stream) else None
            text = (before[0] if before is not None and before[1] > now else "") + chunk
            keep = 0 if final else pending(text, known)
            held = text[len(text) - keep :]
            text, n = restore(text[: len(text) - keep], known)
            if not final:
                expires = now + ttl * 1000
                self.streams.updateValue(stream, (held, expires))
                self.handle.registerTimer(expires)
        if final and self.streams.containsKey((e["stream_id"],)):
            self.streams.removeKey((e["stream_id"],))
        if delete:
            self._drop_all()
        return text, n, len(held), final, True, delete, None


@contextmanager
def rocksdb(spark: SparkSession):
    """State stores that keep several values a key, for streams that are started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def session_stream(events: DataFrame, allow_missing: bool = True, lateness: str = "1 hour") -> DataFrame:
    """What a stream of ``EVENTS`` gives: a row for each chunk and each end of a session. Start it within ``rocksdb``.

    Events later than ``lateness`` behind the latest are dropped, and state goes once that long past its end.
    """
    marked = events.withWatermark("at", lateness)
    return marked.groupBy("session_id").transformWithState(SessionStore(allow_missing), StructType.fromDDL(OUTPUT), "Append", "EventTime")
