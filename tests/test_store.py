"""Sessions in the state of a stream against a plain store in memory."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from veilmark.streaming import restore, store

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


class PlainStore:
    """A store with keys that expire, and streams dropped with their session."""

    def __init__(self):
        self.sessions, self.streams = {}, {}

    def run(self, e):
        now, sid = e["at"], e["session_id"]
        if e["kind"] == "store":
            self.sessions[sid] = (e["placeholders"], e["ttl_seconds"], now + timedelta(seconds=e["ttl_seconds"]))
            return None
        live = sid in self.sessions and self.sessions[sid][2] > now
        if e["kind"] == "finalize":
            self.drop(sid)
            return ("", 0, 0, live, live, None)
        if e["delete_context"] and not e["final"]:
            return (None, 0, 0, live, False, "a context is deleted with the final chunk only")
        if not live:
            return (e["chunk"], 0, 0, False, False, None)
        known, ttl, _ = self.sessions[sid]
        key, out = (sid, e["stream_id"]), (e["chunk"], 0, 0)
        if known:
            held, end = self.streams.get(key, ("", now))
            text = (held if end > now else "") + e["chunk"]
            n = 0 if e["final"] else restore.pending(text, known)
            self.streams[key] = (text[len(text) - n :], now + timedelta(seconds=ttl))
            out = (*restore.restore(text[: len(text) - n], known), n)
        if e["final"]:
            self.streams.pop(key, None)
        if e["delete_context"]:
            self.drop(sid)
        return (*out, True, e["delete_context"], None)

    def drop(self, sid):
        self.sessions.pop(sid, None)
        for key in [k for k in self.streams if k[0] == sid]:
            del self.streams[key]


def made(r, sid, n):
    known = [("<GR:0001>", "one"), ("<GR:0002>", "<GR:0001> two")] if r.random() < 0.8 else []
    now, out = START, []
    for seq in range(n):
        now += timedelta(seconds=r.choice([0, 1, 3, 9]))
        kind = "store" if seq == 0 and r.random() < 0.8 else r.choice(["store", *["chunk"] * 9, "finalize"])
        chunk = r.choice(["x <GR:0", "001> y", "<GR:0002>", "<", "GR:0001>", "", "plain"])
        final = r.random() < 0.3
        out.append({
            "session_id": sid, "seq": seq, "at": now, "kind": kind, "stream_id": r.choice("ab"), "chunk": chunk if kind == "chunk" else None, "final": final,
            "delete_context": r.random() < (0.2 if final else 0.05), "placeholders": known if kind == "store" else None, "ttl_seconds": r.choice([5, 12, 600]) if kind == "store" else None,
        })
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_against_a_plain_store(spark, tmp_path, files):
    r = random.Random(files)
    events = [e for k in range(12) for e in made(r, f"s*{k}", 30)]
    expected = defaultdict(list)
    plain = PlainStore()
    for e in events:
        if (out := plain.run(e)) is not None:
            expected[e["session_id"]].append((e["seq"], e["stream_id"], *out))
    rows = [{**e, "at": e["at"].isoformat(), "placeholders": [{"placeholder": p, "original": o} for p, o in e["placeholders"]] if e["placeholders"] is not None else None} for e in events]
    r.shuffle(rows)
    (tmp_path / "in").mkdir()
    for k in range(files):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k::files] + rows[:3])))  # some come twice
    stream = spark.readStream.schema(store.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    with store.rocksdb(spark):
        q = store.session_stream(stream, lateness="1 day").writeStream.format("memory").queryName(f"store{files}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    got = defaultdict(list)
    for x in spark.table(f"store{files}").orderBy("session_id", "seq").collect():
        got[x["session_id"]].append((x["seq"], x["stream_id"], x["output"], x["replacements"], x["buffered_chars"], x["context_found"], x["context_deleted"], x["error"]))
    assert got == expected
    errors = {x[-1] for xs in got.values() for x in xs}
    assert None in errors and len(errors) == 2


def test_missing_sessions_are_errors_if_not_allowed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"session_id": "s", "seq": 0, "at": START.isoformat(), "kind": "chunk", "stream_id": "a", "chunk": "x", "final": True}))
    stream = spark.readStream.schema(store.EVENTS).json(str(tmp_path / "in"))
    with store.rocksdb(spark):
        q = store.session_stream(stream, allow_missing=False).writeStream.format("memory").queryName("missing").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert [(x["output"], x["error"]) for x in spark.table("missing").select("output", "error").where(F.lit(True)).collect()] == [(None, "missing or expired session")]
