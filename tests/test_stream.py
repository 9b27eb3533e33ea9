"""Restoring a stream gives what restoring the whole text gives, however it is cut."""

import json
import random

from pyspark.sql import functions as F

from veilmark.operators.masking import PLACEHOLDERS
from veilmark.streaming import restore

CHUNKS = "session_id string, stream_id string, seq long, chunk string, final boolean"
SESSIONS = f"session_id string, placeholders {PLACEHOLDERS}, ttl_seconds int"


def cut_up(text, r):
    at = sorted(r.sample(range(len(text) + 1), min(5, len(text))))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(1)
    known = [("<GR00:0001>", "Иван"), ("<GR00:0002>", "<x>")]
    texts = {f"t{i}": " ".join(r.choice(["<GR00:0001>", "<GR00:0002>", "word", "<", "<GR"]) for _ in range(12)) for i in range(6)}
    rows = []
    for stream, text in texts.items():
        parts = cut_up(text, r)
        rows += [("s" if stream != "t5" else "lost", stream, i, c, i == len(parts) - 1) for i, c in enumerate(parts)]
    r.shuffle(rows)
    (tmp_path / "in").mkdir()
    for k in range(2):
        lines = [json.dumps(dict(zip(("session_id", "stream_id", "seq", "chunk", "final"), x))) for x in rows[k::2]]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
    sessions = spark.createDataFrame([("s", known, 60)], SESSIONS)
    chunks = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = restore.restore_stream(chunks, sessions, expire=False).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    out = {}
    for x in spark.table("restored").orderBy("seq").collect():
        out[x["stream_id"]] = out.get(x["stream_id"], "") + x["output"]
    assert out == {k: t if k == "t5" else restore.restore(t, known)[0] for k, t in texts.items()}


def test_holdback():
    known = [("<GR:0001>", "a")]
    assert [restore.pending(t, known) for t in ("", "x<", "<GR:000", "<GR:0001>", "x")] == [0, 1, 7, 0, 0]


def test_flush(spark):
    df = spark.createDataFrame([("s", "a", 0, "x", False), ("s", "b", 0, "y", True)], CHUNKS)
    assert restore.flush_rows(df).where(F.col("final")).count() == 2
