"""Restoring a stream of chunks in which a placeholder may be cut in two.

State per (session, stream): the text held back, chunks that came before their turn, and the number of the next one. Rows of one
micro-batch are not ordered, so chunks carry ``seq``; one that is early waits in the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilmark.operators.masking import PLACEHOLDERS

OUTPUT = "session_id string, stream_id string, seq long, output string, replacements int, buffered_chars int, final boolean, context_found boolean"
STATE = "buffer string, next long, waiting array<struct<seq:long,chunk:string,final:boolean>>"


def restore(text: str, placeholders: list[tuple[str, str]]) -> tuple[str, int]:
    n = 0
    for p, original in sorted(placeholders, key=lambda x: -len(x[0])):
        n += text.count(p)
        text = text.replace(p, original)
    return text, n


def pending(text: str, placeholders: list[tuple[str, str]]) -> int:
    """Characters at the end that may be the beginning of a placeholder."""
    longest = max((len(p) for p, _ in placeholders), default=0)
    return next((n for n in range(min(longest - 1, len(text)), 0, -1) if any(p.startswith(text[-n:]) for p, _ in placeholders)), 0)


def _process(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, expire: bool) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    buffer, due, waiting = state.get if state.exists else ("", 0, [])
    queue = {w["seq"] if not isinstance(w, tuple) else w[0]: (w["chunk"], w["final"]) if not isinstance(w, tuple) else (w[1], w[2]) for w in (waiting if waiting is not None else [])}
    known, ttl = None, 3600
    for f in frames:
        for r in f.itertuples(index=False):
            queue[int(r.seq)] = (r.chunk or "", bool(r.final))
            if r.placeholders is not None:
                known = [(p["placeholder"], p["original"]) for p in r.placeholders]
                ttl = int(r.ttl_seconds)
    rows, ended = [], False
    while due in queue and not ended:
        chunk, final = queue.pop(due)
        if not known:  # no session, or one without placeholders: the chunk passes as it is
            text, n, held = buffer + chunk, 0, ""
        else:
            text = buffer + chunk
            keep = 0 if final else pending(text, known)
            held = text[len(text) - keep :]
            text, n = restore(text[: len(text) - keep], known)
        buffer, ended = held, final
        rows.append((*key, due, text, n, len(buffer), final, known is not None))
        due += 1
    if ended:
        state.remove()
    else:
        state.update((buffer, due, [(s, c, f) for s, (c, f) in sorted(queue.items())]))
        if expire:
            state.setTimeoutDuration(ttl * 1000)
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def restore_stream(chunks: DataFrame, sessions: DataFrame, expire: bool = True) -> DataFrame:
    """The stream ``chunks(session_id, stream_id, seq, chunk, final)`` restored with the (static) sessions.

    With ``expire``, a stream's state goes when no chunk came for its session's time to live. Spark then keeps running empty
    batches to look for such states, so a run over what is available now, which is to end, asks for none.
    """
    known = sessions.select("session_id", F.col("placeholders").cast(PLACEHOLDERS), "ttl_seconds")
    joined = chunks.join(known, "session_id", "left").withColumn("ttl_seconds", F.coalesce("ttl_seconds", F.lit(3600)))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    process = partial(_process, expire=expire)
    return joined.groupBy("session_id", "stream_id").applyInPandasWithState(lambda k, f, s: process(k, f, s), OUTPUT, STATE, "append", timeout)


def flush_rows(chunks: DataFrame) -> DataFrame:
    """A final empty chunk after the last of each stream that has none, for batches of chunks whose upstream has ended."""
    ends = chunks.groupBy("session_id", "stream_id").agg(F.max("seq").alias("seq"), F.max("final").alias("_f")).where("not _f")
    return chunks.unionByName(ends.select("session_id", "stream_id", (F.col("seq") + 1).alias("seq"), F.lit("").alias("chunk"), F.lit(True).alias("final")))


def checked_requests(requests: DataFrame, sessions: DataFrame, allow_missing: bool = True) -> DataFrame:
    """``requests(session_id, stream_id, seq, chunk, final, transforms, delete_context)`` with ``error``, null if they may be streamed.

    A stream has exactly one transform, which restores; it names its session; a context is deleted with the final chunk only; and, unless
    missing sessions are allowed, its session is known.
    """
    known = sessions.select(F.col("session_id").alias("_sid")).distinct()
    df = requests.join(known, F.col("session_id") == F.col("_sid"), "left")
    error = (
        F.when(F.size("transforms") != 1, "exactly one transform is needed")
        .when(F.get("transforms", F.lit(0)) != "REIDENTIFY", "only REIDENTIFY can be streamed")
        .when(F.coalesce(F.trim("session_id"), F.lit("")) == "", "a session id is needed")
        .when(F.col("delete_context") & ~F.col("final"), "a context is deleted with the final chunk only")
    )
    if not allow_missing:
        error = error.when(F.col("_sid").isNull(), "missing or expired session")
    return df.withColumn("error", error).drop("_sid")


def ended_sessions(requests: DataFrame) -> DataFrame:
    """Sessions whose context goes: those of a final chunk that asks for it."""
    return requests.where("error IS NULL AND final AND delete_context").select("session_id").distinct()
