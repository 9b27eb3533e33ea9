"""Best-fit packing with vector capacities: tokens, documents and attention cost of a sequence.

A piece of ``L`` tokens asks for the vector ``(L, 1, L * L)``; a sequence offers ``(tokens, pieces, cost)``. Pieces of
one length are alike, so the packing is decided on the histogram of lengths, of at most ``tokens`` rows whatever
the number of documents: lengths come in descending order, and each goes to the open sequences that can take it under
every constraint and score best, by weighted residual norm (least is best) or by weighted dot product of demand
and residual (greatest is best). Open sequences with equal residuals are alike too and are filled together. The
result is a list of runs: pieces ``a`` to ``b`` of length ``L`` go to sequences ``s`` onwards, ``k`` in each, at one offset.

Pieces get their number within their length without a sort: each writing task numbers its own, and the counts by
(length, task) are summed by a window per length over tasks. A hot length (full pieces) is thus no hot task:
its rows stay where they were written, and only counts meet.

Defined cases: null text is empty and gives one piece, the end id; only documents of more ids than ``tokens`` are cut, and very long ones
into as many pieces as they need; pieces of equal length are alike, so ties need no order; repeated rows are packed each; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilmark.llm.common import read_table, text_or_empty, written
from veilmark.llm.tokens import MEMO_ENTRIES, default_vocabulary, encoder

TOKENS = 2048
END_ID = 0
#: Weights of the residual's coordinates (each as a share of its capacity) in the score.
WEIGHTS = (1.0, 1e-3, 1e-3)


def cut(docs: DataFrame, vocabulary: str, tokens: int = TOKENS, end_id: int = END_ID, with_ids: bool = False, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32, task, nth)``, ``nth`` among the task's pieces of that length; ids too if asked."""
    tail = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = encoder(vocabulary, memo).ids_of, TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                out: list[list] = [[] for _ in names]
                for doc, ids in zip(rows.column("doc_id").to_pylist(), ids_of(rows.column("text").to_pylist())):
                    ids += tail
                    for k, first in enumerate(range(0, len(ids), 4 * tokens)):
                        own = ids[first : first + 4 * tokens]
                        n = len(own) // 4
                        for col, x in zip(out, (doc, k, first // 4, n, zlib.crc32(own), task, int(seen[n]), own)):
                            col.append(x)
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(pieces, schema)


def plan(counts: dict[int, int], capacity: tuple[int, int, float], rule: str = "norm", weights=WEIGHTS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first, last + 1, first sequence, pieces in each sequence, offset)`` for ``counts`` pieces by length.

    Piece ``i`` of a run goes to sequence ``s + (i - a) // k`` at ``offset + (i - a) % k * length``.
    """
    cap = np.array(capacity, dtype=np.float64)
    weight = np.asarray(weights, dtype=np.float64)
    residual = np.empty((0, 3))  # by class of alike open sequences
    classes: list[tuple[int, int, int]] = []  # (first sequence, how many, tokens used)
    runs, fresh = [], 0
    for length in sorted(counts, reverse=True):
        left, at = counts[length], 0
        need = np.array([length, 1.0, float(length) ** 2])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        while left:
            fits = (residual >= need).all(axis=1) if len(classes) else np.zeros(0, bool)
            if fits.any():
                share = (residual[fits] - need) / cap if rule == "norm" else residual[fits] / cap
                score = -np.sqrt((weight * share**2).sum(axis=1)) if rule == "norm" else (weight * share * (need / cap)).sum(axis=1)
                j = int(np.flatnonzero(fits)[score.argmax()])
                first, n, used = classes[j]
                room = residual[j]
            else:
                j, n, used, first, room = -1, 0, 0, fresh, cap
            each = int(min(room[0] // length, room[1], room[2] // need[2]))
            if j < 0:
                n = max(1, left // each)
            if left >= each * n or j < 0 and left >= each:
                take = min(n, left // each)
            else:  # fewer pieces than would fill every sequence of the class
                take = left // each
                if take == 0:
                    each, take = left, 1
            if j < 0 and left < each:
                each, take = left, 1
            runs.append((length, at, at + each * take, first, each, used))
            after = room - each * need
            if j < 0:
                fresh += take
            elif take < n:
                classes[j] = (first + take, n - take, used)
            else:
                classes.pop(j)
                residual = np.delete(residual, j, axis=0)
            if after[0] >= 1 and after[1] >= 1 and after[2] >= 1:
                classes.append((first, take, used + each * length))
                residual = np.vstack([residual, after])
            at += each * take
            left -= each * take
    return runs


def pack(docs: DataFrame, vocabulary: str, tokens: int = TOKENS, max_pieces: int | None = None, max_cost: float | None = None, rule: str = "norm", end_id: int = END_ID, with_ids: bool = False, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. Without limits of their own, pieces and cost are bounded by the tokens alone."""
    spark = docs.sparkSession
    rows = written(cut(docs, vocabulary, tokens, end_id, with_ids, memo), "pieces")
    by_task = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = written(by_task.select("length", "task", "n", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    runs = plan(counts, (tokens, max_pieces or tokens, max_cost or float(tokens) ** 2), rule)
    by_length: dict[int, tuple] = {}
    for length in counts:
        own = np.array(sorted(r[1:] for r in runs if r[0] == length), dtype=np.int64)
        by_length[length] = tuple(own.T)
    shared = spark.sparkContext.broadcast(by_length)  # at most a few runs per length and residual: bounded by tokens squared

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                pick = np.flatnonzero(length == n)
                first, _, start, each, used = table[int(n)]
                k = np.searchsorted(first, rank[pick], side="right") - 1
                i = rank[pick] - first[k]
                seq[pick], off[pick] = start[k] + i // each[k], used[k] + i % each[k] * n
            own = [c for c in batch.schema.names if c not in ("before", "nth", "task")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(seq), pa.array(off)], names=[*own, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    order = [f.split()[0] for f in schema.split(", ")][:-2]
    # the counts grow with the number of tasks, so they are not broadcast
    before = by_task.select("length", "task", "before").hint("merge")
    return rows.join(before, ["length", "task"]).select(*order, "nth", "before").mapInArrow(place, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(read_table(spark, sf_dir, "documents"))


def packed_rows(docs: DataFrame, memo: int = MEMO_ENTRIES) -> DataFrame:
    out = pack(docs, default_vocabulary(), memo=memo)
    return out.withColumn("length", F.col("length").cast("long"))
