"""Token-ID / binary output: ORC files of integer runs with row indexes and Bloom filters.

``write_tokens`` encodes every whole text and writes ``(doc_id, n_tokens, row_start, part, tokens)`` in
ascending document order. ORC stores ``tokens`` with its integer run-length encoding; stripes are read in
parallel, row indexes hold minima and maxima of ``doc_id`` per stride, and a Bloom filter on ``doc_id`` lets a
reader skip strides (``read_tokens(..., doc_ids=[...])`` pushes the predicate into the scan).

The only exchange is the range partitioning of the texts, by ``doc_id`` and then by a hash of the text, so
that rows of one hot id spread too. ``row_start`` counts ids within the file; the sum over the files before
it is added on reading, from one small aggregate over the pruned ``n_tokens`` column.

Defined cases: null or empty text gives only the end id; null ``doc_id`` sorts first; rows of equal ``doc_id`` are ordered by a hash of their text, and
repeated rows each give a row; very long texts are one row of as many ids; an empty table gives an empty folder and no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read_table, shared_dir, text_or_empty
from veilmark.llm.tokens import default_vocabulary, encoder

FILE_SCHEMA = "doc_id long, n_tokens long, row_start long, part int, tokens array<int>"
END_ID = 2
MEMO_ENTRIES = 450_000  # chunks in each of the two generations that a worker remembers
SLICE = 16  # documents that are encoded and written together


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, stripe_mb: int = 64, stride: int = 2_000, memo: int = MEMO_ENTRIES) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the ORC files below ``path``."""
    tail = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, start = encoder(vocabulary, memo).ids_of, TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                rows = [x + tail for x in ids_of(piece.column("text").to_pylist())]
                n = np.array([len(r) // 4 for r in rows], dtype=np.int64)
                ends = np.cumsum(n)
                tokens = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), dtype="<i4"))
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n), pa.array(start + ends - n), pa.array(np.full(len(rows), part, np.int32)), tokens],
                    names=["doc_id", "n_tokens", "row_start", "part", "tokens"],
                )
                start += int(ends[-1])

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids``, strides and stripes without them are skipped."""
    df = spark.read.schema(FILE_SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: where it starts among all ids, its number of ids and their CRC-32."""
    totals = (
        spark.read.schema(FILE_SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    )  # a row per file
    before, base = 0, {}
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = before
        before += r["n"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            at = lists.offsets.to_numpy().astype(np.int64)
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            first = np.array([base[p] for p in batch.column("part").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(first + batch.column("row_start").to_numpy()), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return (
        spark.read.schema(FILE_SCHEMA)
        .orc(path)
        .select("doc_id", "row_start", "part", "tokens")
        .mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "op1-token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), path, default_vocabulary())
    return digests(spark, path)
