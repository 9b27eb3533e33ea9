"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Test strings are the windows of ``window`` consecutive words of each benchmark item (an item of fewer words
is one string). The text's words are its symbols. For the strings of one length ``m``, the shift table
maps each block of ``B`` consecutive words in any string to the least distance of its end from the string's
end; a block in no string lets the search skip ``m - B + 1`` words. At shift 0 the block is a suffix and
selects a bucket, in which the whole string is compared directly with the text. Strings of each length have
their own tables, so that short items do not shorten the skips of the others.

The benchmark is cut into blocks of about ``block_chars`` characters, so that what is broadcast and the tables of a worker (``TABLE_BYTES`` at
the measured ``BYTES_A_CHAR``) are bounded however large the benchmark is; a worker builds a block's tables once. One block is one
pass over the documents without any shuffle. With more of them the documents are written once with row numbers; each block is a pass of its
own that tells the rows that it hits, and its broadcast goes when the pass has ended.

Defined cases: null text has no words and no hits; an item without words is no test string; an item with null ``item_id``
gives hits as any other, so its documents are contaminated, but no id, so it is neither in ``n_items`` nor in ``items_sha256`` (as with
``count(DISTINCT)`` in SQL); items with equal windows are each counted; repeated documents each give a row; an empty benchmark leaves every document
clean; very long texts are searched whole; an item that is longer than a block is a block of its own; other columns of either table are ignored.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import CACHES, free_names, give_back, read_table, release_caches, shielded, written

#: Bytes that end words: U+0000-2F, U+003A-60 (after lower-casing) and U+007B-7F; A-Z are lower-cased.
_CLASS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)
WINDOW = 10
BYTES_A_CHAR = 85  # at most while tables are built (57 after that), measured on documents and on words that are all different
TABLE_BYTES = 160 << 20
BLOCK_CHARS = TABLE_BYTES // BYTES_A_CHAR
BROADCAST_HITS = 200_000  # rows, of hits in some blocks; beyond that Spark chooses the join


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLASS).split()


class WuManber:
    """Tables for test strings of one length ``m``: starts in ``flat``, the items' words one after the other, with each one's items."""

    def __init__(self, flat: list[bytes], starts: list[int], items: list[int | None], m: int):
        self.m, self.b, self.flat = m, min(2, m), flat
        self.skip = m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = {}  # by suffix block: starts of different strings
        self.items: dict[int, int | set[int]] = {}  # by start
        first: dict[tuple, int] = {}
        for at, item in zip(starts, items):
            string = tuple(flat[at : at + m])
            own = first.setdefault(string, at)
            if item is not None:
                known = self.items.setdefault(own, item)
                if known.__class__ is set:
                    known.add(item)
                elif known != item:  # a set only where items share a string
                    self.items[own] = {known, item}
            if own != at:
                continue
            for j in range(self.b, m + 1):  # the block that ends before j
                block = self._block(string, j)
                self.shift[block] = min(self.shift.get(block, self.skip), m - j)
            self.bucket.setdefault(self._block(string, m), array("l")).append(at)

    def _block(self, ws, end: int):
        return ws[end - 1] if self.b == 1 else (ws[end - 2], ws[end - 1])

    def search(self, ws: list[bytes], hit: list[int], items: set[int]) -> None:
        """Adds starts of occurrences to ``hit`` (with the length) and the strings' items to ``items``."""
        m, n, shift, skip, single = self.m, len(ws), self.shift, self.skip, self.b == 1
        end = m
        while end <= n:
            last = ws[end - 1] if single else (ws[end - 2], ws[end - 1])
            step = shift.get(last, skip)
            if not step:
                text = ws[end - m : end]
                for at in self.bucket[last]:
                    if self.flat[at : at + m] == text:
                        hit.append(end - m)
                        own = self.items.get(at)
                        if own.__class__ is set:
                            items |= own
                        elif own is not None:
                            items.add(own)
                        break  # strings of a bucket differ
                step = 1
            end += step


def tables(items: list[tuple[int | None, str]], window: int) -> list[WuManber]:
    flat: list[bytes] = []
    known: dict[bytes, bytes] = {}
    by_length: dict[int, tuple[list[int], list[int | None]]] = {}
    for item, text in items:
        ws = words(text)
        m = min(window, len(ws))
        if m:
            starts, ids = by_length.setdefault(m, ([], []))
            starts += range(len(flat), len(flat) + len(ws) - m + 1)
            ids += [item] * (len(ws) - m + 1)
            flat += [known.setdefault(w, w) for w in ws]
    return [WuManber(flat, *of, m) for m, of in sorted(by_length.items())]


def covered(starts: list[tuple[int, int]]) -> list[int]:
    """Disjoint intervals ``[from, to, from, to ...]`` over occurrences ``(start, end)``."""
    out: list[int] = []
    for a, b in sorted(starts):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (hit word intervals) and ``items`` (ids with an occurring window); other columns stay."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()  # repeated items tell nothing new
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = total // block_chars + 1
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    base = docs.select(*keep)
    if blocks == 1:
        return _search(base, bench, window, whole=True)
    row, of_row = free_names(base, "_row", "_of")
    rows = written(base.withColumn(row, F.monotonically_increasing_id()), "numbered")
    bench = written(bench.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "benchmark")
    found = None
    for k in sorted(r["_block"] for r in bench.select("_block").distinct().collect()):
        hits = _search(rows.select(F.col(row).alias("_row"), "text"), bench.where(F.col("_block") == k).select("item_id", "text"), window, whole=False)
        found = hits if found is None else found.unionByName(hits)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = found.select(F.col("_row").alias("_of"), "hits", "items").groupBy("_of").agg(flat("hits"), flat("items"))
    found = written(found.mapInArrow(_merged, "_of long, hits array<int>, items array<long>"), "hits").withColumnRenamed("_of", of_row)
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    of = F.broadcast(found) if found.count() <= BROADCAST_HITS else found
    rows = rows.join(of, F.col(row) == F.col(of_row), "left")
    return rows.select(
        *keep, n_words(F.col("text")).alias("n_words"), none("hits", "array<int>").alias("hits"), none("items", "array<bigint>").alias("items")
    )


def n_words(text: Column) -> Column:
    """The number of words of a text, without Python."""
    low = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), "")).cast("long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several blocks found in a row as disjoint intervals and different items."""
    for batch in batches:
        hits = [covered(list(zip(h[::2], h[1::2]))) for h in batch.column("hits").to_pylist()]
        items = [sorted(set(i)) for i in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_of"), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names=["_of", "hits", "items"])


#: The tables of the block that a worker searched last, by a key of the block.
_TABLES: dict[tuple[str, int], list[WuManber]] = {}
CACHES.append(_TABLES)


def _search(docs: DataFrame, bench: DataFrame, window: int, whole: bool) -> DataFrame:
    """``docs`` with what one block of the benchmark hits: every row, or those that are hit, written, after which the broadcast is freed."""
    shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in bench.collect()])
    key = (uuid.uuid4().hex, window)
    new = "n_words long, hits array<int>, items array<long>"
    schema = docs.limit(0).selectExpr("*", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split(" ") for x in new.split(", ")))).schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:
            release_caches()
            give_back()
            _TABLES[key] = tables(shared.value, window)
        sets = _TABLES[key]
        for batch in batches:
            count, hits, found = [], [], []
            for text in batch.column("text").to_pylist():
                ws, items, spans = words(text), set(), []
                for s in sets:
                    starts: list[int] = []
                    s.search(ws, starts, items)
                    spans += [(a, a + s.m) for a in starts]
                count.append(len(ws))
                hits.append(covered(spans) if spans else [])
                found.append(sorted(items) if items else [])
            more = [pa.array(count, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "n_words", "hits", "items"])
            yield out if whole else out.filter(pa.array([len(h) > 0 for h in hits], pa.bool_()))

    out = docs.mapInArrow(search, schema)
    if whole:
        return out
    out = written(out.select("_row", "hits", "items"), "block-hits")
    shared.unpersist()
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_passages(docs, read_table(spark, sf_dir, "benchmark")).drop("text")
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no test string occurs, with the columns they had."""
    safe, back = shielded(docs, ("n_words", "hits", "items"))
    return find_passages(safe, benchmark, window).where(F.size("hits") == 0).select(*back)


#: DuckDB SQL for the query: hash join of document windows with benchmark windows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT DISTINCT dw.doc_id, dw.m, dw.i, bw.item_id FROM dw JOIN bw USING (m, s)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
