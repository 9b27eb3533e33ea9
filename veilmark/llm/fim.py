"""Fill-in-middle transformation: texts cut into prefix, middle and suffix and put together for infilling.

A text becomes an array of UTF-32 code points and each point a class; where neighbouring classes differ a unit begins
(``flatnonzero``). A digest of the key picks two ranks among the unit boundaries, the array is cut there, and the
pieces are encoded again. Units are code points (every point differs from its neighbour) or words
(``points`` or ``words``; a word is a run of white space or of anything else), so that no cut is within a word.

All choices come from the key's digest, ``h1`` to ``h4`` being the first four 8-digit groups of the SHA-256 of ``version:key``: a run on
other partitions, or a task that is run again, gives the same output. The three marks occur in no text that is cut (others stay plain), so the
original comes back exactly from output and form (``restored``, on the JVM).

Memory: a worker holds one batch and, for the text at hand, 13 bytes a code point; nothing moves between tasks.

Defined cases: null text is empty and stays plain with no units; a text that holds a mark stays plain; a null key is digested as
no digits; repeated rows, and ties of keys, are cut alike and each give a row; very long texts are cut whole; an empty table gives no rows; other
columns pass through, those of its own names (``OWN``) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read_table, release_caches, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SPM_PERCENT = 90, 20
OWN = ("n_units", "form", "prefix_chars", "middle_chars", "output")
_SPACES = np.array([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def choices(key: object, version: str = "1") -> list[int]:
    """The first four 8-digit groups of the digest of a key, as unsigned integers."""
    digest = hashlib.sha256(f"{version}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def boundaries(points: np.ndarray, units: str) -> np.ndarray:
    """Where units begin, and the end: one more than there are units."""
    if units == "points":
        classes = np.resize(np.array([0, 1], np.uint8), len(points))
    elif units == "words":
        classes = np.isin(points, _SPACES)
    else:
        raise ValueError(f"unknown units {units!r}")
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def cut(text: str, key: object, units: str, version: str) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, prefix's code points, middle's code points, output)`` of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = boundaries(points, units)
    n = len(at) - 1
    h1, h2, h3, h4 = choices(key, version)
    if not n or h3 % 100 >= CUT_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(at[rank]) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in (points[:a], points[a:b], points[b:]))
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", units: str = "points", version: str = "1") -> DataFrame:
    """``docs`` with ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    keep = [c for c in docs.columns if c not in OWN]
    carried = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, carried)), F.col(key).cast("string").alias("key"), text_or_empty(text).alias("whole"))
    made = "n_units long, form string, prefix_chars long, middle_chars long, output string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            cuts = [cut(t.as_py(), k, units, version) for k, t in zip(b.column("key").to_pylist(), b.column("whole"))]
            own = [pa.array(c, kind) for c, kind in zip(zip(*cuts), kinds)] if cuts else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in carried), *own], names=[*carried, *OWN])

    schema = rows.select(*carried).schema
    for field in made.split(", "):
        schema = schema.add(*field.split())
    return rows.mapInArrow(run, schema).select(*(F.col(k).alias(c) for c, k in zip(keep, carried)), *OWN)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", -1), F.split(body, f"{PREFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = fill_in_middle(docs).select("doc_id", *OWN)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
b AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, substr(t, 1, p) AS x, substr(t, p + 1, q - p) AS y, substr(t, q + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM d"""
