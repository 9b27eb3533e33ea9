"""What the operators share: tables, batches, words, and columns whose names clash."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.shipping import ship
from veilmark.sources.shared import shared_dir, written

__all__ = ["bound_batches", "free_names", "give_back", "read_table", "release_caches", "shared_dir", "shielded", "text_or_empty", "words_of", "written"]

#: White space between words: space and U+0009 to U+000D (the contracts' word class is the complement).
WORD_GAP = "[ \\t-\\r]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Limits of a batch to Python workers: Spark's default, and the one used instead, as texts are long rows.
BATCHES = {"maxRecordsPerBatch": ("10000", "1024"), "maxBytesPerBatch": ("67108864b", "4194304b")}


def bound_batches(spark: SparkSession) -> None:
    """Smaller batches to Python workers than Spark's defaults, which are meant for short rows; values set by the session stay."""
    for name, (usual, own) in BATCHES.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)


def shielded(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns of these names renamed, and the columns that give it back as it was."""
    own = [f"_own_{i}_{c}" if c in names or c.startswith("_own_") else c for i, c in enumerate(df.columns)]
    return df.select(*(F.col(c).alias(o) for c, o in zip(df.columns, own))), [F.col(o).alias(c) for c, o in zip(df.columns, own)]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


#: What a worker remembers for one operator; others clear it before they need memory of their own.
CACHES: list[dict] = []


def release_caches() -> None:
    if any(CACHES):
        for cache in CACHES:
            cache.clear()
        give_back()
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Returns freed pages to the system where the C library can; else they would stay with the worker."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
