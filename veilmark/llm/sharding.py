"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

1. Each source partition permutes its rows locally (a sort by random keys) and numbers them.
2. With the partitions' row counts alone, the matrix of rows from each partition to each shard is drawn from its
   exact law under a uniform permutation: partition after partition, multivariate hypergeometric from
   what the shards still lack. Row sums are the partitions' counts, column sums the shards' exact sizes.
3. A row's number in its permuted partition picks its shard from the cumulated row of the matrix.
4. The exchange goes by ranges of (shard, second random key), so a shard is spread over as many tasks as it needs and
   is permuted again; ``slot`` is the row's place in its shard.

Everything that touches rows is DataFrame operations on the JVM; the driver draws the matrix from one count per
source partition, whatever the number of rows (no draw is limited to populations below 10**9), and writes it as a table in
slices of ``CELLS`` numbers. The law is ``rows``: shard counts differ by one at most. Keys are ``rand`` of a seed, so a row's content
does not matter: copies (equal texts) are spread as any rows are.

Defined cases: null text has size 16 and the CRC-32 of nothing, 0; repeated rows each get a slot; fewer rows than shards
leave shards empty; ties do not arise, as random keys order rows; very long texts are measured whole; an empty table gives no rows; other columns pass
through ``shard_rows``, whatever their names (``shard`` and ``slot`` are replaced).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilmark.llm.common import read_table, shared_dir, shielded, text_or_empty, written

SHARDS = 40
CELLS = 1 << 16  # of the matrix in one literal of a plan
BROADCAST_CELLS = 4_000_000  # 32 MB
_SIGMAS = 9  # beyond which a draw has less chance than a double can tell (below 1e-17)
_OWN = ("_part", "_nth", "_key", "_mid", "_at", "_first", "ends", "n", "shard", "slot")


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts by (partition, shard) as under a uniform permutation of all rows dealt into shards of exact sizes."""
    total = sum(rows)
    lacking = np.full(shards, total // shards, dtype=np.int64)
    lacking[: total % shards] += 1
    draw, out = np.random.default_rng(seed), np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        out[p] = _draw(draw, lacking, n)
        lacking -= out[p]
    return out


def _draw(draw: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw as a chain of univariate ones."""
    out, rest = np.zeros_like(colours), int(colours.sum())
    for k, c in enumerate(colours):
        rest -= int(c)
        out[k] = hypergeometric(draw, int(c), rest, n) if n and c else 0
        n -= int(out[k])
    return out


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good + bad`` are good, for populations of any size.

    By inversion: the weights of the values around the mode follow from the ratios of neighbours, which need no factorials.
    """
    total = good + bad
    if n > total - n:  # what is left behind has the same law and is less
        return good - hypergeometric(draw, good, bad, total - n)
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    share = good / total
    sigma = np.sqrt(n * share * (1 - share) * (total - n) / max(1, total - 1))
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    reach = int(_SIGMAS * sigma) + 64
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # of the weights of k + 1 and k
    below, above = ratio[: mode - low], ratio[mode - low :]
    upto = np.cumsum(np.concatenate([np.cumprod(1 / below[::-1])[::-1], [1.0], np.cumprod(above)]))
    return low + int(np.searchsorted(upto, draw.random() * upto[-1], side="right"))


def _matrix_table(spark: SparkSession, partitions: list[int], ends: np.ndarray) -> DataFrame:
    """``(_part, ends)`` as a table in the shared folder, written in slices."""
    path, rows = shared_dir(spark, "matrix"), max(1, CELLS // max(1, ends.shape[1]))
    for at in range(0, max(1, len(partitions)), rows):
        some = [{"_part": p, "ends": e} for p, e in zip(partitions[at : at + rows], ends[at : at + rows].tolist())]
        table = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(some)), "array<struct<_part:int,ends:array<bigint>>>")))
        table.write.mode("append").parquet(path)
    return spark.read.schema("_part int, ends array<bigint>").parquet(path)


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """``df`` with ``shard`` and ``slot``."""
    spark = df.sparkSession
    df, back = shielded(df.drop("shard", "slot"), _OWN)
    keep = df.columns
    local = df.select(*keep, F.rand(seed).alias("_key")).sortWithinPartitions("_key").select(*keep, F.monotonically_increasing_id().alias("_mid"))
    part, nth = F.shiftright("_mid", 33).cast("int"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(local.select(*keep, part.alias("_part"), nth.alias("_nth")), "permuted")

    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    table = _matrix_table(spark, [p for p, _ in counts], np.cumsum(matrix, axis=1))
    small = matrix.size <= BROADCAST_CELLS  # beyond that Spark chooses the join
    dealt = rows.join(F.broadcast(table) if small else table, "_part").select(
        *keep, F.size(F.filter("ends", lambda e: e <= F.col("_nth"))).alias("shard"), F.rand(seed + 1).alias("_key")
    )

    again = dealt.repartitionByRange("shard", "_key").sortWithinPartitions("shard", "_key").select(*keep, "shard", F.monotonically_increasing_id().alias("_mid"))
    again = written(again.select(*keep, "shard", part.alias("_part"), nth.alias("_nth")), "exchanged")
    cells = again.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_nth").alias("_first"))
    cells = cells.select("shard", "_part", (F.sum("n").over(W.partitionBy("shard").orderBy("_part")) - F.col("n") - F.col("_first")).alias("_at"))
    return again.join(cells, ["shard", "_part"]).select(*back, "shard", (F.col("_nth") + F.col("_at")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    raw = text_or_empty().cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
