"""Subsets and samples of labelled datasets. Order comes from a hash of id and seed, so a sample is stable under any partitioning."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shuffle_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")).cast("binary"))


def subset(df: DataFrame, spec: str) -> DataFrame:
    """``all``, ``negatives``, ``positives``, ``language=x`` or ``script_profile=x``; a field that is null throughout is an error."""
    spec = spec.strip()
    if spec in ("", "all"):
        return df
    key, _, want = spec.partition("=")
    column = {"negatives": "entity_count", "positives": "entity_count", "language": "language", "script_profile": "script_profile"}.get(key)
    if column is None:
        raise ValueError(f"unknown subset {spec!r}")
    if column not in df.columns or df.where(F.col(column).isNotNull()).isEmpty():
        raise ValueError(f"subset {spec!r} needs the field {column}")
    if key == "negatives":
        return df.where("entity_count = 0")
    if key == "positives":
        return df.where("entity_count > 0")
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    return df.where((F.lower(value) == want.strip().lower()) if key == "language" else (value == want.strip()))


def random_sample(df: DataFrame, size: int, seed: int, row_id: str = "sample_id") -> DataFrame:
    return df.orderBy(shuffle_key(row_id, seed), row_id).limit(max(0, size))


MOST_LABELS = 1_000


def label_picks(df: DataFrame, seed: int, min_per_label: int, row_id: str, labels: str) -> list:
    """Ids that the labels take in turn: each label, in order, ``min_per_label`` rows of its own that no earlier one took.

    What the labels before it can have taken is bounded, so a label needs no more than the first ``min_per_label`` rows for each label up
    to it. Spark keeps these in each task before it sends any (``row_number`` under a bound), and only their ids come here.
    """
    names = sorted(r[0] for r in df.select(F.explode(labels).alias("x")).where("x is not null").distinct().limit(MOST_LABELS + 1).collect())
    if len(names) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not names or min_per_label <= 0:
        return []
    ids = df.select(F.col(row_id).alias("id"), shuffle_key(row_id, seed).alias("k"), F.explode(F.array_distinct(labels)).alias("label")).where("label is not null")
    nth = F.row_number().over(W.partitionBy("label").orderBy("k", "id"))
    first = ids.withColumn("nth", nth).where(F.col("nth") <= min_per_label * len(names)).collect()
    by_label: dict[str, list] = {x: [] for x in names}
    for r in sorted(first, key=lambda r: r["nth"]):
        by_label[r["label"]].append(r["id"])
    taken: dict = {}
    for name in names:
        free = [i for i in by_label[name] if i not in taken]
        taken.update(dict.fromkeys(free[:min_per_label]))
    return list(taken)


def label_balanced(df: DataFrame, size: int, seed: int, min_per_label: int, row_id: str = "sample_id", labels: str = "labels") -> DataFrame:
    """``size`` rows with up to ``min_per_label`` of each label, filled up at random.

    The labels take rows one after the other, in their own order, each so many that no earlier one took; then the shuffle's order fills up. If the
    minima alone are more than ``size``, it cuts them. Only ids are ranked; rows are read for the sample alone. Ids are taken to be unique.
    """
    if size <= 0:
        return df.limit(0)
    spark, kind = df.sparkSession, df.schema[row_id].dataType.simpleString()
    picks = label_picks(df, seed, min_per_label, row_id, labels)
    picked = spark.createDataFrame([(i,) for i in picks], f"id {kind}")  # at most ``min_per_label`` for each label
    ids = df.select(F.col(row_id).alias("id"), shuffle_key(row_id, seed).alias("k")).join(F.broadcast(picked.withColumn("first", F.lit(0))), "id", "left")
    chosen = ids.orderBy(F.coalesce("first", F.lit(1)), "k", "id").limit(size).select(F.col("id").alias("_chosen"))
    return df.join(chosen, F.col(row_id) == F.col("_chosen"), "left_semi")


def rebalance_quota(target: int, negative_share: float, negatives: int, positives: int, labels: int) -> dict[str, int]:
    """Rows of either kind and the least number per label for a fast split."""
    target = min(target, negatives + positives)
    negative = min(round(target * negative_share), negatives)
    positive = min(target - negative, positives)
    negative = min(target - positive, negatives)
    per_label = max(10, min(30, positive // max(1, 2 * labels))) if positive else 0
    return {"negatives": negative, "positives": positive, "min_per_label": per_label}


def rebalance(df: DataFrame, target: int, negative_share: float, seed: int, row_id: str = "sample_id", labels: str = "labels") -> DataFrame:
    """A fast split: a share of rows without entities, the rest balanced over labels."""
    n = df.agg(F.count_if(F.col("entity_count") == 0).alias("n"), F.count_if(F.col("entity_count") > 0).alias("p"), F.size(F.array_distinct(F.flatten(F.collect_set(labels)))).alias("l")).first()
    q = rebalance_quota(target, negative_share, n["n"], n["p"], n["l"])
    negative = random_sample(df.where("entity_count = 0"), q["negatives"], seed, row_id)
    return negative.unionByName(label_balanced(df.where("entity_count > 0"), q["positives"], seed, q["min_per_label"], row_id, labels))


def cached_selection(spark: SparkSession, signature: dict, folder: str, select: Callable[[], DataFrame]) -> DataFrame:
    """The selection ``(row ids)`` of a signature: read from its folder, or made and written there.

    The folder's name is a hash of the signature, so another seed, size or table version is another selection. Writing is committed by its
    ``_SUCCESS`` mark; without that the selection is made anew.
    """
    key = hashlib.sha256(json.dumps(signature, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        select().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def largest_remainder(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers that add up to ``total`` in proportion to ``shares``."""
    whole = sum(shares.values())
    if whole <= 0:
        return dict.fromkeys(shares, 0)
    exact = {k: v * total / whole for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: out[k] - exact[k])[: total - sum(out.values())]:
        out[k] += 1
    return out


def label_counts(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Rows without labels and spans per label."""
    return df.select(F.explode_outer(F.when(F.size(labels) > 0, F.col(labels))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
