"""Detectors of one's own as table functions: a type in a policy, a Python class that yields spans, a lateral join that runs it.

``register_kind`` takes a type and what makes the function of a detector's parameters: a class whose ``eval(text)`` yields
``(start, end, label, score)``. Policies may then name the type. Rows keep their text only up to the join; spans leave as rows, or as one array a row
that ``detect`` takes as ``extra`` beside its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.labels import collapse_type, detection_label
from veilmark.operators.spans import SPANS, span
from veilmark.sources import policy as policies
from veilmark.sources.policy import Detector, PolicyFile

ROW = "start int, end int, label string, score double"
TABLE_KINDS: dict[str, Callable[[dict], type]] = {}


def register_kind(kind: str, make: Callable[[dict], type]) -> None:
    """Makes policies accept the type; ``ValueError`` if it is one of the built-in ones."""
    if kind in policies.KINDS:
        raise ValueError(f"{kind!r} is a built-in type")
    TABLE_KINDS[kind] = make
    policies.OWN_KINDS.add(kind)


def function_spans(df: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """``df`` without its text, with a row for each span of the detector: ``start``, ``end``, ``label``, ``score``, ``detector``, ``canonical``."""
    function = F.udtf(TABLE_KINDS[detector.kind](detector.params), returnType=ROW)
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = rows.lateralJoin(function(F.col("_text").outer()).toDF("_start", "_end", "_label", "_score"))
    label = collapse_type(F.col("_label"))
    own = span(F.col("_start"), F.col("_end"), label, F.col("_score"), F.concat(F.lit(f"{detector.id}:"), label), detection_label(label))
    good = F.col("_start").isNotNull() & (F.col("_start") >= 0) & (F.col("_end") > F.col("_start")) & (F.col("_end") <= F.length("_text"))
    return found.where(good).select(*keep, own.alias("_s")).select(*keep, "_s.*")


def with_function_spans(df: DataFrame, policy: PolicyFile, row_id: str, name: str | None = None, text: str = "text") -> tuple[DataFrame, Column]:
    """``df`` with the spans of all the profile's detectors of registered types, and the column that ``detect`` takes as ``extra``."""
    own = [d for d in policy.detectors_of(policy.resolve(name).analyzer_profile) if d.kind in TABLE_KINDS]
    if not own:
        return df, F.array().cast(SPANS)
    rows = None
    for d in own:
        found = function_spans(df.select(F.col(row_id).alias("_of"), F.col(text).alias("text")), d)
        rows = found if rows is None else rows.unionByName(found)
    lists = rows.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "score", "detector", "canonical"))).alias("_own"))
    joined = df.join(lists, F.col(row_id) == F.col("_of"), "left").drop("_of")
    return joined.withColumn("_own", F.coalesce("_own", F.array().cast(SPANS))), F.col("_own")
