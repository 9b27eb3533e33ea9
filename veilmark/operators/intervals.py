"""Spans that come as rows of two tables: joined where they overlap, and window boundaries tried with markers.

An interval join by id alone sends a document's spans to one task, however many there are. Here each span is in the buckets of
``width`` characters that it touches, and pairs meet by (id, bucket), so a document with very many spans is as many keys as it is long. A pair that shares
several buckets is told in the first of them only, so that no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.rows import each
from veilmark.functions.texts import cut, let
from veilmark.operators.plugins import merge_windows
from veilmark.operators.spans import blocks, chunk_windows, overlaps

WIDTH = 4_096


def _buckets(df: DataFrame, width: int, name: str) -> DataFrame:
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return df.where(F.col("end") > F.col("start")).select(F.struct("*").alias(name), F.explode(F.sequence(first, last)).alias("bucket"))


def overlap_join(left: DataFrame, right: DataFrame, on: str = "sample_id", how: str = "inner", width: int = WIDTH) -> DataFrame:
    """``(left, right)`` of every two spans (rows with ``on``, ``start``, ``end``) of one id that share a character.

    ``how`` is ``inner``, or ``left``: then a left span without a partner is told too, with a null ``right``. A null id has no partner.
    """
    a, b = _buckets(left, width, "left"), _buckets(right, width, "right")
    key = [F.col(f"left.{on}") == F.col(f"right.{on}"), F.col("a.bucket") == F.col("b.bucket")]
    both = a.alias("a").join(b.alias("b"), key)
    first = F.floor(F.greatest("left.start", "right.start") / width) == F.col("a.bucket")
    pairs = both.where(overlaps(F.col("left"), F.col("right")) & first).select("left", "right")
    if how == "inner":
        return pairs
    if how != "left":
        raise ValueError(f"unknown join {how!r}")
    # the spans without a partner, each once though it may lie in several buckets
    met = both.where(overlaps(F.col("left"), F.col("right"))).select(F.col(f"left.{on}").alias("id"), F.col("left.start").alias("s"), F.col("left.end").alias("e")).distinct()
    alone = left.join(met, (F.col(on) == F.col("id")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), "left_anti").select(F.struct(*left.columns).alias("left"))
    return pairs.unionByName(alone, allowMissingColumns=True)


def in_windows(text: Column, windows: Column, find) -> Column:
    """Spans that ``find(text)`` gives in each window by itself, in the text's offsets and merged as a model's are.

    A cut counts characters from the text's beginning, so windows are cut out of the text of their block, and each only once.
    """
    own = lambda t: F.transform(find(t), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["score"].alias("score")))

    def of_block(b: Column) -> Column:
        first = F.get(b, 0)["start"]
        return let(cut(text, first, F.array_max(F.transform(b, lambda w: w["end"]))), lambda t: F.transform(b, lambda w: let(cut(t, w["start"] - first, w["end"] - first), own)))

    return let(windows, lambda ws: merge_windows(ws, F.flatten(F.transform(blocks(ws, "struct<start:int,end:int>"), of_block))))


def boundary_cases(docs: DataFrame, marker: str, size: int, overlap: int | None = None, text: str = "text") -> DataFrame:
    """A row for each way to put the marker at the second window's beginning: across it, just before and just after.

    ``docs`` with ``case``, ``boundary``, ``start`` and ``end`` (of the marker) and the changed text; documents of one window have no boundary.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # the second window begins within the first tokens of a text, or where these end
    begun = F.regexp_extract(t, f"^\\s*(?>(?:\\S+\\s*){{1,64}}){{0,{size // 64 + 1}}}", 0)
    # windows that only cover gaps begin where another ends; the second full one begins before the first ends, or after a gap
    second = let(chunk_windows(begun, size, overlap), lambda w: F.get(w, 1)["start"])
    starts = docs.withColumn("boundary", second)
    n = len(marker)
    offsets = {"cross_boundary": F.greatest(F.lit(0), F.col("boundary") - n // 2), "just_before": F.greatest(F.lit(0), F.col("boundary") - n - 2), "just_after": F.least(F.col("boundary") + 2, F.length(t))}
    ways = F.array(*(F.struct(F.lit(case).alias("case"), at.cast("int").alias("start")) for case, at in offsets.items()))
    rows = each(starts, F.when(F.col("boundary").isNotNull(), ways), "_c", *docs.columns, "boundary")
    changed = F.concat(F.substring(t, F.lit(1), F.col("_c.start")), F.lit(marker), F.substring(t, F.col("_c.start") + 1, F.length(t)))
    return rows.select(*(c for c in docs.columns if c != text), "boundary", "_c.case", "_c.start", (F.col("_c.start") + n).alias("end"), changed.alias(text))


def boundary_report(cases: DataFrame, predictions: DataFrame, on: str) -> DataFrame:
    """By case: how many predictions there are, how many overlap the marker, and how much longer they are than it.

    Markers and predictions are tables of their own (``on``, ``case``, ``start``, ``end``). Each is read once: a case's predictions are one list, and what
    overlaps the marker is told in the case's row.
    """
    key = F.concat_ws("\x1f", F.col(on).cast("string"), F.col("case")).alias("sample_id")
    found = predictions.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("_found"))
    size = lambda x: (x["end"] - x["start"]).cast("long")
    mark = F.struct("start", "end")
    rows = cases.select(on, "case", "boundary", "start", "end", key).join(found, "sample_id", "left")
    rows = rows.withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<start:int,end:int>>")))
    rows = rows.withColumn("_met", F.filter("_found", lambda s: (s["end"] > s["start"]) & overlaps(s, mark)))
    inflation = F.aggregate("_met", F.lit(0).cast("long"), lambda a, s: a + size(s) - size(mark))
    return rows.select(on, "case", "boundary", F.size("_found").cast("long").alias("predicted_count"), F.size("_met").cast("long").alias("overlap_count"), inflation.alias("span_inflation"))
