"""Detection quality: gold and predicted spans of a sample are two arrays of its row, so matching never shuffles; counts are then summed.

Long form of counts: ``(family, label, tp, fp, fn)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilmark.functions.labels import RISK_WEIGHTS, by_label
from veilmark.functions.rows import each
from veilmark.functions.texts import let, marked_preview
from veilmark.operators.spans import intersection_length, merge_ranges, overlaps, ranges_length, running_greatest, token_ranges

FAMILIES = ["exact_agnostic", "overlap_agnostic", "exact_canonical", "overlap_canonical", "char_canonical", "token_canonical"]


def labelled(spans: Column, label: Column | None = None) -> Column:
    return F.filter(spans, lambda s: s["canonical"].isNotNull() if label is None else s["canonical"] == label)


def counts(tp: Column, predicted: Column, gold: Column) -> Column:
    zero = F.lit(0)
    return F.struct(tp.cast("long").alias("tp"), F.greatest(predicted - tp, zero).cast("long").alias("fp"), F.greatest(gold - tp, zero).cast("long").alias("fn"))


def exact_counts(gold: Column, predicted: Column, with_label: bool) -> Column:
    """Multiset intersection on bounds (and label): equal spans are numbered, so that it is one of sets."""

    def numbered(spans: Column) -> Column:
        key = lambda s: F.concat_ws(":", s["start"], s["end"], *([F.coalesce(s["canonical"], F.lit("-"))] if with_label else []))

        def nth(keys: Column) -> Column:
            begins = F.transform(keys, lambda k, i: F.when((i == 0) | (k != F.get(keys, i - 1)), i + 1).otherwise(1))
            return let(running_greatest(F.concat(begins, F.array(F.lit(1)))), lambda first: F.transform(keys, lambda k, i: F.concat_ws("#", k, i + 1 - F.get(first, i + 1))))

        return let(F.sort_array(F.transform(spans, key)), nth)

    return counts(F.size(F.array_intersect(numbered(gold), numbered(predicted))), F.size(predicted), F.size(gold))


def overlap_counts(gold: Column, predicted: Column, with_label: bool) -> Column:
    """Greedy: each prediction in order takes the first gold span that is free and overlaps."""
    fits = lambda p, g: overlaps(p, g) & (p["canonical"] == g["canonical"]) if with_label else overlaps(p, g)
    numbers = F.transform(gold, lambda g, i: F.struct(g.alias("g"), i.alias("i")))

    def step(used: Column, p: Column) -> Column:
        free = F.filter(numbers, lambda x: fits(p, x["g"]) & ~F.array_contains(used, x["i"]))
        return F.when(F.size(free) > 0, F.concat(used, F.array(F.get(free, F.lit(0))["i"]))).otherwise(used)

    tp = F.size(F.aggregate(predicted, F.array().cast("array<int>"), step))
    return counts(tp, F.size(predicted), F.size(gold))


def char_counts(gold: Column, predicted: Column) -> Column:
    both = F.struct(merge_ranges(gold).alias("g"), merge_ranges(predicted).alias("p"))
    return let(both, lambda x: counts(intersection_length(x["g"], x["p"]), ranges_length(x["p"]), ranges_length(x["g"])))


def token_counts(text: Column, gold: Column, predicted: Column) -> Column:
    both = F.struct(token_ranges(text, merge_ranges(gold)).alias("g"), token_ranges(text, merge_ranges(predicted)).alias("p"))
    return let(both, lambda x: counts(intersection_length(x["g"], x["p"]), ranges_length(x["p"]), ranges_length(x["g"])))


def family_rows(text: Column, gold: Column, predicted: Column, families: list[str] = FAMILIES, per_label: bool = True) -> Column:
    """One sample's counts, ``array<struct<family,label,c:struct<tp,fp,fn>>>``; label is null for all labels together."""
    cg, cp = labelled(gold), labelled(predicted)
    make = {
        "exact_agnostic": lambda: exact_counts(gold, predicted, False),
        "overlap_agnostic": lambda: overlap_counts(gold, predicted, False),
        "exact_canonical": lambda: exact_counts(cg, cp, True),
        "overlap_canonical": lambda: overlap_counts(cg, cp, True),
        "char_canonical": lambda: char_counts(cg, cp),
        "token_canonical": lambda: token_counts(text, cg, cp),
    }
    row = lambda family, label, c: F.struct(F.lit(family).alias("family"), label.cast("string").alias("label"), c.alias("c"))
    rows = F.array(*(row(f, F.lit(None), make[f]()) for f in families))
    if per_label:
        labels = F.array_union(F.transform(cg, lambda s: s["canonical"]), F.transform(cp, lambda s: s["canonical"]))
        exact = F.transform(labels, lambda x: row("label_exact", x, exact_counts(labelled(gold, x), labelled(predicted, x), True)))
        chars = F.transform(labels, lambda x: row("label_char", x, char_counts(labelled(gold, x), labelled(predicted, x))))
        rows = F.concat(rows, exact, chars)
    return rows


def _summed() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]


def evaluate(samples: DataFrame, by: list[str] | None = None, families: list[str] = FAMILIES, per_label: bool = True) -> DataFrame:
    """Summed counts of ``samples(text, gold, predicted, ...)`` by family and label (null: all), and by the columns ``by``."""
    by = by or []
    rows = family_rows(F.col("text"), F.col("gold"), F.col("predicted"), families, per_label)
    long = each(samples, rows, "r", *by).select(*by, "r.family", "r.label", "r.c.*")
    return long.groupBy(*by, "family", "label").agg(*_summed())


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_ratios(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and the share that was missed, to six places."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns(
        {
            "precision": F.round(p, 6),
            "recall": F.round(r, 6),
            "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6),
            "residual_miss_ratio": F.round(1 - r, 6),
        }
    )


def macro(per_label: DataFrame) -> DataFrame:
    """Unweighted means over labels with gold support."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    rows = per_label.where("tp + fn > 0").select(p.alias("p"), r.alias("r"), f1.alias("f"))
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return rows.agg(mean("p", "precision"), mean("r", "recall"), mean("f", "f1"), F.count(F.lit(1)).alias("labels_included"))


def risk_weighted_recall(per_label_char: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The headline: recall of characters over labels, weighted by what a miss costs."""
    w = by_label(F.col("label"), weights or RISK_WEIGHTS, 0.0)
    rows = per_label_char.where("tp + fn > 0").select(w.alias("w"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("r")).where("w > 0")
    total = F.coalesce(F.sum("w"), F.lit(0.0))
    value = F.when(total > 0, F.sum(F.col("w") * F.col("r")) / total).otherwise(0.0)
    return rows.agg(F.round(value, 6).alias("value"), F.count(F.lit(1)).alias("labels_included"), total.alias("total_weight"))


def confusion(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    out = df.agg(
        *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("tp", gold & predicted), ("fp", ~gold & predicted), ("tn", ~gold & ~predicted), ("fn", gold & ~predicted)))
    )
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn")}
    p, r = ratio(d["tp"], d["tp"] + d["fp"]), ratio(d["tp"], d["tp"] + d["fn"])
    return out.withColumns(
        {
            "precision": F.round(p, 6),
            "recall": F.round(r, 6),
            "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6),
            "false_positive_rate": F.round(ratio(d["fp"], d["fp"] + d["tn"]), 6),
            "false_negative_rate": F.round(ratio(d["fn"], d["fn"] + d["tp"]), 6),
        }
    )


def leakage(samples: DataFrame, masked: str = "masked") -> DataFrame:
    """Gold texts that are still in the masked text; empty ones count in the denominator alone."""
    gold = F.filter("gold", lambda g: g["canonical"].isNotNull())
    value = lambda g: F.substring(F.col("text"), g["start"] + 1, g["end"] - g["start"])
    leaked = F.filter(gold, lambda g: (value(g) != "") & F.contains(F.col(masked), value(g)))
    out = samples.select(F.size(gold).alias("n"), F.size(leaked).alias("l")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_gold_spans"), F.coalesce(F.sum("l"), F.lit(0)).alias("leaked_gold_spans")
    )
    return out.withColumn("leakage_fraction", F.round(ratio(F.col("leaked_gold_spans"), F.col("total_gold_spans")), 6))


def scoped(spans: Column, scored: Column) -> Column:
    """Spans whose label the sample's dataset supervises."""
    return F.filter(spans, lambda s: F.array_contains(scored, s["canonical"]))


def unscored(samples: DataFrame, scored: Column) -> DataFrame:
    """Predictions out of scope by label: neither right nor wrong, but counted."""
    out = F.filter("predicted", lambda s: s["canonical"].isNotNull() & ~F.array_contains(scored, s["canonical"]))
    return each(samples, out, "s").groupBy(F.col("s.canonical").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def slices(samples: DataFrame, keys: list[str], families: list[str]) -> DataFrame:
    """Counts for each value of each key by itself; null is ``unknown``.

    A sample is evaluated once; its counts, and not its text, then meet each of the grouping sets.
    """
    known = [F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = each(samples, family_rows(F.col("text"), F.col("gold"), F.col("predicted"), families, per_label=False), "r", *known)
    rows = rows.select(*(f"k{i}" for i in range(len(keys))), "r.family", "r.label", "r.c.*")
    cols = [F.col(f"k{i}") for i in range(len(keys))]
    sums = rows.groupingSets([[c, F.col("family"), F.col("label")] for c in cols], *cols, F.col("family"), F.col("label")).agg(
        *_summed(), F.count(F.lit(1)).alias("samples"), *(F.grouping(f"k{i}").alias(f"g{i}") for i in range(len(keys)))
    )
    slice_of, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        slice_of, value = F.when(F.col(f"g{i}") == 0, k).otherwise(slice_of), F.when(F.col(f"g{i}") == 0, F.col(f"k{i}")).otherwise(value)
    return sums.select(slice_of.alias("slice"), value.alias("value"), "family", "label", "tp", "fp", "fn", "samples")


def detectors(samples: DataFrame, families: list[str]) -> DataFrame:
    """Counts per detector, each against all gold spans; a detector counts in samples where it found nothing too.

    All detectors are evaluated where the sample is; only counts leave it.
    """
    names = each(samples, "predicted", "s").select(F.col("s.detector").alias("detector")).distinct()
    listed = F.array_sort(F.array(*(F.lit(r[0]) for r in names.collect())).cast("array<string>"))  # a few names: one for each detector of the profile
    own = lambda d: F.filter("predicted", lambda s: s["detector"].eqNullSafe(d))
    rows = F.flatten(F.transform(listed, lambda d: F.transform(family_rows(F.col("text"), F.col("gold"), own(d), families, per_label=False), lambda r: F.struct(d.alias("detector"), r.alias("r")))))
    long = each(samples, rows, "x").select("x.detector", "x.r.family", "x.r.label", "x.r.c.*")
    return long.groupBy("detector", "family", "label").agg(*_summed())


def false_positives(samples: DataFrame) -> DataFrame:
    """Predictions that overlap no gold span of their label."""
    wrong = F.filter("predicted", lambda p: ~F.exists("gold", lambda g: overlaps(p, g) & (p["canonical"] == g["canonical"])))
    return each(samples, wrong, "s", "sample_id", "text").select("sample_id", "text", "s.*")


def first_examples(wrong: DataFrame, k: int = 8, reach: int = 40) -> DataFrame:
    """The first ``k`` wrong predictions of each label, by sample and place, with their surroundings.

    Spark keeps ``k`` rows a label in each task before the exchange, so a frequent label is no large group.
    """
    order = W.partitionBy("canonical").orderBy("sample_id", "start", "end")
    first = wrong.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return first.select(F.col("canonical").alias("label"), "nth", "sample_id", "start", "end", "score", marked_preview(F.col("text"), F.col("start"), F.col("end"), reach=reach).alias("preview"))


def with_predictions(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Samples with the predictions ``(sample_id, predicted)`` of their id; without any, with none."""
    kind = predictions.schema["predicted"].dataType
    found = predictions.select(F.col("sample_id").alias("_sid"), F.col("predicted").alias("_p"))
    df = samples.drop("predicted").join(found, F.col("sample_id") == F.col("_sid"), "left")
    return df.withColumn("predicted", F.coalesce("_p", F.array().cast(kind))).drop("_sid", "_p")


def compare_recalls(base: DataFrame, new: DataFrame) -> DataFrame:
    """Recall per label in two reports, 0 where one has none, with the difference."""
    b, n = base.select("label", F.col("recall").alias("base")), new.select("label", F.col("recall").alias("new"))
    out = b.join(n, "label", "full").select("label", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("base", "new")))
    return out.withColumn("delta", F.round(F.col("new") - F.col("base"), 6))


def extremes(compared: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` worst and the ``n`` best differences."""
    worst = compared.orderBy("delta", "label").limit(n).withColumn("side", F.lit("worst"))
    best = compared.orderBy(F.desc("delta"), F.desc("label")).limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def merge_reports(reports: list[DataFrame]) -> DataFrame:
    """Counts of several reports as one, ratios anew."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return with_ratios(out.groupBy("family", "label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def merged_report(reports: list[tuple[dict, DataFrame]]) -> tuple[dict, DataFrame]:
    """Header and counts ``(family, label, tp, fp, fn, ...)`` of reports of one run's parts: counts summed, ratios anew, slices dropped.

    The header has all datasets in order; macro means and the risk-weighted recall are rows of their own families.
    """
    same_run([h for h, _ in reports])
    header = {k: v for k, v in reports[0][0].items() if k != "slices"}
    header["datasets"] = list(dict.fromkeys(x for h, _ in reports for x in h.get("datasets", [])))
    merged = merge_reports([r.select("family", "label", "tp", "fp", "fn") for _, r in reports])
    chars = merged.where("family = 'label_char'")
    blank = {c: F.lit(None).cast("bigint").alias(c) for c in ("tp", "fp", "fn")}
    means = macro(chars).select(F.lit("macro").alias("family"), F.lit(None).cast("string").alias("label"), *blank.values(), "precision", "recall", "f1", F.round(1 - F.col("recall"), 6).alias("residual_miss_ratio"))
    risk = risk_weighted_recall(chars).select(
        F.lit("risk_weighted").alias("family"), F.lit(None).cast("string").alias("label"), *blank.values(), F.lit(None).cast("double").alias("precision"), F.col("value").alias("recall"),
        F.lit(None).cast("double").alias("f1"), F.round(1 - F.col("value"), 6).alias("residual_miss_ratio"),
    )
    return header, merged.unionByName(means).unionByName(risk)


def same_run(headers: list[dict]) -> None:
    """Reports can be merged only if version, suite, split and policy are the same."""
    for key in ("report_version", "suite", "split", "policy_name"):
        if len({h.get(key) for h in headers}) > 1:
            raise ValueError(f"reports differ in {key}")
