"""Joins of span tables, slices and balanced samples against plain Python."""

import hashlib
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilmark.functions.rows import each
from veilmark.operators import detect, intervals, metrics, sampling, spans

ROWS = "sample_id string, start int, end int, tag int"


def made(r, n):
    out = []
    for k in range(n):
        s = r.choice([r.randint(0, 60), r.randint(0, 3000)])
        out.append((r.choice(["hot"] * 5 + ["a", "b", None]), s, s + r.choice([0, 1, 7, 40, 900]), k))
    return out


@pytest.mark.parametrize("width", [1, 16, 4096])
def test_overlap_join(spark, width):
    r = random.Random(width)
    a, b = made(r, 70 if width == 1 else 200), made(r, 70 if width == 1 else 200)
    left, right = spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS)
    pairs = sorted((x[3], y[3]) for x in a for y in b if x[0] is not None and x[0] == y[0] and min(x[2], y[2]) > max(x[1], y[1]))
    got = intervals.overlap_join(left, right, width=width).select("left.tag", F.col("right.tag").alias("other")).collect()
    assert sorted(map(tuple, got)) == pairs
    outer = intervals.overlap_join(left, right, how="left", width=width).select("left.tag", F.col("right.tag").alias("other")).collect()
    met = {x for x, _ in pairs}
    assert sorted(tuple(x) for x in outer if x["other"] is not None) == pairs and sorted(x["tag"] for x in outer if x["other"] is None) == sorted(x[3] for x in a if x[3] not in met)
    with pytest.raises(ValueError):
        intervals.overlap_join(left, right, how="cross")


def test_windows_cut_nothing_at_their_edges(spark):
    text = " ".join(["word"] * 130 + ["me@mail.example.com"] + ["word"] * 40)
    df = spark.createDataFrame([(text,)], "t string")
    find = lambda t: detect.spans_of(detect.matches(t, "[a-z]+@[a-z.]+"), "EMAIL", 0.9, "d")
    got = df.select(intervals.in_windows(F.col("t"), spans.chunk_windows(F.col("t"), 128, 16), find).alias("x")).first()["x"]
    assert [text[p["start"] : p["end"]] for p in got] == ["me@mail.example.com"]


def test_boundaries_of_a_long_text(spark):
    """One text of very many windows, in seconds; an address is found once, in whichever window it is whole."""
    words = [f"me{k}@mail.example.com" if k % 50 == 0 else "word" for k in range(150_000)]
    text = "\n" + " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, "one window"), (3, None)], "id long, text string")
    find = lambda t: detect.spans_of(detect.matches(t, "[a-z0-9.]+@[a-z.]+"), "EMAIL", 0.9, "d")
    begun = time.perf_counter()
    cases = intervals.boundary_cases(docs, " x@y.zz ", 128, 16)
    found = each(cases, intervals.in_windows(F.col("text"), spans.chunk_windows(F.col("text"), 128, 16), find), "s", "id", "case").select("id", "case", "s.start", "s.end")
    got = sorted(map(tuple, intervals.boundary_report(cases, found, "id").collect()))
    took = time.perf_counter() - begun
    assert got == [(1, case, 1, 3_001, 1, -2) for case in ("cross_boundary", "just_after", "just_before")] and took < 20


def test_report_reads_predictions_once(spark):
    from pyspark.sql import Row

    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(len(b))
            yield b

    cases = spark.createDataFrame([(1, "a", 5, 5, 9), (1, "b", 5, 1, 5), (2, "a", 3, 3, 7)], "id long, case string, boundary int, start int, end int")
    found = spark.createDataFrame([(1, "a", 0, 6), (1, "a", 8, 9), (1, "a", 9, 12), (1, "a", 6, 6), (1, "b", 5, 7), (9, "a", 0, 1)], "id long, case string, start int, end int").mapInPandas(told, "id long, case string, start int, end int")
    out = sorted(intervals.boundary_report(cases, found, "id").collect())
    row = Row("id", "case", "boundary", "predicted_count", "overlap_count", "span_inflation")
    assert out == [row(1, "a", 5, 4, 2, -1), row(1, "b", 5, 1, 0, 0), row(2, "a", 3, 0, 0, 0)] and read.value == 6


def plain_balance(rows, size, seed, least):
    key = lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i)
    order = sorted((i for i, _ in rows), key=key)
    if size <= 0:
        return set()
    by_label = defaultdict(list)
    for i in order:
        for label in dict(rows)[i]:
            by_label[label].append(i)
    chosen = []
    for label in sorted(by_label):
        chosen += [i for i in by_label[label] if i not in chosen][:least]
    chosen = sorted(chosen, key=key) + [i for i in order if i not in chosen]
    return set(chosen[:size])


@pytest.mark.parametrize("size, least", [(0, 3), (15, 3), (40, 3), (40, 0), (500, 3), (12, 9)])
def test_balanced_sample_equals_a_sequential_one(spark, size, least):
    r = random.Random(size + least)
    rows = [(f"d{k}", sorted(set(r.choices(["common"] * 12 + ["b", "c", "rare", "a"], k=r.randint(0, 4))))) for k in range(150)]
    df = spark.createDataFrame([(i, x, "text") for i, x in rows], "sample_id string, labels array<string>, text string")
    got = sampling.label_balanced(df.repartition(3), size, 5, least)
    assert got.columns == df.columns and {x["sample_id"] for x in got.collect()} == plain_balance(rows, size, 5, least)


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_LABELS", 2)
    df = spark.createDataFrame([("a", ["x", "y", "z"])], "sample_id string, labels array<string>")
    with pytest.raises(ValueError, match="labels"):
        sampling.label_balanced(df, 1, 1, 1)


def test_slices_read_texts_once(spark):
    gold = [(0, 4, "EMAIL", 0.9, "d", "email")]
    rows = [("text one", gold, gold, "en", None), ("text two", gold, [], "en", 3), ("", [], gold, None, 3)]
    df = spark.createDataFrame(rows, f"text string, gold {spans.SPANS}, predicted {spans.SPANS}, language string, bucket int")
    out = metrics.slices(df, ["language", "bucket"], ["char_canonical", "exact_canonical"])
    got = {(x["slice"], x["value"], x["family"]): (x["tp"], x["fp"], x["fn"], x["samples"]) for x in out.collect()}
    assert got["language", "en", "char_canonical"] == (4, 0, 4, 2) and got["language", "unknown", "exact_canonical"] == (0, 1, 0, 1)
    assert got["bucket", "unknown", "exact_canonical"] == (1, 0, 0, 1) and got["bucket", "3", "char_canonical"] == (0, 4, 4, 2) and len(got) == 8
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Expand" in plan
