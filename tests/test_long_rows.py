"""Span algebra in rows of very many spans: equal to a plain sweep, and in seconds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilmark.operators import metrics, spans

LABELS = ["email", "ip", "phone", "secret"]


def made(r, n, width, reach):
    out = []
    for _ in range(n):
        s, c = r.randint(0, width), r.choice(LABELS)
        out.append((s, s + r.randint(0, reach), c.upper(), round(r.choice([0.0, 0.4, 0.5, 0.9, r.random()]), 2), r.choice("de"), c))
    return out


def plain_contained(rows):
    kept = []
    for s in sorted((x for x in rows if x[3] > 0), key=lambda x: (-x[3], x[0], x[0] - x[1], x)):
        if not any(k[2] == s[2] and k[0] <= s[0] and k[1] >= s[1] for k in kept):
            kept.append(s)
    return kept


def plain_groups(rows):
    groups = []
    for s in sorted(x for x in rows if x[1] > x[0]):
        if groups and s[0] <= max(x[1] for x in groups[-1]):
            groups[-1].append(s)
        else:
            groups.append([s])
    return groups


def plain_merged(rows):
    out = []
    for g in plain_groups(rows):
        best = max(g, key=lambda s: (spans.NORMALIZER_RANK[s[5]], s[3], s[1] - s[0], -s[0]))
        out.append((g[0][0], max(s[1] for s in g), best[2], max(s[3] for s in g), best[4], best[5], sorted({s[4] for s in g}), sorted({s[5] for s in g}), len(g)))
    return out


def test_against_plain_sweeps(spark):
    r = random.Random(12)
    rows = [(i, made(r, r.choice([0, 1, 2, 15, 16, 17, 40, 120, 400]), r.choice([30, 300, 5000]), r.choice([3, 40]))) for i in range(70)]
    rows.append((99, [(0, 1000, "EMAIL", 0.1, "d", "email"), *made(r, 300, 900, 20)]))
    df = spark.createDataFrame(rows, f"id int, s {spans.SPANS}")
    s = F.col("s")
    got = {x["id"]: x for x in df.select("id", spans.drop_contained(s).alias("k"), spans.merge_ranges(s).alias("m"), spans.union_merge(s, spans.NORMALIZER_RANK, 70).alias("u")).collect()}
    for i, own in rows:
        assert [tuple(k) for k in got[i]["k"]] == plain_contained(own)
        assert [tuple(m) for m in got[i]["m"]] == [(g[0][0], max(x[1] for x in g)) for g in plain_groups(own)]
        assert [tuple(u) for u in got[i]["u"]] == plain_merged(own)


def test_common_length(spark):
    r = random.Random(13)
    rows = [(i, made(r, r.choice([0, 5, 60]), 400, 9), made(r, r.choice([0, 5, 60]), 400, 9)) for i in range(40)]
    df = spark.createDataFrame(rows, f"id int, a {spans.SPANS}, b {spans.SPANS}")
    got = {x["id"]: x["n"] for x in df.select("id", spans.intersection_length(spans.merge_ranges(F.col("a")), spans.merge_ranges(F.col("b"))).alias("n")).collect()}
    points = lambda xs: {p for x in xs for p in range(x[0], x[1])}
    assert got == {i: len(points(a) & points(b)) for i, a, b in rows}


def test_exact_matches_count_as_multisets(spark):
    r = random.Random(14)
    rows = [(i, made(r, r.choice([0, 7, 90]), 12, 2), made(r, r.choice([0, 7, 90]), 12, 2)) for i in range(30)]
    df = spark.createDataFrame(rows, f"id int, g {spans.SPANS}, p {spans.SPANS}")
    for with_label in (True, False):
        got = {x["id"]: x["c"]["tp"] for x in df.select("id", metrics.exact_counts(F.col("g"), F.col("p"), with_label).alias("c")).collect()}
        key = (lambda s: (s[0], s[1], s[5])) if with_label else (lambda s: s[:2])
        from collections import Counter

        assert got == {i: sum((Counter(map(key, g)) & Counter(map(key, p))).values()) for i, g, p in rows}


@pytest.mark.parametrize("n", [100_000])
def test_a_hundred_thousand_spans(spark, n):
    r = random.Random(15)
    row = [(7 * k, 7 * k + r.randint(1, 8), "IP", r.choice([0.5, 0.9, 0.99]), "d", "ip") for k in range(n)]
    df = spark.createDataFrame([(row,)], f"s {spans.SPANS}")
    begun, s = time.perf_counter(), F.col("s")
    got = df.select(F.size(spans.drop_contained(s)).alias("k"), F.size(spans.merge_ranges(s)).alias("m"), F.size(spans.union_merge(s, spans.NORMALIZER_RANK, 70)).alias("u"), metrics.char_counts(s, s)["tp"].alias("c"), metrics.exact_counts(s, s, True)["tp"].alias("e")).first()
    groups = 1 + sum(b[0] > a[1] for a, b in zip(row, row[1:]))
    inside = sum(b[1] <= a[1] and b[3] <= a[3] for a, b in zip(row, row[1:]))
    assert (got["k"], got["m"], got["u"], got["e"]) == (n - inside, groups, groups, n)
    assert got["c"] == len({p for x in row for p in range(x[0], x[1])})
    assert time.perf_counter() - begun < 90
