"""Fill-in-middle against plain strings, and the way back."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilmark.llm import fim

TEXTS = [
    None, "", "a", "ab", "naïve 𝒳 😀 é 日本\r\n\tz", "one <P> mark", "<S>", "x<M>y", "< P> <p> <<S <M", "same text", "same text", " \n ", "word " * 30_000, "😀" * 70_000,
    *(f"plain words no {i}, and some more\nof them" for i in range(120)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(9, "same text"), (9, "another text"), (None, "without a key"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in (*fim.OWN, "key", "whole", "_c0", "_c1")})


def expected(key, text, units):
    t = text or ""
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest())[:4]]
    parts = list(t) if units == "points" else re.findall(r"\s+|\S+", t)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return (key, text, n, "plain", None, None, t)
    spm = h[3] % 100 < 20
    return (key, text, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("units", ["points", "words"])
def test_fill_in_middle(docs, units):
    out = fim.fill_in_middle(docs, units=units)
    assert [c for c in out.columns if c in ("key", "whole", "_c0", "_c1")] == ["key", "whole", "_c0", "_c1"]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") and r["_c0"] == "mine" and r["key"] == "mine" for r in got)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["text"], *(r[c] for c in fim.OWN)) for r in got) == Counter(expected(k, t, units) for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_nothing_to_cut(docs, spark, tmp_path):
    none = docs.where("false")
    assert fim.fill_in_middle(none).count() == 0
    none.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert fim.op12_fill_in_middle(spark, str(tmp_path)).count() == 0


def test_the_same_on_other_partitions(docs):
    one = lambda df: sorted(map(repr, fim.fill_in_middle(df).select("doc_id", *fim.OWN).collect()))
    assert one(docs.coalesce(1)) == one(docs.repartition(7))


def test_unknown_units():
    with pytest.raises(ValueError, match="unknown units"):
        fim.cut("text", 1, "lines", "1")
