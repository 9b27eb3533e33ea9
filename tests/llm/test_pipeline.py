"""The pipeline's stages on the smallest tables: what goes, what stays, and that what stays keeps its columns."""

import random
from collections import defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from veilmark.llm import decontaminate
from veilmark.llm.common import written

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, str(DATA)), "test-stage")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(kept[name]) <= before
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    first = kept["quality classifier"]
    right = [labels[i] == (i in first) for i in labels]
    assert sum(right) / len(right) >= 0.97
    left = kept["n-gram Jaccard join"]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in left.items() if (w := t.lower().split())}
    ids = sorted(sets)
    assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
    bench = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (w := decontaminate.words(r["text"])) for i in range(max(1, len(w) - 9))}
    for i, t in left.items():
        w = decontaminate.words(t)
        hit = any(tuple(w[k : k + m]) in bench for m in {len(b) for b in bench} for k in range(len(w) - m + 1))
        assert hit == (i not in kept["benchmark decontamination"])


def test_run(spark):
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    full = defaultdict(int)
    for r in rows:
        full[r["sequence_id"]] += r["length"]
    assert rows and max(full.values()) <= 2048 and len(full) <= sum(full.values()) / 2048 * 1.1 + 1


def prose(seed, lines):
    """Sentences that no other seed has."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubdlmnrst") for _ in range(r.randint(2, 8)))
    return "\n".join(f"{word().capitalize()} {' '.join(word() for _ in range(12))}." for _ in range(lines))


def made(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, packed string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [d[0] for d in docs if d[0] is not None][:60]
    spark.createDataFrame([(i, 1, 0) for i in ids if i < 900] + [(i, 0, 0) for i in ids if i >= 900] or [(-1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose("leak", 1).split()[1:13]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    text = lambda n: prose(n, 6)
    docs = [(n, text(n), "en", f"s{n % 3}", 1, "mine") for n in range(40)]
    docs += [(900 + n, "BUY!! NOW!! " * 30, "en", "s9", 1, "mine") for n in range(20)]
    docs += [(None, None, None, None, None, None), (None, text(500), None, None, None, "mine"), (3, text(3), "en", "s0", 1, "mine"), (3, text(600), "en", "s0", 1, "mine"), (50, "", "en", "s1", 0, "mine")]
    docs += [(60, prose("long", 2_000), "en", "s1", 1, "mine"), (61, text(700) + "\n" + prose("leak", 1), "en", "s1", 1, "mine")]
    d = made(spark, tmp_path, docs)
    docs_df = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs_df = written(stage(spark, docs_df, d), "test-odd")
        assert docs_df.columns == ["doc_id", "text", "lang", "source", "n_chars", "packed"]
    left = docs_df.collect()
    texts = [r["text"] for r in left]
    assert len(set(texts)) == len(texts) and None not in texts
    kept = {r["doc_id"] for r in left}
    assert set(range(40)) <= kept and None in kept and 60 in kept and 61 not in kept and not any(i is not None and i >= 900 for i in kept)
    assert sum(r["doc_id"] == 3 for r in left) == 2 and all(r["packed"] == "mine" for r in left)
    rows = corpus_pipeline.packing_stage(spark, docs_df, d).collect()
    assert {r["doc_id"] for r in rows} == kept and max(r["length"] for r in rows) <= 2048


def test_an_empty_table(spark, tmp_path):
    d = made(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, d).count() == 0
