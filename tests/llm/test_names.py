"""Every operator beside columns that have the names it uses itself: the same results, and the columns as they were."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilmark import llm
from veilmark.llm import chat, decontaminate, fim, html_extract, jaccard_join, language_id, merkle, packing, quality_classifier, quality_rules, sharding, token_files, tokens, url_filter

SOURCES = {p.stem: p.read_text() for p in Path(llm.__file__).parent.glob("*.py")}
DOCUMENT = {"doc_id", "text", "lang", "source", "n_chars"}


def names_in(module):
    """Names in quotes that columns could have, in the operator's module."""
    found = set(re.findall(r"\"(_?[a-z][a-z0-9_]*)\"", SOURCES[module])) | set(re.findall(r"(?:^|[ ,\"(])(_?[a-z][a-z0-9_]*) (?:long|int|string|double|binary|boolean)\b", SOURCES[module]))
    return sorted(found - DOCUMENT - {"page_id", "url", "html", "conv_id", "turn", "role", "item_id"})


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i} is here" for i in range(40)) + "."
    rows = [(i, f"{base}\nLine {i} of it stands by itself, as it should.\n" + "more words to tell " * (i % 4), ["en", "de"][i % 2], f"s{i % 3}", 7 * i) for i in range(24)]
    rows += [(90, None, None, None, None), (91, "", "en", "s0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)


@pytest.fixture(scope="module")
def labels(docs):
    return docs.where("doc_id < 20").select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit(0).alias("toxic"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word3 is here word4 is here word5 is here word6 is here"), (1, "word3 is here word4 is here word5 is here word6 is here"), (2, "Line 7 of it")], "item_id long, text string")


CASES = {
    "url_filter": lambda d, x: url_filter.judge_urls(d.withColumn("url", F.concat(F.lit("http://a.net/es/"), "source"))).select("doc_id", "host", "path", "rule", "verdict", *x("host", "path", "rule", "verdict", "url")),
    "sharding": lambda d, x: sharding.shard_rows(d, 3).select("doc_id", "text", "shard", "slot", *x("shard", "slot")),
    "quality_rules": lambda d, x: quality_rules.clean(d),
    "fim": lambda d, x: fim.fill_in_middle(d).select("doc_id", *fim.OWN, *x(*fim.OWN)),
    "merkle": lambda d, x: merkle.merkle_tree(d)[1].drop("steps"),
    "packing": lambda d, x: packing.pack(d, tokens.default_vocabulary(), 64).groupBy("doc_id", "piece").agg(F.sum("length"), F.max("ids_crc32")),
}


@pytest.mark.parametrize("module", sorted(CASES))
def test_with_its_own_names(docs, module):
    run, extra = CASES[module], [c for c in names_in(module)]
    wide = docs.withColumns({c: F.lit(f"my {c}") for c in extra})
    assert len(extra) > 3
    expected = run(docs, lambda *own: []).collect()
    got = run(wide, lambda *own: [c for c in extra if c not in own])
    mine = [c for c in got.columns if c in extra and c not in docs.columns and c not in set(expected[0].__fields__)]
    rows = got.collect()
    assert all(r[c] == f"my {c}" for r in rows for c in mine)
    fields = [c for c in expected[0].__fields__ if c in got.columns]
    assert fields == list(expected[0].__fields__)
    pick = lambda rs: sorted(repr([r[c] for c in fields if c not in ("slot", "shard")]) for r in rs)
    assert pick(rows) == pick(expected)
    if module in ("url_filter", "sharding", "fim", "quality_rules"):
        assert mine


def test_decontamination_with_its_own_names(docs, bench):
    extra = [c for c in names_in("decontaminate") if c not in ("n_words", "hits", "items")]
    wide = docs.withColumns({c: F.lit(f"my {c}") for c in extra})
    for chars in (10**9, 40):  # one block, and several
        expected = {r["doc_id"]: (r["n_words"], r["hits"], r["items"]) for r in decontaminate.find_passages(docs, bench, block_chars=chars).collect()}
        rows = decontaminate.find_passages(wide, bench, block_chars=chars).collect()
        assert {r["doc_id"]: (r["n_words"], r["hits"], r["items"]) for r in rows} == expected and all(r[c] == f"my {c}" for r in rows for c in extra)
        assert expected[7][2] == [1, 2] and expected[8][2] == [1]
    kept = decontaminate.drop_contaminated(docs.withColumns({c: F.lit(f"my {c}") for c in names_in("decontaminate")}), bench)
    assert all(r[c] == f"my {c}" for r in kept.collect() for c in names_in("decontaminate")) and kept.count() == 2


def test_stages_with_all_names(docs, labels):
    names = sorted(set().union(*(names_in(m) for m in ("quality_classifier", "quality_rules", "jaccard_join", "shingles"))))
    wide = docs.withColumns({c: F.lit(f"my {c}") for c in names})
    for stage in (lambda d: quality_classifier.keep_good(d, labels), lambda d: quality_rules.clean(d), lambda d: jaccard_join.one_of_each(d, words=5, percent=80)):
        expected = sorted(repr((r["doc_id"], r["text"])) for r in stage(docs).collect())
        out = stage(wide)
        rows = out.collect()
        assert out.columns == wide.columns and sorted(repr((r["doc_id"], r["text"])) for r in rows) == expected and all(r[c] == f"my {c}" for r in rows for c in names)


def test_language_and_token_files_with_their_own_names(docs, spark, tmp_path):
    extra = [c for c in names_in("language_id") if c not in language_id.OWN]
    wide = docs.withColumns({c: F.lit(f"my {c}") for c in extra})
    model, plain = language_id.learn(wide), language_id.learn(docs)
    assert model.languages == plain.languages and abs(model.law - plain.law).max() < 1e-12
    rows = language_id.predict(wide, model).collect()
    assert all(r[c] == f"my {c}" for r in rows for c in extra) and len(rows) == docs.count()
    token_files.write_tokens(docs.withColumns({c: F.lit("x") for c in names_in("token_files")}), f"file://{tmp_path}/o", tokens.default_vocabulary())
    assert token_files.digests(spark, f"file://{tmp_path}/o").count() == docs.count()


def test_pages_and_chats_with_their_own_names(spark):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", f"<body><nav>menu</nav><article><h1>Title {i}</h1><p>Some text of page {i} with words.</p></article></body>") for i in range(4)], "page_id long, url string, html string")
    text = lambda df: sorted((r["page_id"], r["text"]) for r in html_extract.extract(df).collect())
    if hasattr(html_extract, "extract"):
        assert text(pages) == text(pages.withColumns({c: F.lit("x") for c in names_in("html_extract") if c != "text"}))
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    wide = turns.withColumns({c: F.lit("x") for c in names_in("chat") if c not in ("text", "conversations", "messages")})
    assert sorted(map(repr, chat.turns_of_table(wide).collect())) == sorted(map(repr, chat.turns_of_table(turns).collect()))


def test_the_pipeline_names_its_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
