"""Language identification against sums over listed segmentations, and on made-up languages."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import language_id

PIECES = language_id.Pieces(language_id.default_vocabulary())
SYLLABLES = {"aa": ["the", "ing", "er", "wh", "ly"], "bb": ["der", "sch", "ung", "ein", "ü"], "cc": ["que", "ción", "lla", "os", "ñ"]}


def segmentations(marked):
    """All ways to cut a marked word; a character that is no piece is the unknown piece."""
    if not marked:
        yield []
    for k in range(1, len(marked) + 1):
        number = PIECES.number.get(marked[:k], PIECES.unknown if k == 1 else None)
        if number is not None:
            for rest in segmentations(marked[k:]):
                yield [number, *rest]


@pytest.fixture(scope="module")
def law():
    p = np.random.default_rng(3).random((PIECES.unknown + 1, 3)) ** 4
    return p / p.sum(axis=0)


def test_forward_sums_all_segmentations(law):
    words = ["a", "the", "nation", "über", "größe", "日本", "ñandú", "x" * 9, "information"]
    got = language_id.forward(words, PIECES, law)
    for w, row in zip(words, got):
        assert np.allclose(row, np.log(sum(np.prod(law[s], axis=0) for s in segmentations("▁" + w))))


def test_expected_counts(law):
    words, counts = ["the", "nation", "über", "a", "the日"], np.array([3.0, 1.0, 2.0, 5.0, 1.0])
    expected = np.zeros(len(law))
    for w, n in zip(words, counts):
        ways = [(s, np.prod(law[s, 1])) for s in segmentations("▁" + w)]
        for s, p in ways:
            for piece in s:
                expected[piece] += n * p / sum(q for _, q in ways)
    assert np.allclose(language_id.expected(words, counts, PIECES, law[:, 1]), expected)


def test_long_words_do_not_underflow(law):
    short, long = language_id.forward(["nation", "nation" * 400], PIECES, law)
    assert np.isfinite(long).all() and (long < 300 * short / 2).all()
    mixed = language_id.forward(["nation" * 400, "the", "日" * 5000], PIECES, law)
    assert np.allclose(mixed[0], long) and np.isfinite(mixed).all()


def made(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    rows = [(i, made(r, lang, r.choice([6, 30, 200])), lang) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(240))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, " 12, ² _ ½ !", "cc"), (903, made(r, "cc", 40), None), (904, "der" * 400, None), (904, "der" * 400, None), (None, made(r, "bb", 40), None)]
    rows += [(905, made(r, "bb", 60_000).upper(), None), (906, "語", None), (907, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def test_made_up_languages(docs, monkeypatch):
    monkeypatch.setattr(language_id, "_SLICE_WORDS", 5_000)
    marked = docs.withColumn("held_out", language_id.held_out())
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode() if x["doc_id"] is not None else b"") % 5 == 0) for x in marked.collect())
    model = language_id.learn(marked.where("not held_out"))
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(model.law.sum(axis=0), 1)
    clash = marked.withColumns({c: F.lit("mine") for c in ("lang_pred", "score", "whole", "_c0", "rank", "most")})
    out = language_id.predict(clash, model)
    assert out.columns == [*(c for c in clash.columns if c not in language_id.OWN), *language_id.OWN]
    got = out.collect()
    assert Counter(x["doc_id"] for x in got) == Counter(x["doc_id"] for x in docs.collect()) and all(0 <= x["score"] <= 1 and x["whole"] == "mine" for x in got)
    right = [x["lang"] == x["lang_pred"] for x in got if x["held_out"] and x["lang"] and x["doc_id"] < 900]
    assert len(right) > 20 and all(right)
    told = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in got}
    assert all(told[k] == ("und", 0.0) for k in (900, 901, 902, 907))
    assert told[903][0] == "cc" and told[904][0] == "bb" and told[None][0] == "bb" and told[905] == ("bb", 1.0) and told[906][0] in SYLLABLES


def test_ids_languages_and_sources_are_no_inputs(docs):
    model = language_id.learn(docs)
    one = lambda df: sorted((x["text"] or "", x["lang_pred"], round(x["score"], 9)) for x in language_id.predict(df, model).collect())
    assert one(docs) == one(docs.withColumns({"lang": F.lit("aa"), "doc_id": F.lit(1)}).coalesce(1))


def test_the_sample_is_bounded_by_language(docs):
    few = language_id.learn(docs.where("lang is not null"), sample=4)
    assert few.languages == ["aa", "bb", "cc"] and np.isfinite(few.law).all()


def test_nothing_to_learn_from(docs, spark, monkeypatch):
    model = language_id.learn(docs.where("lang is null"))
    assert {(x["lang_pred"], x["score"]) for x in language_id.predict(docs, model).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.where("false"), language_id.learn(docs.where("false"))).count() == 0
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(docs)


def test_held_out_accuracy_of_the_query(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op13_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [x["lang"] == x["lang_pred"] for x in got if x["held_out"]]
    assert len(got) == 1000 and len(held) > 100 and sum(held) >= 0.99 * len(held)
